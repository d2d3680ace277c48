"""Incremental resolution: reference records that arrive as a stream, against stored postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.blocking import rank_by_rules
from tessera.operators.postings import open_postings
from tessera.session import workspace
from tessera.sources.records import RECORD


def record_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New TSV files of a folder as they appear."""
    return spark.readStream.option("sep", "\t").option("header", True).option("quote", "").schema(RECORD).csv(folder)


def resolve(stream: DataFrame, postings: DataFrame, out: str, checkpoint: str, **options):
    """Start writing each batch's candidates below ``out``, a folder per batch, so that a batch run twice counts once.

    postings: of operators.postings, made once and read by each batch.
    """

    def one(batch: DataFrame, number: int) -> None:
        rank_by_rules(batch, postings, **options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def resolve_all(spark: SparkSession, folder: str, pool: DataFrame, **options) -> DataFrame:
    """Run over what the folder holds now; the candidates of all batches."""
    place = workspace(spark, "stream")
    resolve(record_stream(spark, folder), open_postings(pool, f"{place}/index"), f"{place}/out", f"{place}/checkpoint", **options).awaitTermination()
    return spark.read.parquet(f"{place}/out").drop("batch")
