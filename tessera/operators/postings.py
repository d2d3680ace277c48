"""Stored postings of a pool, found again by what they were made of.

Defined results: an empty pool has empty postings; the order and the files of
the pool's rows make no difference, a row more or less or another parameter
does. A build that breaks off leaves no manifest and is made anew.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.blocking import MAX_KEY_FREQUENCY, postings_of
from tessera.sources.records import RECORD


def fingerprint(pool: DataFrame, **parameters) -> dict[str, object]:
    """Number of rows and two sums of row hashes, and the parameters."""
    h = [F.xxhash64(F.lit(seed), *RECORD.names).cast("decimal(38,0)") for seed in (1, 2)]
    n, a, b = pool.agg(F.count("*"), *(F.coalesce(F.sum(x), F.lit(0)) for x in h)).first()
    return {"rows": n, "sums": [str(a), str(b)], **parameters}


def _manifest(spark: SparkSession, path: str) -> dict | None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/_SUCCESS")):
        return None
    rows = spark.read.text(f"{path}/manifest").collect()  # one line
    return json.loads(rows[0][0]) if rows else None


def open_postings(pool: DataFrame, path: str, *, cap: int = MAX_KEY_FREQUENCY, strict: bool = True) -> DataFrame:
    """Postings of the pool below path: those that are there if they were made of the same rows and parameters, else new ones."""
    spark = pool.sparkSession
    wanted = fingerprint(pool, cap=cap, strict=strict)
    if _manifest(spark, path) != wanted:
        # the old manifest goes first, so that it never stands beside other postings
        spark.createDataFrame([], "value string").write.mode("overwrite").text(f"{path}/manifest")
        postings_of(pool, cap=cap, strict=strict).write.mode("overwrite").parquet(f"{path}/postings")
        spark.createDataFrame([(json.dumps(wanted),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return spark.read.parquet(f"{path}/postings")
