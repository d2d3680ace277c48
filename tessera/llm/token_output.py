"""Token-ID output: documents in doc_id order as shards of directly addressable codes.

Rows are range-partitioned by doc_id and sorted inside each partition; a task
encodes its texts and writes a shard whenever about ``shard_tokens`` tokens are
held, so a task's memory follows the shard, not the partition. The manifest
(one row per shard) is staged before anything is read; a shard written twice
by a task that ran twice has a name of its own and is in the manifest once.

Shards go to the shared folder through pyarrow's file systems (file, hdfs, s3 and others).

Defined results: null or empty text has no tokens but the end id; null doc_id
sorts first and stays null; repeated doc_ids are written one after the other
in the order of their texts; an empty table writes no shard.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm import dac
from tessera.llm.common import fields, map_arrow, stage_table, table, workspace
from tessera.llm.tokenizing import encoder

#: Production parameters.
END_ID = 2
SHARD_TOKENS = 4_000_000

MANIFEST = fields("path string, partition int, shard int, n_docs bigint, n_tokens bigint")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write_tokens(documents: DataFrame, folder: str, *, tokenizer: str | None = None, end_id: int | None = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write documents (doc_id, text) below folder; the manifest, with each shard's first token number as ``start``."""
    tokenizer = tokenizer or default_tokenizer()
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        partition, shard, keys, coded, held = TaskContext.get().partitionId(), 0, [], [], 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(coded), dtype="<u4")
            name = f"{partition:06d}-{shard:05d}-{uuid.uuid4().hex}.dac"
            with files.open_output_stream(f"{root}/{name}") as out:
                out.write(dac.encode(keys, [len(c) // 4 for c in coded], ids))
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "partition": partition, "shard": shard, "n_docs": len(keys), "n_tokens": len(ids)}], schema=to_arrow_schema(MANIFEST))

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                keys.append(key)
                coded.append(ids)
                held += len(ids) // 4
                if held >= shard_tokens:
                    yield close()
                    shard, keys, coded, held = shard + 1, [], [], 0
        if keys:
            yield close()

    rows = documents.select(F.col("doc_id").cast("bigint"), "text")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = stage_table(map_arrow(placed, run, MANIFEST), "manifest")
    # one row per shard: a small table, whatever the corpus
    before = Window.orderBy("partition", "shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """The documents of the shards: doc_id, start (token number), n_tokens, ids (little-endian uint32 as binary)."""
    schema = fields("doc_id bigint, start bigint, n_tokens bigint, ids binary")
    return _read(manifest, schema, lambda ids: ids.tobytes())


def _read(manifest: DataFrame, schema, value) -> DataFrame:
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files, place = pafs.FileSystem.from_uri(path)
                with files.open_input_file(place) as f:
                    r = dac.Reader(f.read_buffer())
                for lo in range(0, r.n_docs, 1000):
                    some = range(lo, min(lo + 1000, r.n_docs))
                    columns = [[r.doc_ids[k] for k in some], [start + int(r.starts[k]) for k in some], [int(r.starts[k + 1] - r.starts[k]) for k in some], [value(r.document(k)) for k in some]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(columns, arrow, strict=True)], names=arrow.names)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(manifest.select("path", "start").repartition(n), run, schema)


def token_digests(documents: DataFrame, name: str = "tokens") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the written shards."""
    folder = workspace(documents.sparkSession, name)
    schema = fields("doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return _read(write_tokens(documents, folder), schema, lambda ids: zlib.crc32(ids.tobytes()))


def op1(spark, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
