"""Substring dedup: Rabin-Karp hashes of all windows of words, counted in Spark.

Documents are taken in blocks of about ``block_words`` words. A block hashes
every window of ``window`` words (polynomial hash modulo 2^64 over 64-bit word
hashes), keeps each distinct hash once and sends it, packed with others of
its range of hashes, to the task that counts this range. So a window that a
third of all rows share is sent once per block. The count answers each block
with one bit per distinct hash: seen in another block too.

A block's rows and its answer are files of the shared folder. The second pass
goes through the blocks by name, reads both and merges repeated windows into
maximal intervals of words, so it doesn't matter how the input is split then
or which executors are left. Rows are staged first unless the caller says that
they are read from files as they are, so that a task that runs again makes the
same blocks. Nothing but hashes is shuffled.

Ranges are as many as the input asks for (RANGE_BYTES of text each). At 64
bits, two of n windows share a hash by chance with n*n/2^65: about one in
3,000 runs of 10^8 windows.

Defined results: null text or one of fewer words than a window loses nothing;
repeated rows repeat each other's windows; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm.common import Files, byte_values, fields, map_arrow, packed, raw, spread, stage_table, table, words_in, workspace

#: Production parameters.
WINDOW = 35
BLOCK_WORDS = 500_000
RANGE_BYTES, LEAST_RANGES = 16_000_000, 1024
_BASE = 0x9E3779B97F4A7C15 | 1


def window_hashes(words: np.ndarray, window: int) -> np.ndarray:
    """The hash of each run of ``window`` word hashes: sum of w[i+j] * base^(window-1-j), mixed."""
    with np.errstate(over="ignore"):
        power = {1: words}  # hashes of 1, 2, 4 ... words
        out, have = None, 0
        size = 1
        while size <= window:
            if size > 1:
                half = power[size // 2]
                power[size] = half[: len(half) - size // 2] * np.uint64(pow(_BASE, size // 2, 2**64)) + half[size // 2 :]
            if window & size:
                part = power[size]
                if out is None:
                    out, have = part, size
                else:  # what we have goes after this part
                    n = len(words) - have - size + 1
                    out = part[:n] * np.uint64(pow(_BASE, have, 2**64)) + out[size : size + n]
                    have += size
            size *= 2
        x = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Block:
    """Whole documents with the hashes of their windows. sizes: words of each; words: of all, one after the other."""

    def __init__(self, sizes: np.ndarray, words: pa.Array, window: int):
        coded = words.dictionary_encode()
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, byte_values(coded.dictionary)), dtype=np.uint64, count=len(coded.dictionary))
        flat = hashes[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
        self.name = xxhash.xxh3_128_hexdigest(flat.tobytes() + sizes.tobytes())
        self.begin = np.cumsum(sizes) - sizes
        n = np.maximum(sizes - window + 1, 0)
        self.at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.begin, n)  # where windows start
        every = window_hashes(flat, window) if len(flat) >= window else np.zeros(0, np.uint64)
        self.distinct, self.inverse, counts = np.unique(every[self.at], return_inverse=True, return_counts=True)
        self.twice = counts > 1
        self.total = len(flat)

    def cuts(self, bits: int) -> np.ndarray:
        """Where each of the 2^bits ranges begins in the sorted distinct hashes, and the end."""
        edges = np.arange(2**bits, dtype=np.uint64) << np.uint64(64 - bits)
        return np.append(np.searchsorted(self.distinct, edges), len(self.distinct))


def in_blocks(batches: Iterator[pa.RecordBatch], column: int, block_words: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, pa.Array]]:
    """Rows up to the one that reaches block_words words, with their words; batches' borders make no difference."""
    held, sizes, words, n = [], [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            rows = batch.slice(at, 500)
            own, every = words_in(rows.column(column))
            ends = np.cumsum(own)
            lo = 0
            while lo < rows.num_rows:
                begin = int(ends[lo] - own[lo])
                hi = min(int(np.searchsorted(ends, begin + block_words - n)) + 1, rows.num_rows)
                held.append(rows.slice(lo, hi - lo))
                sizes.append(own[lo:hi])
                words.append(every.slice(begin, int(ends[hi - 1]) - begin))
                n += int(ends[hi - 1]) - begin
                if n >= block_words:
                    yield held, np.concatenate(sizes), pa.concat_arrays(words)
                    held, sizes, words, n = [], [], [], 0
                lo = hi
    if held:
        yield held, np.concatenate(sizes), pa.concat_arrays(words)


def count_windows(documents: DataFrame, at: int, folder: str, bits: int, window: int, block_words: int) -> DataFrame:
    """Write every block's rows and its answer: packed bits, one per distinct hash, range after range. Returns the blocks' names."""
    sent_schema = fields("range int, block string, hashes binary")
    answer_schema = fields("block string, range int, n int, seen binary")
    done_schema = fields("block string, ranges int")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, partition = Files(f"{folder}/rows"), TaskContext.get().partitionId()
        for seq, (held, sizes, words) in enumerate(in_blocks(batches, at, block_words)):
            b = Block(sizes, words, window)
            name = f"{partition:06d}-{seq:05d}-{b.name}"
            files.write(name, [packed(pa.Table.from_batches(held))])
            cut = b.cuts(bits)
            # the first range always, so that every block gets an answer
            some = np.union1d([0], np.flatnonzero(np.diff(cut)))
            for lo in range(0, len(some), 256):
                part = some[lo : lo + 256]
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array([name] * len(part)), pa.array([b.distinct[cut[r] : cut[r + 1]].tobytes() for r in part], pa.binary())], names=["range", "block", "hashes"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(number: int, blocks: list[str], parts: list[np.ndarray]) -> pa.RecordBatch:
            x = np.concatenate(parts)
            order = np.argsort(x, kind="stable")
            same = x[order][1:] == x[order][:-1]
            seen = np.zeros(len(x), dtype=bool)
            seen[order] = np.append(same, False) | np.append(False, same)
            ends = np.cumsum([len(p) for p in parts])
            bits_of = [np.packbits(s).tobytes() for s in np.split(seen, ends[:-1])]
            return pa.RecordBatch.from_arrays([pa.array(blocks), pa.array([number] * len(parts), pa.int32()), pa.array([len(p) for p in parts], pa.int32()), pa.array(bits_of, pa.binary())], names=["block", "range", "n", "seen"])

        number, blocks, parts = None, [], []
        for batch in batches:
            for r, name, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r != number and parts:
                    yield close(number, blocks, parts)
                    blocks, parts = [], []
                number = r
                blocks.append(name)
                parts.append(np.frombuffer(hashes, dtype=np.uint64))
        if parts:
            yield close(number, blocks, parts)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(f"{folder}/answers")

        def close(name: str, ranges: dict[int, tuple[int, bytes]]) -> pa.RecordBatch:
            seen = [np.unpackbits(np.frombuffer(ranges[r][1], np.uint8), count=ranges[r][0]) for r in sorted(ranges)]
            files.write(name, [np.packbits(np.concatenate(seen)).tobytes()])
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(ranges)], pa.int32())], names=["block", "ranges"])

        name, ranges = None, {}
        for batch in batches:
            for block, r, n, seen in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != name and ranges:
                    yield close(name, ranges)
                    ranges = {}
                name = block
                ranges[r] = (n, seen)
        if ranges:
            yield close(name, ranges)

    sent = map_arrow(documents, send, sent_schema)
    counted = map_arrow(sent.repartition("range").sortWithinPartitions("range"), count, answer_schema)
    answered = map_arrow(counted.repartition("block").sortWithinPartitions("block", "range"), answer, done_schema)
    return stage_table(answered, "answers").select("block")


FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.StringType())])


def repeated_windows(documents: DataFrame, *, text: str = "text", window: int = WINDOW, found: str = "found", stable: bool = False, block_words: int = BLOCK_WORDS) -> DataFrame:
    """documents with a struct column ``found``: n_words, n_removed, spans (maximal intervals of words in repeated windows), kept (the other words, joined by spaces).

    ``found`` must not be a column of documents. stable: the rows are read
    from files, so that a task that runs again gets them in the same order.
    """
    spark = documents.sparkSession
    if not stable:
        documents = stage_table(documents, "documents")
    at = documents.columns.index(text)
    total = documents.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = max(LEAST_RANGES.bit_length() - 1, (total // RANGE_BYTES).bit_length())
    folder = workspace(spark, "windows")
    blocks = count_windows(documents, at, folder, bits, window, block_words)
    schema = T.StructType([*documents.schema.fields, T.StructField(found, FOUND)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, answers = Files(f"{folder}/rows"), Files(f"{folder}/answers")
        for name in (x for batch in batches for x in batch.column(0).to_pylist()):
            held = pa.ipc.open_stream(files.read(name)).read_all()
            sizes, words = words_in(held.column(at).combine_chunks())
            b = Block(sizes, words, window)
            hit = np.zeros(b.total, dtype=bool)
            if len(b.distinct):
                seen = np.unpackbits(np.frombuffer(answers.read(name), np.uint8), count=len(b.distinct)).astype(bool)
                starts = b.at[(seen | b.twice)[b.inverse]]
                mark = np.zeros(b.total + 1, dtype=np.int32)
                mark[starts] += 1
                np.subtract.at(mark, starts + window, 1)
                hit = np.cumsum(mark[:-1]) > 0
            before = np.append(0, np.cumsum(hit))
            begin = 0
            for part in held.to_batches(max_chunksize=2000):
                values = []
                for text, size in zip(raw(part.column(at)), sizes[: part.num_rows].tolist(), strict=True):
                    split = text.split() if text else []
                    n = int(before[begin + size] - before[begin])
                    spans = []
                    if n:
                        own = hit[begin : begin + size]
                        edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]))).tolist()
                        spans = [{"begin": x, "end": y} for x, y in zip(edge[::2], edge[1::2], strict=True)]
                        split = [w for w, h in zip(split, own.tolist(), strict=True) if not h]
                    values.append({"n_words": size, "n_removed": n, "spans": spans, "kept": b" ".join(split).decode()})
                    begin += size
                sizes = sizes[part.num_rows :]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, type=arrow.field(len(arrow) - 1).type)], names=arrow.names)

    return map_arrow(spread(blocks), run, schema)


def remove_repeats(documents: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """documents with every repeated window's words taken out of the text; texts that lose nothing stay as they are."""
    from tessera.llm.common import fresh

    found = fresh(documents, "found")
    got = repeated_windows(documents, text=text, found=found, **options)
    new = F.when(F.col(f"{found}.n_removed") > 0, F.col(f"{found}.kept")).otherwise(F.col(f"`{text}`"))
    return got.withColumn(text, new).drop(found)


def op4(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = repeated_windows(docs, stable=True)
    return got.select("doc_id", "found.n_words", "found.n_removed", F.sha2(F.col("found.kept").cast("binary"), 256).alias("kept_sha256"))
