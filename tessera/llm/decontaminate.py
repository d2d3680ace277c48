"""Benchmark decontamination by suffix arrays over shards of the training text.

Words are maximal runs of ASCII letters and digits and of non-ASCII bytes,
after lower-casing A-Z. A shard is a run of whole documents of one partition
with about SHARD_WORDS words. Each shard gets a suffix array over the word
ids of the benchmark's vocabulary: of all suffixes that begin with words in
the order of some benchmark item, sorted by their first DEPTH words. Every
test suffix is binary-searched in it; the range of equal prefixes gives all
locations of a window, the neighbours give the longest verbatim match.

Nothing is shuffled or broadcast. The benchmark lies in the shared folder as
files of at most BLOCK_WORDS words, or of one longer item. One stage reads the
rows; each shard goes through the files one after the other, and a worker
keeps KEPT of them, so its memory has a bound whatever the benchmark's size.

Defined results: null or empty text has no words and no hits; an item without
words has no window; an item of fewer than ``window`` words is one window; a
repeated item_id counts once, with the windows of all its rows; repeated
documents are judged row by row; a null item_id is ignored. An empty
benchmark hits nothing. Of equally long matches that of the smallest doc_id
as a string counts (null first), then the smallest place.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm.common import Files, fields, fresh, map_arrow, raw, workspace

#: Production parameters.
WINDOW = 13
SHARD_WORDS = 1_000_000
BLOCK_WORDS, KEPT = 1_000_000, 4
#: Suffixes are sorted by so many words; longer matches are compared further.
DEPTH = 16

#: Word ids of a block, and as bytes that sort like them.
_ID, _SORTED, _WIDE = np.uint32, ">u4", 4
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


class Block:
    """Items of a benchmark as word ids, their windows and all their suffixes."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.vocab: dict[bytes, int] = {}
        self.ids = [i for i, _ in items]
        coded = [np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], dtype=_ID) for _, words in items]
        windows: dict[bytes, set[int]] = {}
        for k, code in enumerate(coded):
            n = min(window, len(code))
            big = code.astype(_SORTED).tobytes()
            for s in range(len(code) - n + 1):
                windows.setdefault(big[_WIDE * s : _WIDE * (s + n)], set()).add(k)
        self.keys = sorted(windows)
        self.items = [sorted(windows[k]) for k in self.keys]
        self.lengths = np.array([len(k) // _WIDE for k in self.keys], dtype=np.int64)
        # all items one after the other, a 0 after each
        self.text = np.concatenate([np.append(c, _ID(0)) for c in coded] + [np.zeros(DEPTH, _ID)]) if coded else np.zeros(DEPTH, _ID)
        self.owner = np.concatenate([np.full(len(c) + 1, k) for k, c in enumerate(coded)]) if coded else np.zeros(0, int)
        self.start = np.concatenate([np.arange(len(c) + 1) for c in coded]) if coded else np.zeros(0, int)
        # the first words that any window has, as one number: a suffix that begins otherwise matches none
        self.lead = min(3, int(self.lengths.min())) if len(self.keys) else 0
        m = np.int64(len(self.vocab) + 1)
        self.base = m
        at = np.arange(len(self.owner))
        at = at[self.text[at] > 0] if len(at) else at
        self.leads = np.unique(lead_codes(self.text, at, self.lead, m)) if self.lead else np.zeros(0, np.int64)


def lead_codes(text: np.ndarray, at: np.ndarray, lead: int, base: np.int64) -> np.ndarray:
    """The first words as one number; different words may share one, as it only tells what to leave out."""
    code = np.zeros(len(at), np.int64)
    for k in range(lead):
        code = code * base + text[at + k]
    return code


def sort_keys(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first DEPTH words of each suffix as bytes that sort like them."""
    big = text.astype(_SORTED)
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(big, DEPTH)[at]).view(f"V{_WIDE * DEPTH}").ravel().view(_KEY)


_KEY = f"S{_WIDE * DEPTH}"


def prefix_range(keys: np.ndarray, prefixes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) of the sorted keys that begin with each prefix."""
    size = _WIDE * DEPTH
    low, high = np.array([k[:size] for k in prefixes], dtype=_KEY), np.array([k[:size].ljust(size, b"\xff") for k in prefixes], dtype=_KEY)
    return np.searchsorted(keys, low, "left"), np.searchsorted(keys, high, "right")


class Shard:
    """Documents' word ids with a suffix array for one block."""

    def __init__(self, docs: list[list[bytes]], block: Block):
        self.sizes = np.array([len(d) for d in docs], dtype=np.int64)
        self.begin = np.cumsum(self.sizes + 1) - self.sizes - 1
        text = np.zeros(int(self.sizes.sum()) + len(docs) + DEPTH, dtype=_ID)
        get = block.vocab.get
        for d, b in zip(docs, self.begin, strict=True):
            if d:
                text[b : b + len(d)] = np.fromiter(map(get, d, repeat(0)), dtype=_ID, count=len(d))
        self.text, self.block = text, block
        at = np.flatnonzero(text)
        for k in range(1, block.lead):
            at = at[text[at + k] > 0]
        codes = lead_codes(text, at, block.lead, block.base)
        if len(block.leads):
            found = np.searchsorted(block.leads, codes)
            at = at[block.leads[np.minimum(found, len(block.leads) - 1)] == codes]
        else:
            at = at[:0]
        keys = sort_keys(text, at)
        order = np.argsort(keys, kind="stable")
        self.array, self.keys = at[order], keys[order]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(window, position) of every occurrence of the block's windows."""
        out_w, out_p = [], []
        deep = self.block.lengths > DEPTH
        lo, hi = prefix_range(self.keys, self.block.keys)
        n = hi - lo
        if n.sum():
            w = np.repeat(np.arange(len(n)), n)
            p = self.array[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
            for k in np.flatnonzero(deep & (n > 0)):  # windows longer than the sorted depth
                key = np.frombuffer(self.block.keys[k], dtype=_SORTED)
                own = np.flatnonzero(w == k)
                ok = [np.array_equal(self.text[p[x] : p[x] + len(key)], key) for x in own]
                w[own[~np.array(ok, dtype=bool)]] = -1
            out_w.append(w[w >= 0])
            out_p.append(p[w >= 0])
        empty = np.zeros(0, np.int64)
        return (np.concatenate(out_w), np.concatenate(out_p)) if out_w else (empty, empty)

    def longest(self, least: int, ids: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(item, its word, words matched, document, its word) of each test suffix's longest match of ``least`` words or more. ids: of the documents."""
        b, out = self.block, []
        tests = np.flatnonzero(b.text[: len(b.owner)])
        if not len(self.array) or not len(tests):
            return out
        keys = sort_keys(b.text, tests)
        at = np.searchsorted(self.keys, keys)
        best = np.zeros(len(tests), np.int64)
        # a neighbour of the place where the suffix would stand has the longest common beginning, as far as it is sorted
        for shift in (-1, 0):
            near = at + shift
            ok = np.flatnonzero((near >= 0) & (near < len(self.array)))
            best[ok] = np.maximum(best[ok], self._common(self.array[near[ok]], tests[ok], DEPTH))
        found = np.flatnonzero(best >= min(least, DEPTH))
        lo, hi = prefix_range(self.keys, [keys[k].ljust(_WIDE * DEPTH, b"\0")[: _WIDE * int(best[k])] for k in found])
        doc_of = np.searchsorted(self.begin, self.array, "right") - 1
        rank = np.empty(len(ids), np.int64)
        rank[sorted(range(len(ids)), key=lambda d: (ids[d] is not None, ids[d] or ""))] = np.arange(len(ids))
        rank = _dense(rank, ids)
        for k, x, y in zip(found.tolist(), lo.tolist(), hi.tolist(), strict=True):
            p, d, n = self.array[x:y], doc_of[x:y], int(best[k])
            if n >= DEPTH:
                length = self._common(p, np.full(len(p), tests[k]), None)
                n = int(length.max())
                p, d = p[length == n], d[length == n]
            if n >= least:
                first = np.lexsort((d, p - self.begin[d], rank[d]))[0]
                out.append((int(b.owner[tests[k]]), int(b.start[tests[k]]), n, int(d[first]), int(p[first] - self.begin[d[first]])))
        return out

    def _common(self, p: np.ndarray, t: np.ndarray, most: int | None) -> np.ndarray:
        """Words that the text from p and the benchmark from t have in common, up to ``most``."""
        a, c = self.text, self.block.text
        length, live = np.zeros(len(p), np.int64), np.arange(len(p))
        while len(live):
            i, j = np.minimum(p[live] + length[live], len(a) - 1), np.minimum(t[live] + length[live], len(c) - 1)
            live = live[(a[i] == c[j]) & (c[j] > 0)]
            length[live] += 1
            if most:
                live = live[length[live] < most]
        return length


def _dense(rank: np.ndarray, ids: list[str | None]) -> np.ndarray:
    """Equal ids get an equal rank: the least among them."""
    least: dict[str | None, int] = {}
    for d, r in zip(ids, rank.tolist(), strict=True):
        least[d] = min(r, least.get(d, r))
    return np.array([least[d] for d in ids], dtype=np.int64)


def write_blocks(benchmark: DataFrame, item: str, text: str, window: int, block_words: int) -> list[str]:
    """The benchmark as files in the shared folder, made on the driver one at a time; their names."""
    folder = workspace(benchmark.sparkSession, "benchmark")
    files, names = Files(folder), []
    items: list[tuple[str, list[bytes]]] = []
    words = 0

    def close() -> None:
        names.append(f"{folder}/{len(names):06d}")
        files.write(f"{len(names) - 1:06d}", [pickle.dumps(Block(items, window), protocol=5)])

    rows = benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("i"), F.col(text).cast("binary").alias("t"))
    for r in rows.toLocalIterator(prefetchPartitions=True):
        new = words_of(bytes(r.t) if r.t is not None else None)
        if not new:
            continue
        if items and words + len(new) > block_words:
            close()
            items, words = [], 0
        items.append((r.i, new))
        words += len(new)
    if items:
        close()
    return names


@lru_cache(maxsize=KEPT)
def read_block(name: str) -> Block:
    folder, _, file = name.rpartition("/")
    return pickle.loads(Files(folder).read(file))


def in_shards(batches: Iterator[pa.RecordBatch], column: int, shard_words: int) -> Iterator[tuple[pa.Table, list[list[bytes]]]]:
    """Whole rows in groups of about shard_words words."""
    held, docs, n = [], [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            new = [words_of(x) for x in raw(part.column(column))]
            held.append(part)
            docs += new
            n += sum(map(len, new))
            if n >= shard_words:
                yield pa.Table.from_batches(held), docs
                held, docs, n = [], [], 0
    if held:
        yield pa.Table.from_batches(held), docs


def merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [{"begin": s, "end": e} for s, e in out]


HITS = "struct<n_words: bigint, spans: array<struct<begin: bigint, end: bigint>>, items: array<string>>"


def contamination(
    documents: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS, hits: str = "hits"
) -> DataFrame:
    """documents with a struct column ``hits``: n_words, spans (maximal intervals of hit words), items (ids as strings, sorted).

    ``hits`` must not be a column of documents.
    """
    at = documents.columns.index(text)
    schema = documents.withColumn(hits, F.lit(None).cast(HITS)).schema
    arrow = to_arrow_schema(schema)
    blocks = write_blocks(benchmark, item, item_text, window, block_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, docs in in_shards(batches, at, shard_words):
            sizes = np.array([len(d) for d in docs], dtype=np.int64)
            begin = np.cumsum(sizes + 1) - sizes - 1
            mark = np.zeros(int((sizes + 1).sum()) + DEPTH + 1, np.int64)
            items: list[set[str]] = [set() for _ in docs]
            for name in blocks:
                b = read_block(name)
                w, p = Shard(docs, b).windows()
                np.add.at(mark, p, 1)
                np.add.at(mark, p + b.lengths[w], -1)
                doc = np.searchsorted(begin, p, "right") - 1
                for x in np.unique(doc * len(b.keys) + w).tolist():
                    items[x // len(b.keys)].update(b.ids[i] for i in b.items[x % len(b.keys)])
            edge = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(mark) > 0])))
            spans: list[list[dict]] = [[] for _ in docs]
            doc = np.searchsorted(begin, edge[::2], "right") - 1
            for d, s, e in zip(doc.tolist(), (edge[::2] - begin[doc]).tolist(), (edge[1::2] - begin[doc]).tolist(), strict=True):
                spans[d].append({"begin": s, "end": e})
            new = [{"n_words": len(d), "spans": s, "items": sorted(i)} for d, s, i in zip(docs, spans, items, strict=True)]
            done = rows.append_column(arrow.field(len(arrow) - 1), pa.array(new, type=arrow.field(len(arrow) - 1).type))
            yield from done.combine_chunks().to_batches()

    return map_arrow(documents, run, schema)


def longest_matches(
    documents: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: int = WINDOW, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """For each test suffix the longest verbatim match over all shards: item_id, item_word, n_words, doc_id, doc_word.

    Only matches of ``least`` words or more. One row for each test suffix and
    shard at most, so the shuffle is bounded by shards times benchmark words.
    """
    rows = documents.select(F.col(doc_id).cast("string").alias("d"), F.col(text).alias("t"))
    out_schema = fields("item_id string, item_word bigint, n_words bigint, doc_id string, doc_word bigint")
    arrow = to_arrow_schema(out_schema)
    blocks = write_blocks(benchmark, item, item_text, least, block_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, docs in in_shards(batches, 1, shard_words):
            ids = held.column(0).to_pylist()
            for name in blocks:
                b = read_block(name)
                got = [(b.ids[i], s, n, ids[d], q) for i, s, n, d, q in Shard(docs, b).longest(least, ids)]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(zip(*got, strict=True) if got else [[]] * 5, arrow, strict=True)], names=arrow.names)

    best = F.min_by(F.struct("n_words", "doc_id", "doc_word"), F.struct(-F.col("n_words"), F.col("doc_id"), F.col("doc_word")))
    return map_arrow(rows, run, out_schema).groupBy("item_id", "item_word").agg(best.alias("b")).select("item_id", "item_word", "b.*")


def n_hit(hits: str):
    return F.aggregate(F.col(f"{hits}.spans"), F.lit(0).cast("bigint"), lambda a, x: a + x.end - x.begin)


def is_contaminated(hits: str):
    """One document word in twenty or more lies in an occurrence of a window."""
    return (n_hit(hits) > 0) & (n_hit(hits) * 20 >= F.col(f"{hits}.n_words"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns only."""
    hits = fresh(documents, "hits")
    return contamination(documents, benchmark, hits=hits, **options).where(~is_contaminated(hits)).select(*(F.col(f"`{c}`") for c in documents.columns))


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def op10(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return got.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        n_hit("hits").alias("n_hit"),
        F.size("hits.items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "hits.items").cast("binary"), 256).alias("items_sha256"),
        is_contaminated("hits").alias("contaminated"),
    )
