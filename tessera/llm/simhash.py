"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints: lower-cased (A-Z) words, 3-word shingles with repeats, XXH64 of
each with seed 42; a bit is set if it is set in over half of the hashes.

Equal fingerprints collapse first. Over all distinct ones, 64x64 counts of
common bits give means and correlations; correlated bits are put side by side
and the row of bits is cut into partitions. If two fingerprints differ in at
most T bits and m thresholds add up to T - m + 1, some partition differs in at
most its own threshold (-1: not probed). A dynamic program spends that sum
where signatures and estimated candidates cost least: the candidates of
partition i at threshold t are N*N/2 times the chance that two fingerprints
differ there in t bits or less, a beta-binomial law with the mean and variance
that the counts give. A signature is the partition's value with t of its bits
masked out; equal signatures meet in one run of a sorted shuffle, where whole
fingerprints verify. A signature that more than RUN fingerprints share is cut
into parts by hash, and each pair of parts is a run of its own, so no task
holds more. A run puts out a spanning forest of its links, not its pairs, and
components are found from those.

Defined results: null or empty text has fingerprint 0 and links like any
other; a null doc_id takes part, and names a component only if all its ids
are null; repeated rows are copies; an empty table gives an empty table. Of a
group the row stays that is least by doc_id (null first), fingerprint as a
signed number, MD5 of the text (null first) and a hash of all columns; rows
equal in all of these are interchangeable.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, lgamma

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, Files, append, fields, fresh, map_arrow, stage_table, table, workspace
from tessera.llm.components import components

#: Production parameters.
DISTANCE, SHINGLE, HASH_SEED = 3, 3, 42
#: Cost of comparing two fingerprints against that of one signature.
PAIR_COST = 0.02
#: Runs up to this size compare all pairs at once, longer ones spread from node to node.
SQUARE = 2048
#: Fingerprints that one run may have.
RUN = 50_000
_CHUNK = 100_000


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """As a signed 64-bit number."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        spaced = [w + b" " for w in words]
        parts = [spaced[k : len(words) - shingle + 1 + k] for k in range(shingle - 1)]
        grams = list(map(b"".join, zip(*parts, words[shingle - 1 :], strict=True)))
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, len(grams), _CHUNK):
        some = grams[lo : lo + _CHUNK]
        h = np.fromiter((digest(g, HASH_SEED) for g in some), dtype="<u8", count=len(some))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(grams), bitorder="little").view("<i8")[0])


def with_fingerprint(documents: DataFrame, name: str, text: str = "text") -> DataFrame:
    return append(documents, text, fields(f"{name} bigint"), lambda texts: [[fingerprint(t) for t in texts]])


def _bits(x: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64x64 counts of bits set together, over all rows."""
    schema = fields("place int, n double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64))
        n = 0
        for batch in batches:
            x = _bits(batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")).astype(np.float32)
            total += x.T @ x
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097, dtype=np.int32)), pa.array(np.append(total.ravel(), n))], names=["place", "n"])

    sums = np.zeros(4097)
    for r in map_arrow(prints, run, schema).groupBy("place").agg(F.sum("n").alias("n")).collect():
        sums[r.place] = r.n
    return int(sums[4096]), sums[:4096].reshape(64, 64)


def bit_order(n: int, together: np.ndarray) -> list[int]:
    """The bits in a row in which correlated bits are neighbours."""
    p = np.diag(together) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    phi = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(phi, -1)
    row = [int(np.argmax(phi.max(axis=1)))]
    left = set(range(64)) - set(row)
    while left:
        near = phi[row[-4:]].mean(axis=0)
        row.append(max(sorted(left), key=lambda b: near[b]))
        left.discard(row[-1])
    return row


def _chance(bits: list[int], n: int, together: np.ndarray, most: int) -> list[float]:
    """Chance that two fingerprints differ in at most 0..most of these bits."""
    p = np.diag(together) / max(n, 1)
    m = 2 * p - 1
    r = (4 * together - 2 * np.diag(together)[:, None] - 2 * np.diag(together)[None, :] + n) / max(n, 1)
    w, q = len(bits), 2 * p[bits] * (1 - p[bits])
    mean = float(np.clip(q.sum(), 1e-6, w - 1e-6))
    cov = (r[np.ix_(bits, bits)] ** 2 - np.outer(m[bits] ** 2, m[bits] ** 2)) / 4
    var = float((q * (1 - q)).sum() + cov.sum() - np.diag(cov).sum())
    share = mean / w
    spread = np.clip((var / (w * share * (1 - share)) - 1) / max(w - 1, 1), 1e-6, 0.999)
    a, b = share * (1 / spread - 1), (1 - share) * (1 / spread - 1)
    law = [comb(w, k) * np.exp(lgamma(k + a) + lgamma(w - k + b) - lgamma(w + a + b) - lgamma(a) - lgamma(b) + lgamma(a + b)) for k in range(most + 1)]
    return list(np.minimum(np.cumsum(law), 1.0))


def allocate(n: int, together: np.ndarray, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """Partitions with thresholds: [(bits, t)], the cheapest over numbers of partitions and thresholds."""
    row = bit_order(n, together)
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m in range(1, 2 * (distance + 1) + 1):
        parts = [sorted(row[64 * i // m : 64 * (i + 1) // m]) for i in range(m)]
        cost = []
        for bits in parts:
            chance = _chance(bits, n, together, distance)
            cost.append([0.0] + [n * comb(len(bits), t) + PAIR_COST * n * n / 2 * chance[t] for t in range(distance + 1)])
        # spent[s]: least cost of the partitions so far with thresholds t+1 that add up to s
        total = distance - m + 1 + m
        spent: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for c in cost:
            after: dict[int, tuple[float, list[int]]] = {}
            for s, (old, ts) in spent.items():
                for t, x in enumerate(c):
                    if s + t <= total and (s + t not in after or old + x < after[s + t][0]):
                        after[s + t] = (old + x, [*ts, t - 1])
            spent = after
        if total in spent and (best is None or spent[total][0] < best[0]):
            best = (spent[total][0], list(zip(parts, spent[total][1], strict=True)))
    assert best
    return [(bits, t) for bits, t in best[1] if t >= 0]


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(prints: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(key, fp): one row for each fingerprint and each choice of masked bits. A key is a hash; meetings are verified."""
    masks = []
    for bits, t in plan:
        whole = sum(1 << b for b in bits)
        masks += [whole & ~sum(1 << b for b in out) for out in combinations(bits, t)]
    seeds = [int(_mixed(np.array([k + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0]) for k in range(len(masks))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").view("<u8")
            for mask, seed in zip(masks, seeds, strict=True):
                key = _mixed((x & np.uint64(mask)) ^ np.uint64(seed))
                yield pa.RecordBatch.from_arrays([pa.array(key.view("<i8")), pa.array(x.view("<i8"))], names=["key", "fp"])

    return map_arrow(prints, run, fields("key bigint, fp bigint"))


def _spread(x: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of a long run: each node is compared with those not reached yet."""
    a, b = [], []
    left = x
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            p = queue.pop()
            near = np.bitwise_count(left ^ p) <= distance
            if near.any():
                new = left[near]
                a.append(np.full(len(new), p))
                b.append(new)
                queue.extend(new)
                left = left[~near]
    empty = np.zeros(0, x.dtype)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def _square(x: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """x: runs of one length, one a row. Their links; of a row with more links than nodes only a star on each component."""
    rows, size = x.shape
    i, j = np.triu_indices(size, 1)
    out_a, out_b = [], []
    step = max(1, 2_000_000 // max(1, len(i)))
    for lo in range(0, rows, step):
        part = x[lo : lo + step]
        r, k = np.nonzero(np.bitwise_count(part[:, i] ^ part[:, j]) <= distance)
        links = np.bincount(r, minlength=len(part))
        plain = links[r] <= size
        out_a.append(part[r[plain], i[k[plain]]])
        out_b.append(part[r[plain], j[k[plain]]])
        for d in np.flatnonzero(links > size):
            own = k[r == d]
            label = np.arange(size)
            while True:
                old = label.copy()
                np.minimum.at(label, i[own], label[j[own]])
                np.minimum.at(label, j[own], label[i[own]])
                if (old == label).all():
                    break
            own = np.flatnonzero(label != np.arange(size))
            out_a.append(part[d, label[own]])
            out_b.append(part[d, own])
    return np.concatenate(out_a), np.concatenate(out_b)


def run_links(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of all runs: x[starts[k]:starts[k]+sizes[k]] share a key."""
    out = [(np.zeros(0, x.dtype), np.zeros(0, x.dtype))]
    for size in np.unique(sizes[(sizes > 1) & (sizes <= SQUARE)]):
        at = starts[sizes == size]
        out.append(_square(x[at[:, None] + np.arange(size)], distance))
    for k in np.flatnonzero(sizes > SQUARE):
        out.append(_spread(x[starts[k] : starts[k] + sizes[k]], distance))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def split_runs(signed: DataFrame, most: int = RUN) -> DataFrame:
    """(key, fp) with other keys for those that more than ``most`` rows share: all pairs of parts of at most half as many."""
    counts = signed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most)
    hot = stage_table(counts.select("key", F.ceil(F.col("n") * 2 / most).cast("int").alias("parts")), "hot-keys")
    if hot.isEmpty():
        return signed
    both = signed.join(hot, "key", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    halves = both.where("parts is not null").select("key", "fp", own.alias("own"), other.alias("other"))
    salted = halves.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp")
    return both.where("parts is null").select("key", "fp").unionByName(salted)


def links_of(prints: DataFrame, distance: int = DISTANCE, run: int = RUN) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect all pairs within the distance."""
    n, together = bit_counts(prints)
    plan = allocate(n, together, distance)
    schema = fields("a bigint, b bigint")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints = [], []

        def close(k: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, int)
            a, b = run_links(x, cut, np.diff(np.append(cut, len(k))), distance)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0).view("<i8")
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys.append(batch.column(0).to_numpy(zero_copy_only=False))
            prints.append(batch.column(1).to_numpy(zero_copy_only=False).astype("<i8").view("<u8"))
            held += batch.num_rows
            if held >= 200_000 and keys[-1][-1] != keys[0][0]:  # the last key's run may go on
                k, x = np.concatenate(keys), np.concatenate(prints)
                last = int(np.searchsorted(k, k[-1]))
                yield close(k[:last], x[:last])
                keys, prints, held = [k[last:]], [x[last:]], len(k) - last
        if keys:
            yield close(np.concatenate(keys), np.concatenate(prints))

    met = split_runs(signatures(prints, plan), run).repartition("key").sortWithinPartitions("key", "fp")
    return map_arrow(met, meet, schema).distinct()


def groups_of(prints: DataFrame, least, distance: int = DISTANCE) -> tuple[DataFrame, DataFrame]:
    """prints: rows with fp; least: an order of rows. (fp, root) of each distinct fingerprint, and (root, least) of each component."""
    distinct = stage_table(prints.groupBy("fp").agg(F.min(least).alias("least")), "distinct")
    roots = components(links_of(distinct.select("fp"), distance)).withColumnRenamed("node", "fp")
    linked = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return linked.select("fp", "root"), linked.groupBy("root").agg(F.min("least").alias("least"))


def near_duplicates(documents: DataFrame, *, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp, component_id of each row of documents (doc_id, text)."""
    rows = stage_table(with_fingerprint(documents.select(F.col("doc_id").cast("bigint"), "text"), "fp").select("doc_id", "fp"), "prints")
    linked, smallest = groups_of(rows, F.col("doc_id"), distance)
    return rows.join(linked.join(smallest, "root").select("fp", F.col("least").alias("component_id")), "fp").select("doc_id", "fp", "component_id")


def deduplicate(documents: DataFrame, *, distance: int = DISTANCE) -> DataFrame:
    """One row of each component stays, with its own columns only.

    Rows lie in the shared folder with their fingerprints; only ids and
    fingerprints are shuffled. The places of the rows that stay are written
    beside each file, and a scan of the files picks them out.
    """
    fp = fresh(documents, "fp_of_text")
    rows = stage_table(with_fingerprint(documents, fp), "dedup-texts")
    file, at = rows.metadataColumn("_metadata")["file_path"], rows.metadataColumn("_metadata")["row_index"]
    every = F.xxhash64(*(F.col(f"`{c}`") for c in documents.columns))
    keys = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(f"`{fp}`").alias("fp"), F.md5(F.col("text").cast("binary")).alias("text"), every.alias("row"), file.alias("file"), at.alias("at"))
    least = groups_of(keys, F.struct("doc_id", "fp", "text", "row", "file", "at"), distance)[1]
    folder = workspace(documents.sparkSession, "dedup-kept")
    done = fields("file string")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, name, parts = Files(folder), None, []

        def close() -> pa.RecordBatch:
            files.write(name.rpartition("/")[2], [np.sort(np.concatenate(parts)).astype("<i8").tobytes()])
            return pa.RecordBatch.from_arrays([pa.array([name])], names=["file"])

        for batch in batches:
            names = batch.column(0).to_pylist()
            cut = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
            for lo, hi in zip(cut, cut[1:], strict=False):
                if lo == hi:
                    continue
                if names[lo] != name and parts:
                    yield close()
                    parts = []
                name = names[lo]
                parts.append(batch.column(1).slice(lo, hi - lo).to_numpy())
        if parts:
            yield close()

    kept = least.select("least.file", "least.at").repartition("file").sortWithinPartitions("file")
    stage_table(map_arrow(kept, write, done), "dedup-files")
    there, place = fresh(rows, "file_of_row"), fresh(rows, "place_of_row")
    scan = rows.withColumn(there, file).withColumn(place, at).drop(fp)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, name, stay = Files(folder), None, np.zeros(0, np.int64)
        for batch in batches:
            names = batch.column(batch.num_columns - 2).dictionary_encode()
            places, own = batch.column(batch.num_columns - 1).to_numpy(), names.indices.to_numpy()
            keep = np.zeros(batch.num_rows, dtype=bool)
            for k, x in enumerate(names.dictionary.to_pylist()):
                if x != name:
                    name, stay = x, np.frombuffer(files.read_if(x.rpartition("/")[2]), "<i8")
                keep |= (own == k) & np.isin(places, stay)
            yield batch.select(range(batch.num_columns - 2)).filter(pa.array(keep))

    return map_arrow(scan, pick, documents.schema).toDF(*documents.columns)


def op7(spark, sf_dir: str) -> DataFrame:
    got = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
