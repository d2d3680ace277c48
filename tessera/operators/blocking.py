"""Candidate generation: postings, pruning of frequent keys, key joins, ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import blocking_keys as K
from tessera.functions import text as X
from tessera.functions.similarity import word_grams
from tessera.session import ship, stage_table
from tessera.sources.sinks import merge_ranked

MAX_KEY_FREQUENCY, TOP_K = 500, 20
#: Postings that each prefix rule reads of a key, in order of entity_id.
PREFIX_LIMITS = {"k1": 20, "k2": 10, "k3": 10}
#: Candidates of each rule by n-gram cosine; rows with under FEW in all get FALLBACK_TOP_K more by dense vectors.
RULE_TOP_K, FEW, FALLBACK_TOP_K = {"k1": 60, "k2": 30, "k3": 30, "k4": 20}, 5, 30
PREFIX_KEY = ["rule", "country_key", "bkey"]
#: Rows of a block that are compared at once.
BLOCK = 1024


def prune_frequent(postings: DataFrame, cap: int = MAX_KEY_FREQUENCY) -> DataFrame:
    """Postings of keys that have at most ``cap`` of them. Hot keys, which would skew the join, go here.

    Counts are combined before the shuffle; the semi-join keeps no second copy of the postings in memory.
    """
    kept = postings.groupBy("bkey").count().where(F.col("count") <= cap).select("bkey")
    return postings.join(kept, "bkey", "left_semi")


def compact_candidates(s1: DataFrame, pool: DataFrame, *, cap: int = MAX_KEY_FREQUENCY, top_k: int = TOP_K, strict: bool = True) -> DataFrame:
    """s1_id, cand_id, matched_rules, has_exact_rule, rank: the best ``top_k`` by exact rule, number of rules and cand_id.

    Only ids are joined and ranked; attributes are fetched for the winners afterwards.
    """
    return rank_by_rules(s1, postings_of(pool, cap=cap, strict=strict), top_k=top_k, strict=strict)


def postings_of(pool: DataFrame, *, cap: int = MAX_KEY_FREQUENCY, strict: bool = True) -> DataFrame:
    """entity_id, rule_id, bkey of the pool, without frequent keys."""
    return prune_frequent(K.compact_keys(K.with_compact_columns(pool), strict=strict), cap)


def rank_by_rules(s1: DataFrame, postings: DataFrame, *, top_k: int = TOP_K, strict: bool = True) -> DataFrame:
    """As compact_candidates, against postings that are there already."""
    keys = K.compact_keys(K.with_compact_columns(s1), strict=strict).select(F.col("entity_id").alias("s1_id"), "bkey").distinct()
    hits = keys.join(postings, "bkey").groupBy("s1_id", F.col("entity_id").alias("cand_id")).agg(
        F.countDistinct("rule_id").alias("matched_rules"), F.max(F.col("rule_id").isin(1, 2).cast("int")).alias("has_exact_rule")
    )
    order = Window.partitionBy("s1_id").orderBy(F.desc("has_exact_rule"), F.desc("matched_rules"), "cand_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def prefix_candidates(s1: DataFrame, pool: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """s1_id, cand_id, rank: the first postings of each prefix key, united, by rule and order of the posting.

    The cut is made on the posting side before the join, so pairs are bounded by the sum of limits for each S1 row.
    """
    limits = limits or PREFIX_LIMITS
    most = F.element_at(F.create_map(*(F.lit(x) for kv in limits.items() for x in kv)), F.col("rule"))
    order = Window.partitionBy("rule", "country_key", "bkey").orderBy("entity_id")
    postings = K.prefix_keys(K.with_normal_columns(pool)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.lit(max(limits.values()))).where(F.col("place") <= most)
    probes = K.prefix_keys(K.with_normal_columns(s1)).withColumnRenamed("entity_id", "s1_id")
    met = probes.join(postings, ["rule", "country_key", "bkey"])
    best = met.groupBy("s1_id", F.col("entity_id").alias("cand_id")).agg(F.min(F.struct("rule", "place")).alias("b"))
    by = Window.partitionBy("s1_id").orderBy("b.rule", "b.place", "cand_id")
    return best.select("s1_id", "cand_id", F.row_number().over(by).alias("rank"))


def with_attributes(candidates: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """Names, addresses and countries of both sides; pairs with an unknown side are dropped."""

    def side(df: DataFrame, prefix: str, key: str) -> DataFrame:
        return df.select(F.col("entity_id").alias(key), F.col("business_name").alias(f"{prefix}_name"), F.col("business_address").alias(f"{prefix}_addr"), F.col("country").alias(f"{prefix}_country"))

    return candidates.join(side(s1, "s1", "s1_id"), "s1_id").join(side(pool, "cand", "cand_id"), "cand_id")


def few_candidates(s1: DataFrame, candidates: DataFrame, least: int = FEW) -> DataFrame:
    """s1_id, n of reference rows with fewer than ``least`` candidates."""
    counts = candidates.groupBy("s1_id").count()
    return s1.select(F.col("entity_id").alias("s1_id")).join(counts, "s1_id", "left").select("s1_id", F.coalesce("count", F.lit(0)).alias("n")).where(F.col("n") < least)


def _large(rows: DataFrame, block: int) -> DataFrame:
    """Keys of more than ``block`` rows, and into how many chunks they are cut: at most 1/block of the rows."""
    return rows.groupBy(*PREFIX_KEY).count().where(F.col("count") > block).select(*PREFIX_KEY, F.ceil(F.col("count") / block).cast("int").alias("n"))


def _chunks(rows: DataFrame, own: DataFrame, other: DataFrame, chunk: str, met: str, held: str) -> DataFrame:
    """Rows of a key in chunks by hash of entity_id, each once for every chunk of the other side."""
    n = F.coalesce("n", F.lit(1))
    placed = rows.join(F.broadcast(own), PREFIX_KEY, "left").withColumn(chunk, F.pmod(F.xxhash64("entity_id"), n).cast("int"))
    packed = placed.groupBy(*PREFIX_KEY, chunk).agg(F.collect_list(F.struct("entity_id", "match")).alias(held))
    return packed.join(F.broadcast(other), PREFIX_KEY, "left").select(*PREFIX_KEY, chunk, F.explode(F.sequence(F.lit(0), n - 1)).alias(met), held)


def nearest_texts(probes: list[str], targets: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k targets nearest by n-gram cosine, ties by place, and scores, one row for each probe."""
    grams = [word_grams(t) for t in targets]
    number: dict[str, int] = {}
    flat = np.array([number.setdefault(g, len(number)) for c in grams for g in c], dtype=np.int64)
    counts = np.array([n for c in grams for n in c.values()], dtype=np.float64)
    order = np.argsort(flat, kind="stable")
    rows, counts = np.repeat(np.arange(len(targets)), [len(c) for c in grams])[order], counts[order]
    edge = np.searchsorted(flat[order], np.arange(len(number) + 1))
    norms = np.array([sum(v * v for v in c.values()) ** 0.5 for c in grams])
    k = min(k, len(targets))
    best, scores = np.zeros((len(probes), k), np.int64), np.zeros((len(probes), k))
    for i, text in enumerate(probes):
        c = word_grams(text)
        known = [(number[g], n) for g, n in c.items() if g in number]
        score = np.zeros(len(targets))
        if known:
            at = np.concatenate([np.arange(edge[g], edge[g + 1]) for g, _ in known])
            weight = np.repeat([n for _, n in known], [edge[g + 1] - edge[g] for g, _ in known])
            dot = np.bincount(rows[at], counts[at] * weight, len(targets))
            size = sum(v * v for v in c.values()) ** 0.5 * norms
            np.divide(dot, size, out=score, where=size > 0)
        score = np.round(score, 9)
        best[i] = np.argsort(-score, kind="stable")[:k]
        scores[i] = score[best[i]]
    return best, scores


def cosine_candidates(s1: DataFrame, pool: DataFrame, top_k: dict[str, int] | None = None, *, block: int = BLOCK) -> DataFrame:
    """s1_id, cand_id, rank: within each prefix rule's block the nearest by n-gram cosine of name and address, rules in order.

    Blocks are ranked whole. They are cut into chunks of about ``block`` rows on both sides; chunks meet in one task each and give the
    rule's number of candidates for each probe, and a window merges them.
    """
    top_k = top_k or RULE_TOP_K
    ship(s1.sparkSession)

    def keyed(df: DataFrame) -> DataFrame:
        n = K.with_normal_columns(df)
        texts = n.select("entity_id", X.match_text(F.col("name_norm"), F.col("addr_norm")).alias("match"))
        return K.prefix_keys(n, second_word=True).where(F.col("rule").isin(*top_k)).dropna(subset=PREFIX_KEY).join(texts, "entity_id")

    probes, postings = keyed(s1), keyed(pool)
    many, most = _large(probes, block), _large(postings, block)
    left, right = _chunks(probes, many, most, "s1_chunk", "chunk", "probes"), _chunks(postings, most, many, "chunk", "s1_chunk", "targets")
    cells = left.join(right, [*PREFIX_KEY, "s1_chunk", "chunk"]).select("rule", "probes", "targets")
    schema = T.StructType([T.StructField("rule", T.StringType()), T.StructField("s1_id", T.StringType()), T.StructField("cand_id", T.StringType()), T.StructField("score", T.DoubleType())])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rule, p, t in zip(*batch.columns, strict=True):
                rule = rule.as_py()
                p, t = p.as_py(), sorted(t.as_py(), key=lambda r: r["entity_id"])
                best, score = nearest_texts([r["match"] or "" for r in p], [r["match"] or "" for r in t], top_k[rule])
                ids = np.array([r["entity_id"] for r in t], dtype=object)
                yield pa.RecordBatch.from_arrays([pa.array([rule] * best.size, pa.string()), pa.array(np.repeat(np.array([r["entity_id"] for r in p], dtype=object), best.shape[1]), pa.string()), pa.array(ids[best].ravel(), pa.string()), pa.array(score.ravel())], names=schema.names)

    scored = cells.mapInArrow(nearest, schema)
    most_of = F.element_at(F.create_map(*(F.lit(x) for kv in top_k.items() for x in kv)), F.col("rule"))
    ranked = scored.withColumn("place", F.row_number().over(Window.partitionBy("s1_id", "rule").orderBy(F.desc("score"), "cand_id"))).where(F.col("place") <= most_of)
    best = ranked.groupBy("s1_id", "cand_id").agg(F.min(F.struct("rule", "place")).alias("b"))
    return best.select("s1_id", "cand_id", F.row_number().over(Window.partitionBy("s1_id").orderBy("b.rule", "b.place", "cand_id")).alias("rank"))


def dense_candidates(s1: DataFrame, pool: DataFrame, k: int = FALLBACK_TOP_K, *, embedder=None) -> DataFrame:
    """s1_id, cand_id, score, rank: the k nearest by inner product of embedded names and addresses, inside the first prefix rule's block."""
    from tessera.operators import vectors as N

    def side(df: DataFrame) -> DataFrame:
        n = K.with_normal_columns(df).withColumns({"match": X.match_text(F.col("name_norm"), F.col("addr_norm")), "key": K.name_prefix(F.col("name_norm"))})
        coded = N.encode(n, "match", **({"embedder": embedder} if embedder else {}))
        return coded.select(F.col("entity_id").alias("id"), F.concat_ws("|", "country_key", "key").alias("part"), F.col("embedding").alias("vec"))

    return N.top_k(side(s1), side(pool), k).select(F.col("q_id").alias("s1_id"), F.col("t_id").alias("cand_id"), "score", "rank")


def four_key_candidates(s1: DataFrame, pool: DataFrame, *, least: int = FEW, fallback: int = FALLBACK_TOP_K) -> DataFrame:
    """s1_id, cand_id, rank: cosine_candidates, and for rows with fewer than ``least`` of them dense_candidates after these."""
    lexical = stage_table(cosine_candidates(s1, pool), "lexical")
    few = few_candidates(s1, lexical, least).select(F.col("s1_id").alias("entity_id"))
    more = dense_candidates(s1.join(few, "entity_id", "left_semi"), pool, fallback)
    every = lexical.select("s1_id", "cand_id", F.lit(0).alias("stage"), "rank").unionByName(more.select("s1_id", "cand_id", F.lit(1).alias("stage"), "rank"))
    return merge_ranked(every)
