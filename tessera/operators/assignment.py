"""Labels, sampling, thresholds and assignment of candidates to reference records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import fresh
from tessera.sources.records import with_ordinal

DEFAULT_THRESHOLD, RESCUE_SCORE, RESCUE_SIMILARITY, NEGATIVES = 0.80, 0.25, 0.85, 3


def label_pairs(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """pairs with label 1 where truth (s1_id, cand_id) has the pair, else 0."""
    t = fresh(pairs, "linked")
    links = truth.where("cand_id is not null").select("s1_id", "cand_id").distinct().withColumn(t, F.lit(1))
    return pairs.join(links, ["s1_id", "cand_id"], "left").withColumn("label", F.coalesce(t, F.lit(0))).drop(t)


def hard_negatives(labelled: DataFrame, ratio: int = NEGATIVES, order: str = "rank") -> DataFrame:
    """All positives, and of each S1 the first max(1, ratio * positives) negatives by ``order`` and cand_id."""
    p, n = fresh(labelled, "positives"), fresh(labelled, "place")
    rows = labelled.withColumn(p, F.sum("label").over(Window.partitionBy("s1_id")))
    rows = rows.withColumn(n, F.row_number().over(Window.partitionBy("s1_id", "label").orderBy(order, "cand_id")))
    return rows.where((F.col("label") == 1) | (F.col(n) <= F.greatest(F.lit(1), ratio * F.col(p)))).drop(p, n)


def _first(df: DataFrame, window) -> DataFrame:
    """The first row of each window."""
    n = fresh(df, "place")
    return df.withColumn(n, F.row_number().over(window)).where(F.col(n) == 1).drop(n)


def stratified_split(records: DataFrame, share: float = 0.8) -> DataFrame:
    """entity_id, country, split: the first ceil(share * n) of each country by hash of the id train, the rest validate.

    Rows are numbered over all countries in ranges, so no country is one task; null is a country of its own.
    """
    keyed = records.select("entity_id", "country", F.struct("country", F.md5(F.col("entity_id").cast("binary")), "entity_id").alias("key"))
    rows = with_ordinal(keyed, "key")
    sizes = rows.groupBy(F.col("country").alias("c")).agg(F.min("ordinal").alias("first"), F.count("*").alias("n"))
    placed = rows.join(sizes, F.col("country").eqNullSafe(F.col("c")))
    return placed.select("entity_id", "country", F.when(F.col("ordinal") - F.col("first") < F.ceil(F.col("n") * share), "train").otherwise("validation").alias("split"))


def class_weights(labelled: DataFrame) -> DataFrame:
    """label, n, weight = all / (2 * n)."""
    per = labelled.groupBy("label").agg(F.count("*").alias("n"))
    total = labelled.agg(F.count("*").alias("total"))
    return per.join(F.broadcast(total)).select("label", "n", (F.col("total") / (2 * F.col("n"))).alias("weight"))  # one row


def over_threshold(scored: DataFrame, thresholds: DataFrame | None = None, default: float = DEFAULT_THRESHOLD) -> DataFrame:
    """scored (s1_id, cand_id, prob, country) rows at or over their country's threshold. thresholds: country, threshold."""
    if thresholds is None:
        return scored.where(F.col("prob") >= default)
    return scored.join(thresholds, "country", "left").where(F.col("prob") >= F.coalesce("threshold", F.lit(default))).drop("threshold")


def claim(scored: DataFrame) -> DataFrame:
    """Each candidate to the S1 with the highest prob, ties to the smaller s1_id.

    Only candidates are exclusive, so the greedy order by prob gives the same as the best row of each candidate.
    """
    return _first(scored, Window.partitionBy("cand_id").orderBy(F.desc("prob"), "s1_id"))


def best_candidate(scored: DataFrame) -> DataFrame:
    """The first candidate of the highest prob of each S1."""
    return _first(scored, Window.partitionBy("s1_id").orderBy(F.desc("prob"), "cand_id"))


def rescue(scored: DataFrame, claimed: DataFrame, *, least: float = RESCUE_SCORE, similar: float = RESCUE_SIMILARITY) -> DataFrame:
    """Second stage, after all claims: S1 without a claim get their best candidate if its prob and name similarity suffice and nobody has it.

    scored: with similarity. One candidate goes to the smallest s1_id that asks.
    """
    asking = best_candidate(scored.join(claimed.select("s1_id").distinct(), "s1_id", "left_anti"))
    free = asking.where((F.col("prob") >= least) & (F.col("similarity") >= similar)).join(claimed.select("cand_id"), "cand_id", "left_anti")
    return _first(free, Window.partitionBy("cand_id").orderBy("s1_id"))


def by_prob():
    """A window over each S1 in falling order of prob."""
    return Window.partitionBy("s1_id").orderBy(F.desc("prob"), "cand_id")
