"""Metrics of links against truth: one pass of conditional sums over outer-joined links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BETA2 = 0.25
TAUS_C = tuple(round(0.20 + 0.02 * i, 2) for i in range(34))
TAUS_H = tuple(round(0.35 + 0.05 * i, 2) for i in range(10))


def f_half(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, (1 + BETA2) * p * r / F.nullif(BETA2 * p + r, F.lit(0.0))).otherwise(0.0)


def per_entity(truth: DataFrame, predicted: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Counts for each S1 of truth: n_true, n_pred, tp, cand_tp, outside (predictions that are no candidates), and p, r, f.

    truth: s1_id, cand_id (null: none). A singleton counts 1 without predictions and 0 with any.
    """
    ids = truth.select("s1_id").distinct()
    t = truth.where("cand_id is not null").select("s1_id", "cand_id").distinct().withColumn("t", F.lit(1))
    p = predicted.select("s1_id", "cand_id").distinct().withColumn("p", F.lit(1))
    links = t.join(p, ["s1_id", "cand_id"], "full")
    if candidates is None:
        links = links.withColumn("c", F.lit(None).cast("int"))
    else:
        links = links.join(candidates.select("s1_id", "cand_id").distinct().withColumn("c", F.lit(1)), ["s1_id", "cand_id"], "left")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    one = lambda c: F.col(c).isNotNull()
    sums = links.groupBy("s1_id").agg(
        n(one("t")).alias("n_true"), n(one("p")).alias("n_pred"), n(one("t") & one("p")).alias("tp"), n(one("t") & one("c")).alias("cand_tp"),
        n(one("p") & ~one("c")).alias("outside"), n(one("t") & one("c") & ~one("p")).alias("rejected"),
    )
    e = ids.join(sums, "s1_id", "left").na.fill(0)
    single = F.col("n_true") == 0
    right = (F.col("n_pred") == 0).cast("double")
    precision = F.when(F.col("n_pred") > 0, F.col("tp") / F.nullif("n_pred", F.lit(0))).otherwise(0.0)
    recall = F.when(F.col("n_true") > 0, F.col("tp") / F.nullif("n_true", F.lit(0))).otherwise(0.0)
    e = e.withColumns({"p": F.when(single, right).otherwise(precision), "r": F.when(single, right).otherwise(recall)})
    return e.withColumn("f", F.when(single, right).otherwise(f_half(F.col("p"), F.col("r"))))


def macro_f05(truth: DataFrame, predicted: DataFrame, countries: DataFrame) -> DataFrame:
    """Means of precision, recall and F0.5 for each country and over all (country null). countries: s1_id, country."""
    e = per_entity(truth, predicted).join(countries, "s1_id", "left")
    return e.rollup("country").agg(F.count("*").alias("n"), F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg("f").alias("f05"))


def report(truth: DataFrame, predicted: DataFrame, candidates: DataFrame) -> DataFrame:
    """All measures in one row."""
    e = per_entity(truth, predicted, candidates)
    single = F.col("n_true") == 0
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    share = lambda a, b, none: F.when(b > 0, a / F.nullif(b, F.lit(0))).otherwise(F.lit(none))
    links, singles = total("n_true"), total(single.cast("int"))
    return e.agg(
        F.avg("f").alias("macro_f05"), F.avg("p").alias("macro_precision"), F.avg("r").alias("macro_recall"),
        share(total((single & (F.col("n_pred") == 0)).cast("int")), singles, 1.0).alias("singleton_accuracy"),
        F.coalesce(F.avg(F.when(~single, F.col("f"))), F.lit(0.0)).alias("non_singleton_f05"),
        share(total("cand_tp"), links, 1.0).alias("candidate_recall"), share(total("tp"), links, 1.0).alias("prediction_recall"),
        F.count("*").alias("total_entities"), singles.cast("bigint").alias("singletons"), links.cast("bigint").alias("true_links"),
        total(F.col("n_true") - F.col("cand_tp")).cast("bigint").alias("blocking_misses"), total("rejected").cast("bigint").alias("model_rejections"),
        total(F.col("n_pred") - F.col("tp")).cast("bigint").alias("false_positives"), total((F.col("outside") > 0).cast("int")).cast("bigint").alias("subset_violations"),
    )


def recall_report(truth: DataFrame, candidates: DataFrame, countries: DataFrame) -> DataFrame:
    """Ceiling of recall by country and over all (country null)."""
    e = per_entity(truth, candidates).join(countries, "s1_id", "left")
    many = F.col("n_true") > 0
    return e.rollup("country").agg(
        F.count("*").alias("n_entities"), F.sum("n_true").alias("total_links"), F.sum("tp").alias("retrieved_links"),
        F.when(F.sum("n_true") > 0, F.sum("tp") / F.nullif(F.sum("n_true"), F.lit(0))).otherwise(1.0).alias("link_recall"),
        F.sum((many & (F.col("tp") == F.col("n_true"))).cast("bigint")).alias("full_recall"), F.sum(many.cast("bigint")).alias("with_matches"),
        F.sum((~many & (F.col("n_pred") > 0)).cast("bigint")).alias("singletons_with_candidates"),
        F.avg("n_pred").alias("mean_candidates"), F.percentile("n_pred", F.lit(0.5)).alias("median_candidates"), F.max("n_pred").alias("max_candidates"),
        F.sum((F.col("n_pred") == 0).cast("bigint")).alias("empty_entities"),
    )


def candidate_stats(required: DataFrame, candidates: DataFrame) -> DataFrame:
    """Totals, and the values at floor(q * n) of the sorted counts, found from the histogram of counts: no global sort of entities."""
    per = required.select("s1_id").distinct().join(candidates.groupBy("s1_id").count(), "s1_id", "left").select(F.coalesce("count", F.lit(0)).alias("n"))
    h = per.groupBy("n").agg(F.count("*").alias("times"))
    w = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumns({"upto": F.sum("times").over(w), "total": F.sum("times").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.lit(q) * F.col("total")), F.col("n")))
    return h.agg(
        F.sum("times").alias("total_s1"), F.sum(F.col("n") * F.col("times")).alias("total_candidates"), F.round(F.sum(F.col("n") * F.col("times")) / F.sum("times"), 2).alias("avg_candidates"),
        at(0.50).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.sum(F.when(F.col("n") == 0, F.col("times")).otherwise(0)).alias("without"),
    )


def threshold_sweep(truth: DataFrame, scored: DataFrame, countries: DataFrame, taus: tuple[float, ...] = TAUS_H, *, exclusive: bool = True) -> DataFrame:
    """country, tau, f05, best: the mean F0.5 of each threshold and the first best of each country.

    exclusive: a candidate counts only for the S1 where it scores highest, as in assignment.
    Each S1's scores are reduced to counts per threshold before any cross with entities: rows are S1 times thresholds.
    """
    from tessera.operators.assignment import claim, label_pairs

    rows = label_pairs(claim(scored) if exclusive else scored, truth).select("s1_id", "prob", "label")
    tau = F.explode(F.array(*map(F.lit, taus))).alias("tau")
    ids = truth.groupBy("s1_id").agg(F.count("cand_id").alias("n_true")).join(countries, "s1_id", "left")
    hits = rows.select("s1_id", "prob", "label", tau).where(F.col("prob") >= F.col("tau")).groupBy("s1_id", "tau").agg(F.count("*").alias("n_pred"), F.sum("label").alias("tp"))
    e = ids.select("*", tau).join(hits, ["s1_id", "tau"], "left").na.fill(0, ["n_pred", "tp"])
    p = F.when(F.col("n_pred") > 0, F.col("tp") / F.nullif("n_pred", F.lit(0))).otherwise(0.0)
    r = F.when(F.col("n_true") > 0, F.col("tp") / F.nullif("n_true", F.lit(0))).otherwise(0.0)
    f = F.when(F.col("n_true") == 0, (F.col("n_pred") == 0).cast("double")).otherwise(f_half(p, r))
    means = e.groupBy("country", "tau").agg(F.round(F.avg(f), 9).alias("f05"))
    order = Window.partitionBy("country").orderBy(F.desc("f05"), "tau")
    return means.withColumn("best", F.row_number().over(order) == 1)
