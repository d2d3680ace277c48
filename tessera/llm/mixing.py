"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: sources in order of code points (null last) weigh 5, 2, 1 and so on;
together they get SHARE of all words; a target above CAP times its source's
size stops there and the excess goes to the others by weight. With sources
sorted by size over weight the capped ones come first, so prefix sums over
the table of sources give the level in one step, without iteration.

Draw: a document of quality weight w and uniform u (a hash of seed, doc_id
and text) has the exponential key -ln(u)/w; sorted by key within its source
and prefix-summed, the documents up to the budget are a weighted sample
without replacement. Complete epochs come first: every document is taken
floor(target/size) times, the draw spends what is left, and its last document
is taken if that brings the sum nearer to the target.

Scale: one source may hold a third of all rows, so no window covers a source.
Keys fall into buckets by their logarithm: a weight only shifts it, and where
it lies densest, a step of BUCKET_ROWS / n has 0.37 of BUCKET_ROWS rows of n,
whatever the weights. Bucket sums are prefix-summed in a small table and each
bucket is sorted on its own. Only (doc_id, source, size, key) is shuffled.

Defined results: null text has no words; a document of size 0 is taken 0
words; null source is a source of its own; repeated rows are rows of their
own; null or non-positive weight: the weight of an unlabelled document. Empty table: empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import fresh, stage_table, table

#: Production parameters.
SHARE, CAP, CYCLE = 1.5, 2, (5, 2, 1)
BUCKET_ROWS = 2_000
SEED = "mix-1"
#: Quality weights by label; 1 without one.
GOOD, POOR, PLAIN = 2.0, 0.5, 1.0


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def text_hash(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def source_targets(sizes: DataFrame, *, share: float = SHARE, cap: float = CAP, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """source, source_size, n_rows -> with weight and target. One row per source in and out."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, cycle)), ((F.row_number().over(order) - 1) % len(cycle) + 1).cast("int"))
    t = sizes.withColumn("weight", w.cast("bigint")).withColumn("sid", F.row_number().over(order))
    level = F.col("source_size") / F.col("weight")
    by = Window.orderBy(level, F.col("source").isNull(), "source")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("total", F.sum("source_size").over(everything)).withColumn("weights", F.sum("weight").over(everything))
    # if all sources before this one are capped, the rest share this much for each unit of weight
    rest = (F.lit(share) * F.col("total") - F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    t = t.withColumn("rest", rest).withColumn("capped", F.col("rest") * F.col("weight") >= F.lit(cap) * F.col("source_size"))
    # the first source below its cap fixes the level
    first = F.min_by(F.when(~F.col("capped"), F.col("rest")), F.when(~F.col("capped"), F.struct(level, F.col("source").isNull(), "source"))).over(everything)
    target = F.when(F.col("capped"), (F.lit(cap) * F.col("source_size")).cast("double")).otherwise(F.col("level") * F.col("weight"))
    return t.withColumn("level", first).withColumn("target", target).select("source", "sid", "source_size", "n_rows", "weight", "target")


def mix(documents: DataFrame, weights: DataFrame | None = None, *, seed: str = SEED, bucket_rows: int = BUCKET_ROWS, **shares) -> DataFrame:
    """doc_id, row_hash, source, size, source_size, target, epochs (times the row is taken), taken (words).

    documents: doc_id, text, source (others ignored). weights: doc_id, weight.
    row_hash is a hash of the row's text; equal rows get equal values but may differ in epochs.
    """
    rows = documents.select("doc_id", "source", text_hash(F.col("text")).alias("row_hash"), n_words(F.col("text")).alias("size"))
    if weights is not None:
        one = weights.groupBy("doc_id").agg(F.max("weight").cast("double").alias("weight"))
        rows = rows.join(one, "doc_id", "left")
    else:
        rows = rows.withColumn("weight", F.lit(None).cast("double"))
    w = F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.lit(PLAIN))
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string"), "row_hash").cast("binary")), 1, 13), 16, 10).cast("double")
    rows = rows.withColumn("key", -F.log((bits + 0.5) / F.lit(float(2**52))) / w)
    rows = stage_table(rows.select("doc_id", "row_hash", "source", "size", "key"), "mix-rows")
    sources = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")), **shares)
    sources = stage_table(sources, "mix-sources")
    s = sources.select(F.col("source").alias("s"), "sid", "source_size", "target", "n_rows")
    rows = rows.join(s, rows.source.eqNullSafe(s.s)).drop("s")
    rows = rows.withColumn("bucket", F.floor(F.log("key") * F.ceil(F.col("n_rows") / bucket_rows)).cast("bigint"))
    sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("ahead"))
    rows = rows.join(sums, ["sid", "bucket"])
    inside = Window.partitionBy("sid", "bucket").orderBy("key", "doc_id", "row_hash").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    budget = F.col("target") - full * F.col("source_size")
    drawn = (F.col("ahead") + F.col("size") / 2 <= budget) & (budget > 0)
    epochs = (full + drawn.cast("int")).cast("bigint")
    return rows.withColumn("epochs", epochs).select("doc_id", "row_hash", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size")).alias("taken"))


def mixed_documents(documents: DataFrame, weights: DataFrame | None = None, **options) -> DataFrame:
    """documents with each row as many times as the mix takes it, with their own columns only."""
    d, h, m, t, k, times = (fresh(documents, x) for x in ("mix_id", "mix_hash", "mix_rows", "mix_times", "mix_rank", "mix_of_row"))
    taken = mix(documents, weights, **options).groupBy(F.col("doc_id").alias(d), F.col("row_hash").alias(h)).agg(F.count("*").alias(m), F.sum("epochs").alias(t)).where(F.col(t) > 0)
    rows = documents.join(taken, F.col("doc_id").eqNullSafe(F.col(d)) & (text_hash(F.col("text")) == F.col(h)))
    # rows that agree in doc_id and text share what the mix takes of them
    rank = F.row_number().over(Window.partitionBy(d, h).orderBy(d))
    shared = rows.where(F.col(m) > 1).withColumn(k, rank).withColumn(times, F.floor(F.col(t) / F.col(m)) + (F.col(k) <= F.col(t) % F.col(m)).cast("bigint"))
    every = rows.where(F.col(m) == 1).withColumn(k, F.lit(1)).withColumn(times, F.col(t)).unionByName(shared)
    return every.withColumn(times, F.explode(F.array_repeat(F.lit(1), F.col(times).cast("int")))).select(*(F.col(f"`{c}`") for c in documents.columns))


def quality_weights(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.when(F.col("quality") == 1, GOOD).when(F.col("quality") == 0, POOR).otherwise(PLAIN).alias("weight"))


def op3(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, quality_weights(table(spark, sf_dir, "labels"))).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
with l as (
  select doc_id, max(case when quality = 1 then 2.0::double when quality = 0 then 0.5::double else 1.0::double end) as weight from labels group by doc_id
), r as (
  select d.doc_id, source, md5(coalesce("text", '')) as row_hash, len(regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+')) as size, coalesce(weight, 1.0::double) as w
  from documents d left join l on d.doc_id = l.doc_id
), k as (
  select *, -ln((('0x' || substr(md5('mix-1|' || doc_id || '|' || row_hash), 1, 13))::bigint + 0.5::double) / 4503599627370496.0::double) / w as key from r
), s as (
  select source, sum(size)::bigint as source_size from r group by source
), o as (
  select *, (array[5, 2, 1])[((row_number() over (order by source is null, source) - 1) % 3 + 1)::int] as weight from s
), v as (
  select *, sum(source_size) over () as total, sum(weight) over () as weights,
    coalesce(sum(source_size) over q, 0) as size_before, coalesce(sum(weight) over q, 0) as weight_before, source_size / weight as ratio
  from o window q as (order by source_size / weight, source is null, source rows between unbounded preceding and 1 preceding)
), c as (
  select *, (1.5::double * total::double - 2.0::double * size_before::double) / (weights - weight_before)::double as rest from v
), t as (
  select source, source_size,
    case when rest * weight >= 2 * source_size then 2.0::double * source_size
    else weight * (select c2.rest from c c2 where c2.rest * c2.weight < 2 * c2.source_size order by ratio, source is null, source limit 1) end as target
  from c
), f as (
  select k.*, t.source_size, t.target, coalesce(sum(size) over (partition by k.source order by key, doc_id, row_hash rows between unbounded preceding and 1 preceding), 0) as ahead,
    case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end as full_epochs
  from k join t on k.source is not distinct from t.source
)
select doc_id, size::bigint as size, source_size, target,
  (size * (full_epochs + case when ahead + size / 2 <= target - full_epochs * source_size and target - full_epochs * source_size > 0 then 1 else 0 end))::bigint as taken
from f
"""
