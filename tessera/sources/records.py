"""Entity records: the TSV source, views over driver tables, ordinals and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import fresh
from tessera.session import stage_table

RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("entity_id", "business_name", "business_address", "country")])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated records with a header, quoting off, all strings, stripped, empty for null.

    A short row is padded, further columns are dropped, a wrong header raises.
    """
    header = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path).columns
    missing = [n for n in RECORD.names if n not in [h.strip() for h in header]]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}; found {header}")
    order = T.StructType([T.StructField(h.strip() or f"_c{i}", T.StringType()) for i, h in enumerate(header)])
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", "").schema(order).csv(path)
    strip = lambda n: F.regexp_replace(F.coalesce(n, F.lit("")), r"(?U)^\s+|\s+$", "")
    return rows.select(*(strip(n).alias(n) for n in RECORD.names))


def write_records(records: DataFrame, path: str) -> None:
    records.select(*RECORD.names).write.option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """s1_id, cand_id: one row for each true link; an S1 without links has a null cand_id."""
    schema = T.StructType([T.StructField("source1_entity_id", T.StringType()), T.StructField("matched_entity_ids", T.StringType())])
    return explode_truth(spark.read.option("sep", "\t").option("header", True).option("quote", "").schema(schema).csv(path))


def explode_truth(lists: DataFrame) -> DataFrame:
    ids = F.filter(F.transform(F.split(F.coalesce("matched_entity_ids", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return lists.select(F.trim("source1_entity_id").alias("s1_id"), F.explode_outer(ids).alias("cand_id"))


def source_of(entity_id) -> F.Column:
    return F.substring(entity_id, 1, 2)


def reference_side(records: DataFrame) -> DataFrame:
    return records.where(F.col("entity_id").startswith("S1-"))


def pool_side(records: DataFrame) -> DataFrame:
    return records.where(F.col("entity_id").rlike("^S[23]-"))


def with_ordinal(df: DataFrame, key: str, name: str = "ordinal") -> DataFrame:
    """df with 1, 2, ... in the order of key, without putting all rows into one task.

    Rows are ranged and sorted by key and staged; each range's size shifts the
    numbers of the ranges after it.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, local, ahead = (fresh(df, x) for x in ("part", "place", "ahead"))
    at = F.monotonically_increasing_id()
    rows = df.repartitionByRange(n, key).sortWithinPartitions(key).withColumn(part, F.shiftright(at, 33)).withColumn(local, at.bitwiseAND(F.lit((1 << 33) - 1)))
    rows = stage_table(rows, "ordinal")
    sizes = rows.groupBy(part).agg(F.count("*").alias("n"))
    before = sizes.select(part, F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(ahead))
    return rows.join(before, part).withColumn(name, F.col(ahead) + F.col(local) + 1).drop(part, local, ahead)


def first_per_group(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    place = fresh(df, "place")
    return df.withColumn(place, F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col(place) <= n).drop(place)


def deduplicate(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key."""
    place = fresh(df, "place")
    return df.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(place) == 1).drop(place)


# Views over the driver's tables, for queries and tests.


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def er_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: six words of name, length and six words of address, language as country, source by doc_id."""
    d = table(spark, sf_dir, "documents").withColumn("w", F.split(F.regexp_replace("text", r"[ \t\n\f\r]+", " "), " "))
    return d.select(
        F.concat(F.lit("S"), (1 + F.col("doc_id") % 3).cast("string"), F.lit("-"), F.lpad(F.col("doc_id").cast("string"), 7, "0")).alias("entity_id"),
        F.array_join(F.slice("w", 1, 6), " ").alias("business_name"),
        F.concat(F.col("n_chars").cast("string"), F.lit(" "), F.array_join(F.slice("w", 7, 6), " ")).alias("business_address"),
        F.col("lang").alias("country"),
    )


def er_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s1_id, cand_id: documents of S2 and S3 with the same text as one of S1; null where there is none."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("S"), (1 + F.col("doc_id") % 3).cast("string"), F.lit("-"), F.lpad(F.col("doc_id").cast("string"), 7, "0")).alias("id"), F.md5(F.col("text").cast("binary")).alias("h"))
    a, b = d.where("id like 'S1-%'"), d.where("id not like 'S1-%'")
    return a.select(F.col("id").alias("s1_id"), "h").join(b.select(F.col("id").alias("cand_id"), "h"), "h", "left").select("s1_id", "cand_id")


def org_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as records, with hot names and without addresses."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.concat(F.lit("S"), (1 + F.col("c_custkey") % 3).cast("string"), F.lit("-"), F.lpad(F.col("c_custkey").cast("string"), 7, "0")).alias("entity_id"),
        F.col("c_name").alias("business_name"), F.lit("").alias("business_address"), F.col("n_name").alias("country"),
    )


# Profiles.


def profile(records: DataFrame) -> DataFrame:
    """One row per country, and one for all (country null), with counts of rows, ids and empty fields."""
    empty = lambda c: F.sum((F.coalesce(c, F.lit("")) == "").cast("bigint"))
    sums = [
        F.count("*").alias("n_rows"), F.countDistinct("entity_id").alias("unique_ids"), (F.count("entity_id") - F.countDistinct("entity_id")).alias("duplicate_ids"),
        empty("business_name").alias("empty_names"), empty("business_address").alias("empty_addresses"), empty("country").alias("empty_countries"),
    ]
    return records.rollup("country").agg(*sums)


def truth_profile(truth: DataFrame) -> DataFrame:
    per = truth.groupBy("s1_id").agg(F.count("cand_id").alias("n"), F.sum(F.col("cand_id").startswith("S2-").cast("bigint")).alias("s2"), F.sum(F.col("cand_id").startswith("S3-").cast("bigint")).alias("s3"))
    per = per.na.fill(0, ["s2", "s3"])
    count_if = lambda c: F.sum(c.cast("bigint"))
    n, s2, s3 = F.col("n"), F.col("s2"), F.col("s3")
    return per.agg(
        F.count("*").alias("n_rows"), count_if(n == 0).alias("singletons"), count_if(n > 0).alias("with_match"), F.sum("s2").alias("from_s2"), F.sum("s3").alias("from_s3"),
        count_if((s2 > 0) & (s3 > 0)).alias("from_both"), F.max("n").alias("most"),
    )


def country_coverage(train: DataFrame, test: DataFrame) -> DataFrame:
    """country, in_train, in_test."""
    a = train.select("country").distinct().withColumn("a", F.lit(True))
    b = test.select("country").distinct().withColumn("b", F.lit(True))
    return a.join(b, "country", "full").select("country", F.coalesce("a", F.lit(False)).alias("in_train"), F.coalesce("b", F.lit(False)).alias("in_test"))
