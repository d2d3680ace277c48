"""URL filters: host suffixes and path prefixes against rules by short hashes.

Each distinct (host, path) is expanded into every suffix of the host at a dot
and every prefix of the path whose length some rule's path has. The first 4
bytes of an expression's SHA-256 are the only key of the join with the rules;
the full digests confirm each meeting. Of the rules that fit, the longest wins: by length of host
and path together, then host, then a block before an allow, then the rule's text. Verdicts depend on host and
path alone, so they are found once for each distinct pair and joined back.
Rules are a table of any size; Spark broadcasts it only below its own size
threshold.

Defined results: null url or one without ``://``: host and path empty, no
rule; no rule that fits: the default verdict, allow; repeated rows keep their
row; null page_id is kept; an empty rule table blocks nothing; columns of
pages keep their names, the new ones get underscores where theirs are taken. Rules with a null host, path or action are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, table

#: The contract's rules: action, host, path.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def short(digest: Column) -> Column:
    return F.substring(digest, 1, 8)


def expression(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256)


def judge(pages: DataFrame, rules: DataFrame, *, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """pages with host, path, rule, verdict, under these names or ones with underscores after them. rules: action, host, path."""
    host, path, rule, verdict, best_of = (fresh(pages, x) for x in ("host", "path", "rule", "verdict", "best"))
    r = rules.where("action is not null and host is not null and path is not null").select("action", F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path")).distinct()
    digest = expression(F.col("rule_host"), F.col("rule_path"))
    hashed = r.select("action", F.concat("rule_host", "rule_path").alias("rule"), F.char_length("rule_host").alias("host_length"), digest.alias("rule_digest"), short(digest).alias("rule_short"))
    # the path lengths that rules have: no more numbers than the longest rule path has characters
    lengths = sorted(x[0] for x in r.select(F.char_length("rule_path")).distinct().collect())
    judged = pages.withColumn(host, host_of(F.col(f"`{url}`"))).withColumn(path, path_of(F.col(f"`{url}`")))
    pairs = judged.select(F.col(host).alias("host"), F.col(path).alias("path")).distinct()
    dots = F.filter(F.sequence(F.lit(1), F.greatest(F.char_length("host"), F.lit(1))), lambda i: F.substr("host", i, F.lit(1)) == ".")
    suffixes = F.concat(F.array("host"), F.transform(dots, lambda i: F.substr("host", i + 1)))
    prefixes = F.transform(F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.char_length("path")), lambda n: F.substr("path", F.lit(1), n))
    asked = pairs.withColumn("h", F.explode(suffixes)).withColumn("p", F.explode(prefixes)).select("host", "path", expression(F.col("h"), F.col("p")).alias("digest"))
    # digests have one length, so that the beginning is the whole; as an equality it would become a key of the join
    met = asked.join(hashed, (short(asked.digest) == hashed.rule_short) & F.startswith(asked.digest, hashed.rule_digest))
    best = met.groupBy(F.col("host").alias(host), F.col("path").alias(path)).agg(
        F.max_by(F.struct("rule", "action"), F.struct(F.char_length("rule"), F.col("host_length"), F.col("action") == "block", F.col("rule"))).alias(best_of)
    )
    return judged.join(best, [host, path], "left").select(*(judged[f"`{c}`"] for c in judged.columns), F.col(f"{best_of}.rule").alias(rule), F.coalesce(f"{best_of}.action", F.lit(default)).alias(verdict))


def op8(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    return judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
with rules(verdict, host, path) as (
  values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), u as (
  select page_id, url,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages
)
select page_id, host, path,
  (select r.host || r.path from rules r where (u.host = r.host or ends_with(u.host, '.' || r.host)) and starts_with(u.path, r.path) order by length(r.host || r.path) desc limit 1) as "rule",
  coalesce((select r.verdict from rules r where (u.host = r.host or ends_with(u.host, '.' || r.host)) and starts_with(u.path, r.path) order by length(r.host || r.path) desc limit 1), 'allow') as verdict
from u
"""
