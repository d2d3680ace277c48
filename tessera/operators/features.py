"""Pair features. What depends on one record is computed before pairs are made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import blocking_keys as K
from tessera.functions import similarity as S
from tessera.functions import text as X

FEATURES_H = ["name_levenshtein", "name_jaro_winkler", "name_token_jaccard", "addr_token_jaccard", "tfidf_cosine", "phonetic_match", "country_match", "length_diff"]
FEATURES_C = [
    "exact_name_match", "name_char_dice", "name_len_diff", "name_len_ratio", "name_token_jaccard", "first_name_token_match", "addr_char_dice", "addr_token_jaccard",
    "both_addr_empty", "one_addr_empty", "country_match", "is_s2", "is_s3", "rule_count", "has_exact_rule", "cheap_score",
]


def _sides(pairs: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    a = s1.select(F.col("entity_id").alias("s1_id"), F.struct(*(c for c in s1.columns if c != "entity_id")).alias("a"))
    b = pool.select(F.col("entity_id").alias("cand_id"), F.struct(*(c for c in pool.columns if c != "entity_id")).alias("b"))
    return pairs.join(a, "s1_id").join(b, "cand_id")


def features_h(pairs: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """s1_id, cand_id and the eight features on normalised names and addresses. pairs: s1_id, cand_id."""

    def record(df: DataFrame) -> DataFrame:
        n = K.with_normal_columns(df)
        return n.select("entity_id", "name_norm", "addr_norm", "country_key", S.soundex(F.col("name_norm")).alias("sound"), F.concat_ws(" ", "name_norm", "addr_norm").alias("match"))

    p = _sides(pairs.select("s1_id", "cand_id"), record(s1), record(pool))
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    return p.select(
        "s1_id", "cand_id",
        S.levenshtein(a("name_norm"), b("name_norm")).alias("name_levenshtein"),
        S.jaro_winkler(a("name_norm"), b("name_norm")).alias("name_jaro_winkler"),
        S.token_jaccard(a("name_norm"), b("name_norm")).alias("name_token_jaccard"),
        S.token_jaccard(a("addr_norm"), b("addr_norm")).alias("addr_token_jaccard"),
        S.ngram_cosine(a("match"), b("match")).alias("tfidf_cosine"),
        (a("sound") == b("sound")).cast("int").alias("phonetic_match"),
        (a("country_key") == b("country_key")).cast("int").alias("country_match"),
        S.length_difference(a("name_norm"), b("name_norm")).alias("length_diff"),
    )


def features_c(candidates: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """s1_id, cand_id and the sixteen features. candidates: s1_id, cand_id, matched_rules, has_exact_rule."""

    def record(df: DataFrame) -> DataFrame:
        c = K.with_compact_columns(df)
        return c.select("entity_id", "name_compact", "latin_compact", "addr_compact", "country_norm", X.text("business_name").alias("name"), X.text("business_address").alias("addr"))

    p = _sides(candidates.select("s1_id", "cand_id", "matched_rules", "has_exact_rule"), record(s1), record(pool))
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    flag = lambda c: c.cast("double")
    both = lambda c: (a(c) != "") & (a(c) == b(c))
    la, lb = F.char_length(a("latin_compact")), F.char_length(b("latin_compact"))
    first = lambda x: X.nth(X.tokens(F.lower(x)), 1)
    p = p.withColumns({"name_char_dice": S.char_dice(a("latin_compact"), b("latin_compact")), "addr_char_dice": S.char_dice(a("addr_compact"), b("addr_compact"))})
    return p.select(
        "s1_id", "cand_id",
        flag(both("latin_compact") | both("name_compact")).alias("exact_name_match"),
        "name_char_dice",
        F.abs(la - lb).cast("double").alias("name_len_diff"),
        F.when(F.greatest(la, lb) == 0, 1.0).otherwise(F.least(la, lb) / F.greatest(la, lb, F.lit(1))).alias("name_len_ratio"),
        S.raw_token_jaccard(a("name"), b("name")).alias("name_token_jaccard"),
        flag((first(a("name")) != "") & (first(a("name")) == first(b("name")))).alias("first_name_token_match"),
        "addr_char_dice",
        S.raw_token_jaccard(a("addr"), b("addr")).alias("addr_token_jaccard"),
        flag((a("addr_compact") == "") & (b("addr_compact") == "")).alias("both_addr_empty"),
        flag((a("addr_compact") == "") != (b("addr_compact") == "")).alias("one_addr_empty"),
        flag(both("country_norm")).alias("country_match"),
        flag(F.col("cand_id").startswith("S2-")).alias("is_s2"),
        flag(F.col("cand_id").startswith("S3-")).alias("is_s3"),
        F.col("matched_rules").cast("double").alias("rule_count"),
        F.col("has_exact_rule").cast("double").alias("has_exact_rule"),
        (F.col("has_exact_rule") * 0.5 + F.col("name_char_dice") * 0.3 + F.col("addr_char_dice") * 0.2).alias("cheap_score"),
    )


def heuristic_scores(pairs: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """s1_id, cand_id, score from shared named rules and word overlap."""

    def record(df: DataFrame) -> DataFrame:
        name, addr = X.strip_legal_suffix(X.normalize_unicode("business_name")), X.normalize_unicode("business_address")
        return df.select("entity_id", name.alias("name"), F.regexp_replace(name, r"\s+", "").alias("compact"), addr.alias("addr"), X.country_code("country").alias("country"), X.numbers(addr).alias("numbers"))

    ids = pairs.select("s1_id", "cand_id")
    ka = K.named_keys(s1).withColumnRenamed("entity_id", "s1_id")
    kb = K.named_keys(pool).withColumnRenamed("entity_id", "cand_id")
    # one row for each pair and rule of the reference side, met or not: no key is joined with all its postings
    rules = ids.join(ka, "s1_id").join(kb, ["cand_id", "rule", "bkey"]).groupBy("s1_id", "cand_id").agg(F.sort_array(F.collect_set("rule")).alias("rules"))
    p = _sides(ids, record(s1), record(pool)).join(rules, ["s1_id", "cand_id"], "left")
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    score = (
        S.rule_score(F.coalesce("rules", F.array().cast("array<string>")))
        + F.when((a("compact") != "") & (a("compact") == b("compact")), 1.0).otherwise(0.0)
        + 2.0 * S.token_jaccard(a("name"), b("name"), empty=0.0)
        + F.when(F.arrays_overlap(a("numbers"), b("numbers")), 0.5).otherwise(0.0)
        + S.token_jaccard(a("addr"), b("addr"), empty=0.0)
        + F.when((a("country") == "") | (b("country") == "") | (a("country") == b("country")), 0.0).otherwise(-2.0)
    )
    return p.select("s1_id", "cand_id", score.alias("score"))
