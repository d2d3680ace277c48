"""Blocking keys, one definition for both sides of every join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X

# Words that may lead a name without telling it apart.
LEAD_WORDS = "the|shri|sri|dr|dba|inc|mr|ms|m/s|m\\s*s|center|national|all|new|om"
# Address words that don't tell addresses apart.
COMMON_ADDRESS_WORDS = (
    "road", "street", "near", "nagar", "opp", "opposite", "behind", "floor", "building", "plot", "sector", "cross", "main", "avenue",
    "lane", "circle", "layout", "complex", "house", "shop", "village", "dist", "district", "state", "bazaar", "market", "west", "east",
    "north", "south", "city", "block", "bldg", "flr", "apt", "suite", "room", "dept", "care", "attn", "post", "office", "area", "colony",
    "marg", "puram", "chowk", "highway", "number", "side", "front", "phase", "stage", "line", "ward",
)
EMPTY, NONE = "__empty__", "__none__"


def name_prefix(name: Column, n: int = 3) -> Column:
    s = F.regexp_replace(name, r"\s+", "")
    return F.when(s == "", EMPTY).otherwise(F.substr(s, F.lit(1), F.lit(n)))


def stripped_prefix(name: Column, n: int = 3) -> Column:
    return name_prefix(F.trim(F.regexp_replace(name, rf"(?i)^({LEAD_WORDS})\s+", "")), n)


def address_key(address: Column) -> Column:
    number = X.nth(X.numbers(address), 1)
    words = F.regexp_extract_all(address, F.lit(r"\b([a-zA-Z]{4,})\b"), F.lit(1))
    word = X.nth(F.filter(words, lambda w: ~w.isin(*COMMON_ADDRESS_WORDS)), 1)
    return F.when((number != "") & (word != ""), F.concat(number, F.lit("_"), word)).when(number != "", F.concat(F.lit("n_"), number)).when(word != "", F.concat(F.lit("w_"), word)).otherwise(NONE)


def second_word_key(name: Column, n: int = 3) -> Column:
    w = X.nth(X.tokens(name), 2)
    return F.when(w == "", NONE).otherwise(F.substr(w, F.lit(1), F.lit(n)))


def with_normal_columns(records: DataFrame) -> DataFrame:
    """name_norm, addr_norm, country_key of records."""
    return records.withColumns({"name_norm": X.normalize_name("business_name"), "addr_norm": X.normalize_address("business_address"), "country_key": X.country_key("country")})


def prefix_keys(normal: DataFrame, *, second_word: bool = False) -> DataFrame:
    """entity_id, rule (k1..k4), country_key, bkey of rows with normal columns. Keys of one rule meet only inside a country."""
    rules = {"k1": name_prefix(F.col("name_norm")), "k2": stripped_prefix(F.col("name_norm")), "k3": address_key(F.col("addr_norm"))}
    if second_word:
        rules["k4"] = second_word_key(F.col("name_norm"))
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), k.alias("bkey")) for r, k in rules.items())))
    return normal.select("entity_id", "country_key", each.alias("k")).select("entity_id", "k.rule", "country_key", "k.bkey")


def with_compact_columns(records: DataFrame) -> DataFrame:
    """The columns that compact keys are made of. The Latin spelling is computed once for all that derive from it."""
    latin = records.withColumn("latin_name", X.latinize("business_name"))
    return latin.withColumns({
        "country_norm": X.country_code("country"), "name_compact": X.compact("business_name"), "latin_compact": X.compact("latin_name"), "addr_compact": X.compact("business_address"),
        "addr_num": X.address_number("business_address"), "addr_word": X.address_word("business_address"),
        "name_tok1": X.nth(X.name_words(F.col("latin_name")), 1), "name_tok2": X.nth(X.name_words(F.col("latin_name")), 2),
    })


def compact_keys(compact: DataFrame, *, strict: bool = True, tagged: bool = False) -> DataFrame:
    """entity_id, rule_id, bkey. strict: without rule 6, the second name word.

    A key has no rule in it, so equal keys of different rules meet; tagged: it begins with its rule, and they don't.
    """
    c = F.col
    at_least = lambda name, n: F.char_length(name) >= n
    first = F.concat(F.lit("["), F.array_join(F.array_sort(F.array(*(F.substr(c("latin_compact"), F.lit(i), F.lit(1)) for i in (1, 2, 3)))), ", "), F.lit("]"))
    rules = [
        (1, at_least("latin_compact", 3), c("latin_compact")),
        (2, at_least("name_compact", 3) & (c("name_compact") != c("latin_compact")), c("name_compact")),
        (3, at_least("latin_compact", 6), F.substr(c("latin_compact"), F.lit(1), F.lit(6))),
        (4, (c("addr_num") != "") & at_least("addr_word", 3), F.concat_ws("|", "addr_num", "addr_word")),
        (5, at_least("name_tok1", 4), c("name_tok1")),
        (6, at_least("name_tok2", 4) & F.lit(not strict), c("name_tok2")),
        (7, at_least("addr_compact", 10), F.substr(c("addr_compact"), F.lit(1), F.lit(10))),
        (8, at_least("latin_compact", 3), first),
    ]
    each = F.filter(F.array(*(F.when(ok & (c("country_norm") != ""), F.struct(F.lit(r).alias("rule_id"), F.concat_ws("|", *([F.lit(f"r{r}")] if tagged else []), k, "country_norm").alias("bkey"))) for r, ok, k in rules)), lambda x: x.isNotNull())
    return compact.select("entity_id", F.explode(each).alias("k")).select("entity_id", "k.rule_id", "k.bkey")


def named_keys(records: DataFrame) -> DataFrame:
    """entity_id, rule (by name), bkey of the library's rules."""
    name = X.strip_legal_suffix(X.normalize_unicode("business_name"))
    r = records.withColumns({"country_norm": X.country_code("country"), "n": name, "a": X.normalize_unicode("business_address")})
    # the Latin spelling loses a second legal ending, if the name has two, in whatever script it is; ASCII names are normal already
    r = r.withColumn("l", X.strip_legal_suffix(F.when(F.col("n").rlike(r"[^\x00-\x7F]"), X.normalize_unicode(X.latinize("n"))).otherwise(F.col("n"))))
    r = r.withColumns({"nc": F.regexp_replace("n", r"\s+", ""), "lc": F.regexp_replace("l", r"\s+", ""), "ac": F.regexp_replace("a", r"\s+", "")})
    words = F.filter(X.tokens("l"), lambda t: (F.char_length(t) >= 4) & ~t.rlike(r"^\d+$"))
    places = F.filter(X.tokens("a"), lambda t: (F.char_length(t) >= 3) & ~t.rlike(r"^\d+$"))
    r = r.withColumns({"w1": X.nth(words, 1), "w2": X.nth(words, 2), "p1": X.nth(places, 1), "p2": X.nth(places, 2), "num": X.nth(X.numbers("a"), 1)})
    c = F.col
    latin, head = (c("lc") != "") & (c("lc") != c("nc")), lambda x, n: F.substr(c(x), F.lit(1), F.lit(n))
    rules = [
        ("exact_name", c("nc") != "", [c("nc")], False),
        ("name_country", c("nc") != "", [c("nc")], True),
        ("name_p6", F.char_length("nc") >= 6, [head("nc", 6)], True),
        ("latin_name", latin, [c("lc")], False),
        ("latin_country", latin, [c("lc")], True),
        ("latin_p6", latin & (F.char_length("lc") >= 6), [head("lc", 6)], True),
        ("name_tok0", c("w1") != "", [c("w1")], True),
        ("name_tok1", c("w2") != "", [c("w2")], True),
        ("addr_p10", F.char_length("ac") >= 10, [head("ac", 10)], True),
        ("addr_num_word", (c("num") != "") & (c("p1") != ""), [c("num"), c("p1")], True),
        ("addr_num_word2", (c("num") != "") & (c("p2") != ""), [c("num"), c("p2")], True),
    ]
    each = F.filter(F.array(*(F.when(ok, F.struct(F.lit(n).alias("rule"), F.concat_ws("|", *k, *([c("country_norm")] if scoped else [])).alias("bkey"))) for n, ok, k, scoped in rules)), lambda x: x.isNotNull())
    return r.select("entity_id", F.explode(each).alias("k")).select("entity_id", "k.rule", "k.bkey")
