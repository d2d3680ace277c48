"""The registered queries of the record-linkage operators, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import blocking_keys as K
from tessera.functions import similarity as S
from tessera.functions import text as X
from tessera.operators import assignment as A
from tessera.operators import blocking as B
from tessera.operators import evaluation as E
from tessera.operators import features as P
from tessera.operators import model as M
from tessera.operators import validation as V
from tessera.operators import vectors as N
from tessera.plans import runs as U
from tessera.plans import sql as Q
from tessera.session import ship, stage_table, workspace
from tessera.sources import records as R
from tessera.sources import sinks as O
from tessera.streaming import incremental as I

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None, *ctes: str):
    """Register a query under its function's name."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = Q.query(sql, *ctes)
        return f

    return put


def six(c, name: str):
    return F.round(c, 6).alias(name)


def er(spark, d):
    return R.er_records(spark, d)


def sides(spark, d):
    every = er(spark, d)
    return R.reference_side(every), R.pool_side(every)


def candidates(spark, d) -> DataFrame:
    return B.compact_candidates(*sides(spark, d))


def scored(spark, d) -> DataFrame:
    """Candidates with pseudo-probabilities from hashes of the pair, alike in both engines."""
    number = lambda *c: F.conv(F.substring(F.md5(F.concat_ws("|", *c).cast("binary")), 1, 6), 16, 10).cast("int") / 16777215
    countries = R.reference_side(er(spark, d)).select(F.col("entity_id").alias("s1_id"), "country")
    return candidates(spark, d).select("s1_id", "cand_id", "rank", number("s1_id", "cand_id").alias("prob"), number("cand_id", "s1_id").alias("similarity")).join(countries, "s1_id")


def countries_of(spark, d) -> DataFrame:
    return R.reference_side(er(spark, d)).select(F.col("entity_id").alias("s1_id"), "country")


def claims(spark, d) -> DataFrame:
    return A.claim(A.over_threshold(scored(spark, d), default=0.5))


# Sources.


@register("select entity_id, trim(business_name) as business_name, trim(business_address) as business_address, country from er", "er")
def scan_tsv_records(spark, d):
    path = workspace(spark, "tsv") + "/records"
    R.write_records(er(spark, d), path)
    return R.read_records(spark, path)


@register("select entity_id, business_name from er where lower(trim(coalesce(country, ''))) = 'fr'", "er")
def scan_project_filter(spark, d):
    return er(spark, d).where(F.lower(F.trim(F.coalesce("country", F.lit("")))) == "fr").select("entity_id", "business_name")


@register("select entity_id, business_name from pool where entity_id in (select cand_id from truth)", "pool", "truth")
def semi_join_pool(spark, d):
    ids = R.er_truth(spark, d).select(F.col("cand_id").alias("entity_id"))
    return R.pool_side(er(spark, d)).join(ids, "entity_id", "left_semi").select("entity_id", "business_name")


@register("select substr(entity_id, 1, 2) as source, entity_id, country from pool", "pool")
def union_sources(spark, d):
    every = er(spark, d)
    return every.where("entity_id like 'S2-%'").unionByName(every.where("entity_id like 'S3-%'")).select(R.source_of("entity_id").alias("source"), "entity_id", "country")


@register("select * from (select entity_id, row_number() over (order by entity_id) as ordinal from s1) where ordinal between 11 and 60", "s1")
def ordered_slice(spark, d):
    return R.with_ordinal(R.reference_side(er(spark, d)).select("entity_id"), "entity_id").where("ordinal between 11 and 60").select("entity_id", F.col("ordinal").cast("bigint"))


@register("select s1_id, cand_id from truth where cand_id is not null", "truth")
def ground_truth_explode(spark, d):
    lists = R.er_truth(spark, d).groupBy(F.col("s1_id").alias("source1_entity_id")).agg(F.concat_ws(" , ", F.collect_list("cand_id")).alias("matched_entity_ids"))
    return R.explode_truth(lists).where("cand_id is not null")


@register("select substr(entity_id, 1, 2) as source, count(*) as n from er group by 1", "er")
def source_counts(spark, d):
    return er(spark, d).groupBy(R.source_of("entity_id").alias("source")).agg(F.count("*").alias("n"))


@register("select entity_id as s1_id from s1 where entity_id not in (select source1_entity_id from lists where candidate_entity_ids <> '')", "s1", "lists")
def resume_antijoin(spark, d):
    s1 = R.reference_side(er(spark, d)).select(F.col("entity_id").alias("s1_id"))
    return O.remaining(s1, O.id_lists(s1, candidates(spark, d), column="c").where("c <> ''"))


@register("select entity_id, country from (select *, row_number() over (partition by country order by entity_id) as n from er) where n <= 25", "er")
def limit_per_group(spark, d):
    return R.first_per_group(er(spark, d), "country", "entity_id", 25).select("entity_id", "country")


@register("""select country, count(*) as n_rows, count(distinct entity_id) as unique_ids, count(entity_id) - count(distinct entity_id) as duplicate_ids, sum((business_name = '')::int)::bigint as empty_names,
 sum((business_address = '')::int)::bigint as empty_addresses, sum((country = '')::int)::bigint as empty_countries from (select * from er union all select * from org) group by rollup(country)""", "er", "org")
def profile_source(spark, d):
    return R.profile(er(spark, d).unionByName(R.org_records(spark, d)))


@register("""select count(*) as n_rows, sum((n = 0)::int)::bigint as singletons, sum((n > 0)::int)::bigint as with_match, sum(s2)::bigint as from_s2, sum(s3)::bigint as from_s3, sum((s2 > 0 and s3 > 0)::int)::bigint as from_both, max(n) as most
 from (select s1_id, count(cand_id) as n, count(case when cand_id like 'S2-%' then 1 end) as s2, count(case when cand_id like 'S3-%' then 1 end) as s3 from truth group by 1)""", "truth")
def profile_ground_truth(spark, d):
    return R.truth_profile(R.er_truth(spark, d))


@register("select coalesce(a.country, b.country) as country, a.country is not null as in_train, b.country is not null as in_test from (select distinct country from er) a full join (select distinct country from org) b on a.country = b.country", "er", "org")
def country_coverage(spark, d):
    return R.country_coverage(er(spark, d), R.org_records(spark, d))


@register("select entity_id, business_name from (select *, row_number() over (partition by entity_id order by business_name) as n from (select entity_id, business_name from er union all select entity_id, 'zz' from er)) where n = 1", "er")
def dedup_entities(spark, d):
    twice = er(spark, d).select("entity_id", "business_name").unionByName(er(spark, d).select("entity_id", F.lit("zz").alias("business_name")))
    return R.deduplicate(twice, "entity_id", "business_name")


# Text.


def text_query(name: str, column: Callable, sql: str, source: str = "business_name"):
    def f(spark, d):
        return er(spark, d).select("entity_id", column(source).alias("value"))

    f.__name__ = name
    register(f"select entity_id, {sql} as value from er", "er")(f)


text_query("normalize_text", X.normalize, Q.norm("business_name"))
text_query("fold_accents", X.fold_accents, "strip_accents(business_name)")
text_query("normalize_name", X.normalize_name, Q.norm_name("business_name"))
text_query("normalize_address", X.normalize_address, Q.norm_addr("business_address"), "business_address")
text_query("expand_tokens", lambda c: X.expand(F.lower(c), {"the": "article the", "der": "article der", "la": "article la", "of": "von"}), Q.expand("lower(business_name)", {"the": "article the", "der": "article der", "la": "article la", "of": "von"}))
text_query("normalize_country", X.normalize_country, "lower(trim(coalesce(country, '')))", "country")
text_query("country_keys", X.country_key, "case when trim(coalesce(country, '')) = '' then '__unknown__' else lower(trim(country)) end", "country")
text_query("normalize_unicode", X.normalize_unicode, Q.norm_unicode("business_name"))
text_query("latinize", X.latinize, Q.latin("business_name"))
text_query("numeric_tokens", lambda c: F.array_join(X.numbers(c), ","), f"array_to_string({Q.numbers('business_address')}, ',')", "business_address")
text_query("soundex_code", lambda c: S.soundex(X.normalize(c)), Q.soundex(Q.norm("business_name")))


@register(f"select c_custkey, {Q.strip_suffix('lower(n)')} as value from (select c_custkey, c_name || case c_custkey % 4 when 0 then ' Pvt Ltd' when 1 then ' Holding Company' when 2 then ' Limited Liability Company' else '' end as n from customer)")
def strip_legal_suffix(spark, d):
    ending = F.when(F.col("c_custkey") % 4 == 0, " Pvt Ltd").when(F.col("c_custkey") % 4 == 1, " Holding Company").when(F.col("c_custkey") % 4 == 2, " Limited Liability Company").otherwise("")
    return R.table(spark, d, "customer").select("c_custkey", X.strip_legal_suffix(F.lower(F.concat("c_name", ending))).alias("value"))


@register("select entity_id, country_norm, name_compact, latin_compact, addr_compact from cmp", "cmp")
def compact_keys(spark, d):
    return K.with_compact_columns(er(spark, d)).select("entity_id", "country_norm", "name_compact", "latin_compact", "addr_compact")


@register("select entity_id, addr_num, addr_word from cmp", "cmp")
def addr_parts(spark, d):
    return K.with_compact_columns(er(spark, d)).select("entity_id", "addr_num", "addr_word")


@register("select entity_id, name_tok1, name_tok2 from cmp", "cmp")
def name_tokens_sig(spark, d):
    return K.with_compact_columns(er(spark, d)).select("entity_id", "name_tok1", "name_tok2")


@register("select entity_id, case when name_norm <> '' and addr_norm <> '' then name_norm || ' ' || addr_norm else name_norm || addr_norm end as value from nrm", "nrm")
def match_text(spark, d):
    return K.with_normal_columns(er(spark, d)).select("entity_id", X.match_text(F.col("name_norm"), F.col("addr_norm")).alias("value"))


# Keys and candidates.


@register('select entity_id, "rule", country_key, bkey from hkeys', "hkeys")
def h_block_keys(spark, d):
    return K.prefix_keys(K.with_normal_columns(er(spark, d)), second_word=True)


@register("select entity_id, rule_id, bkey from ckeys union all select entity_id, 6, name_tok2 || '|' || country_norm from cmp where length(name_tok2) >= 4 and country_norm <> ''", "ckeys")
def c_block_keys(spark, d):
    return K.compact_keys(K.with_compact_columns(er(spark, d)), strict=False)


_NAMED = [
    ("exact_name", "nc <> ''", "nc", False), ("name_country", "nc <> ''", "nc", True), ("name_p6", "length(nc) >= 6", "substr(nc, 1, 6)", True),
    ("latin_name", "lc <> '' and lc <> nc", "lc", False), ("latin_country", "lc <> '' and lc <> nc", "lc", True), ("latin_p6", "lc <> nc and length(lc) >= 6", "substr(lc, 1, 6)", True),
    ("name_tok0", "w[1] is not null", "w[1]", True), ("name_tok1", "w[2] is not null", "w[2]", True), ("addr_p10", "length(ac) >= 10", "substr(ac, 1, 10)", True),
    ("addr_num_word", "num[1] is not null and p[1] is not null", "num[1] || '|' || p[1]", True), ("addr_num_word2", "num[1] is not null and p[2] is not null", "num[1] || '|' || p[2]", True),
]


_NAMED_SQL = (
    f"""select * from (with b as (select entity_id, upper(trim(country)) as cn, {Q.strip_suffix(Q.norm_unicode('business_name'))} as n, {Q.norm_unicode('business_address')} as a from er),
 l as (select *, {Q.strip_suffix(Q.norm_unicode(Q.latin('n')))} as l from b),
 k as (select *, replace(n, ' ', '') as nc, replace(l, ' ', '') as lc, replace(a, ' ', '') as ac, {Q.numbers('a')} as num,
  list_filter({Q.tokens('l')}, lambda t: length(t) >= 4 and not regexp_matches(t, '^[0-9]+$')) as w, list_filter({Q.tokens('a')}, lambda t: length(t) >= 3 and not regexp_matches(t, '^[0-9]+$')) as p from l)
"""
    + " union all ".join(f"select entity_id, '{n}' as \"rule\", {k}{' || chr(124) || cn' if scoped else ''} as bkey from k where {ok}" for n, ok, k, scoped in _NAMED)
    + ")"
)


@register(_NAMED_SQL, "er")
def named_block_keys(spark, d):
    return K.named_keys(er(spark, d))


@register("select entity_id, rule_id, bkey from ckeys where entity_id not like 'S1-%' and bkey in (select bkey from ckeys where entity_id not like 'S1-%' group by bkey having count(*) <= 20)", "ckeys")
def freq_pruned_postings(spark, d):
    return B.prune_frequent(K.compact_keys(K.with_compact_columns(R.pool_side(er(spark, d)))), 20)


@register("select s1_id, cand_id, matched_rules, has_exact_rule, rank from cands", "cands")
def c_blocking(spark, d):
    return candidates(spark, d)


@register("""select s1_id, cand_id, row_number() over (partition by s1_id order by best.r, best.place, cand_id)::int as rank from (
 select s.entity_id as s1_id, p.entity_id as cand_id, min({'r': s."rule", 'place': p.place}) as best from hkeys s join (
  select *, row_number() over (partition by "rule", country_key, bkey order by entity_id) as place from hkeys where entity_id not like 'S1-%') p
 on s."rule" = p."rule" and s.country_key = p.country_key and s.bkey = p.bkey and p.place <= case p."rule" when 'k1' then 20 when 'k4' then 0 else 10 end where s.entity_id like 'S1-%' group by 1, 2)""", "hkeys")
def h_blocking(spark, d):
    return B.prefix_candidates(*sides(spark, d))


@register("select c.s1_id, c.cand_id, a.business_name as s1_name, b.business_name as cand_name, b.business_address as cand_addr from cands c join er a on a.entity_id = c.s1_id join er b on b.entity_id = c.cand_id", "cands")
def candidate_attributes(spark, d):
    return B.with_attributes(candidates(spark, d).select("s1_id", "cand_id"), *sides(spark, d)).select("s1_id", "cand_id", "s1_name", "cand_name", "cand_addr")


@register("select entity_id as s1_id, count(cand_id) as n from s1 left join cands on s1_id = entity_id group by 1 having count(cand_id) < 5", "s1", "cands")
def low_candidate_fallback(spark, d):
    return B.few_candidates(R.reference_side(er(spark, d)), candidates(spark, d))


_GRAMS = """tok as (select entity_id, ' ' || unnest(string_split(trim(name_norm || ' ' || addr_norm), ' ')) || ' ' as w from nrm),
 g as (select entity_id, gram, count(*) as n from (select entity_id, unnest(list_transform(range(1, length(w) - k + 2), lambda i: substr(w, i, k))) as gram from tok, (values (2), (3), (4)) v(k) where length(w) >= k) group by 1, 2),
 norms as (select entity_id, sqrt(sum(n * n)) as m from g group by 1),
 cos as (select c.s1_id, c.cand_id, sum(a.n * b.n) / max(x.m * y.m) as score from {pairs} c join g a on a.entity_id = c.s1_id join g b on b.entity_id = c.cand_id and b.gram = a.gram join norms x on x.entity_id = c.s1_id join norms y on y.entity_id = c.cand_id group by 1, 2)"""


@register("""select s1_id, cand_id, row_number() over (partition by s1_id order by best.r, best.place, cand_id)::int as rank from (with probes as (select distinct s."rule" as r, s.entity_id as s1_id, p.entity_id as cand_id from hkeys s join (
 select *, row_number() over (partition by "rule", country_key, bkey order by entity_id) as place from hkeys where entity_id not like 'S1-%') p on s."rule" = p."rule" and s.country_key = p.country_key and s.bkey = p.bkey and p.place <= 500 where s.entity_id like 'S1-%'),
 pairs as (select distinct s1_id, cand_id from probes), """ + _GRAMS.format(pairs="pairs") + """,
 ranked as (select r, s1_id, cand_id, row_number() over (partition by s1_id, r order by round(coalesce(score, 0), 9) desc, cand_id) as place from probes left join cos using (s1_id, cand_id))
 select s1_id, cand_id, min({'r': r, 'place': place}) as best from ranked where place <= case r when 'k1' then 60 when 'k4' then 20 else 30 end group by 1, 2)""", "hkeys")
def four_key_blocking(spark, d):
    return B.cosine_candidates(*sides(spark, d))


# Similarities of candidate pairs.


def pair_query(name: str, column: Callable, sql: str):
    def f(spark, d):
        p = B.with_attributes(candidates(spark, d).select("s1_id", "cand_id"), *(K.with_normal_columns(x).withColumns({"business_name": F.col("name_norm"), "business_address": F.col("addr_norm")}) for x in sides(spark, d)))
        return p.select("s1_id", "cand_id", six(column(F.col("s1_name"), F.col("cand_name")), "value"))

    f.__name__ = name
    register(f"select s1_id, cand_id, {Q.R(sql, 'value')} from cands join nrm a on a.entity_id = s1_id join nrm b on b.entity_id = cand_id", "cands", "nrm")(f)


pair_query("sim_levenshtein", S.levenshtein, "1 - levenshtein(a.name_norm, b.name_norm) / greatest(length(a.name_norm), length(b.name_norm), 1)")
pair_query("sim_jaro_winkler", S.jaro_winkler, "jaro_winkler_similarity(a.name_norm, b.name_norm)")
pair_query("sim_token_jaccard", S.token_jaccard, Q.jaccard("a.name_norm", "b.name_norm", "1.0"))
pair_query("sim_token_jaccard_strict", S.raw_token_jaccard, f"case when a.name_norm = '' or b.name_norm = '' then 0.0 else {Q.jaccard('a.name_norm', 'b.name_norm', '0.0')} end")
pair_query("sim_char_dice", S.char_dice, Q.dice("a.name_norm", "b.name_norm"))


@register("select * from (with " + _GRAMS.format(pairs="cands") + " select s1_id, cand_id, round(coalesce(score, 0), 6) as value from cands left join cos using (s1_id, cand_id))", "cands", "nrm")
def sim_ngram_cosine(spark, d):
    s1, pool = sides(spark, d)
    return P.features_h(candidates(spark, d), s1, pool).select("s1_id", "cand_id", six(F.col("tfidf_cosine"), "value"))


@register(f"""select c.s1_id, c.cand_id, {Q.R("1 - levenshtein(a.name_norm, b.name_norm) / greatest(length(a.name_norm), length(b.name_norm), 1)", 'name_levenshtein')}, {Q.R("jaro_winkler_similarity(a.name_norm, b.name_norm)", 'name_jaro_winkler')},
 {Q.R(Q.jaccard('a.name_norm', 'b.name_norm', '1.0'), 'name_token_jaccard')}, {Q.R(Q.jaccard('a.addr_norm', 'b.addr_norm', '1.0'), 'addr_token_jaccard')}, round(coalesce(c.score, 0), 6) as tfidf_cosine,
 ({Q.soundex('a.name_norm')} = {Q.soundex('b.name_norm')})::int as phonetic_match, (a.country_key = b.country_key)::int as country_match,
 {Q.R("abs(length(a.name_norm) - length(b.name_norm)) / greatest(length(a.name_norm), length(b.name_norm), 1)", 'length_diff')}
 from (with {_GRAMS.format(pairs='cands')} select s1_id, cand_id, score from cands left join cos using (s1_id, cand_id)) c join nrm a on a.entity_id = c.s1_id join nrm b on b.entity_id = c.cand_id""", "cands", "nrm")
def pair_features_h(spark, d):
    f = P.features_h(candidates(spark, d), *sides(spark, d))
    return f.select("s1_id", "cand_id", *(F.col(c) if c in ("phonetic_match", "country_match") else six(F.col(c), c) for c in P.FEATURES_H))


_D = lambda x: f"({x})::int::double"
_FIRST = lambda x: f"coalesce(({Q.tokens(f'lower({x})')})[1], '')"


@register(f"""select s1_id, cand_id, {_D("(a.latin_compact <> '' and a.latin_compact = b.latin_compact) or (a.name_compact <> '' and a.name_compact = b.name_compact)")} as exact_name_match,
 {Q.R(Q.dice('a.latin_compact', 'b.latin_compact'), 'name_char_dice')}, abs(length(a.latin_compact) - length(b.latin_compact))::double as name_len_diff,
 {Q.R("case when greatest(length(a.latin_compact), length(b.latin_compact)) = 0 then 1.0 else least(length(a.latin_compact), length(b.latin_compact)) / greatest(length(a.latin_compact), length(b.latin_compact)) end", 'name_len_ratio')},
 {Q.R(f"case when trim(a.business_name) = '' or trim(b.business_name) = '' then 0.0 else {Q.jaccard('lower(a.business_name)', 'lower(b.business_name)', '0.0')} end", 'name_token_jaccard')},
 {_D(f"{_FIRST('a.business_name')} <> '' and {_FIRST('a.business_name')} = {_FIRST('b.business_name')}")} as first_name_token_match,
 {Q.R(Q.dice('a.addr_compact', 'b.addr_compact'), 'addr_char_dice')},
 {Q.R(f"case when trim(a.business_address) = '' or trim(b.business_address) = '' then 0.0 else {Q.jaccard('lower(a.business_address)', 'lower(b.business_address)', '0.0')} end", 'addr_token_jaccard')},
 {_D("a.addr_compact = '' and b.addr_compact = ''")} as both_addr_empty, {_D("(a.addr_compact = '') <> (b.addr_compact = '')")} as one_addr_empty, {_D("a.country_norm <> '' and a.country_norm = b.country_norm")} as country_match,
 {_D("cand_id like 'S2-%'")} as is_s2, {_D("cand_id like 'S3-%'")} as is_s3, matched_rules::double as rule_count, has_exact_rule::double as has_exact_rule,
 {Q.R(f"has_exact_rule * 0.5 + ({Q.dice('a.latin_compact', 'b.latin_compact')}) * 0.3 + ({Q.dice('a.addr_compact', 'b.addr_compact')}) * 0.2", 'cheap_score')}
 from cands join cmp a on a.entity_id = s1_id join cmp b on b.entity_id = cand_id""", "cands", "cmp")
def pair_features_c(spark, d):
    return P.features_c(candidates(spark, d), *sides(spark, d)).select("s1_id", "cand_id", *(six(F.col(c), c) for c in P.FEATURES_C))


_RULE_CASE = " ".join(f"when '{k}' then {v}" for k, v in S.RULE_WEIGHTS.items())


_HN = f"select entity_id, n, replace(n, ' ', '') as c, a, upper(trim(country)) as country from (select entity_id, country, {Q.strip_suffix(Q.norm_unicode('business_name'))} as n, {Q.norm_unicode('business_address')} as a from er)"


@register(f"""select * from (with nk as ({_NAMED_SQL}), hn as ({_HN}) select s1_id, cand_id, {Q.R(f'''coalesce(rs, 0) + case when a.c <> '' and a.c = b.c then 1.0 else 0.0 end + 2.0 * (case when a.n = '' or b.n = '' then 0.0 else {Q.jaccard('a.n', 'b.n', '0.0')} end)
 + case when len(list_intersect({Q.numbers('a.a')}, {Q.numbers('b.a')})) > 0 then 0.5 else 0.0 end + {Q.jaccard('a.a', 'b.a', '0.0')} + case when a.country = b.country then 0.0 else -2.0 end''', 'score')}
 from cands left join (select s1_id, cand_id, sum(case r {_RULE_CASE} else 0.2 end) as rs from (select distinct c.s1_id, c.cand_id, x."rule" as r from cands c join nk x on x.entity_id = c.s1_id join nk y on y.entity_id = c.cand_id and y."rule" = x."rule" and y.bkey = x.bkey) group by 1, 2) using (s1_id, cand_id)
 join hn a on a.entity_id = s1_id join hn b on b.entity_id = cand_id)""", "cands")
def heuristic_score(spark, d):
    return P.heuristic_scores(candidates(spark, d), *sides(spark, d)).select("s1_id", "cand_id", six(F.col("score"), "score"))


# Labels, assignment, evaluation.


@register("select c.s1_id, c.cand_id, (t.cand_id is not null)::int as label from cands c left join (select distinct * from truth) t on t.s1_id = c.s1_id and t.cand_id = c.cand_id", "cands", "truth")
def label_pairs(spark, d):
    return A.label_pairs(candidates(spark, d).select("s1_id", "cand_id"), R.er_truth(spark, d))


_LABELLED = "(select c.s1_id, c.cand_id, rank, (t.cand_id is not null)::int as label from cands c left join (select distinct * from truth) t on t.s1_id = c.s1_id and t.cand_id = c.cand_id)"


@register(f"select s1_id, cand_id, label from (select *, sum(label) over (partition by s1_id) as p, row_number() over (partition by s1_id, label order by rank, cand_id) as n from {_LABELLED}) where label = 1 or n <= greatest(1, 3 * p)", "cands", "truth")
def hard_negative_sampling(spark, d):
    return A.hard_negatives(A.label_pairs(candidates(spark, d), R.er_truth(spark, d))).select("s1_id", "cand_id", "label")


@register("select entity_id, country, case when row_number() over (partition by country order by md5(entity_id), entity_id) <= ceil(count(*) over (partition by country) * 0.8) then 'train' else 'validation' end as split from s1", "s1")
def stratified_split(spark, d):
    return A.stratified_split(R.reference_side(er(spark, d)))


@register(f"select label, count(*) as n, round(sum(count(*)) over () / (2 * count(*)), 6) as weight from {_LABELLED} group by 1", "cands", "truth")
def class_weights(spark, d):
    return A.class_weights(A.label_pairs(candidates(spark, d), R.er_truth(spark, d))).select("label", "n", six(F.col("weight"), "weight"))


@register("select s1_id, cand_id, country, round(prob, 6) as prob from scored where prob >= case country when 'de' then 0.42 when 'fr' then 0.44 when 'en' then 0.46 else 0.8 end", "scored")
def threshold_matches(spark, d):
    t = spark.createDataFrame([("de", 0.42), ("fr", 0.44), ("en", 0.46)], "country string, threshold double")
    return A.over_threshold(scored(spark, d), t).select("s1_id", "cand_id", "country", six(F.col("prob"), "prob"))


@register("select s1_id, cand_id, round(prob, 6) as prob from claims", "claims")
def claim_assignment(spark, d):
    return claims(spark, d).select("s1_id", "cand_id", six(F.col("prob"), "prob"))


@register("select s1_id, cand_id, round(prob, 6) as prob from (select *, row_number() over (partition by s1_id order by prob desc, cand_id) as n from scored) where n = 1", "scored")
def best_candidate(spark, d):
    return A.best_candidate(scored(spark, d)).select("s1_id", "cand_id", six(F.col("prob"), "prob"))


@register("""select s1_id, cand_id from (select *, row_number() over (partition by cand_id order by s1_id) as m from (select * from (select *, row_number() over (partition by s1_id order by prob desc, cand_id) as n
 from scored where s1_id not in (select s1_id from claims)) where n = 1 and prob >= 0.25 and similarity >= 0.3 and cand_id not in (select cand_id from claims))) where m = 1""", "claims")
def rescue_assignment(spark, d):
    return A.rescue(scored(spark, d), claims(spark, d), similar=0.3).select("s1_id", "cand_id")


@register("""select s1_id, cand_id, row_number() over (partition by s1_id order by b.s, b.r, cand_id)::int as rank from (select s1_id, cand_id, min({'s': s, 'r': r}) as b from (
 select s1_id, cand_id, 0 as s, rank as r from cands where matched_rules > 1 union all select s1_id, cand_id, 1, rank from cands) group by 1, 2)""", "cands")
def candidate_rank_merge(spark, d):
    c = candidates(spark, d)
    return O.merge_ranked(c.where("matched_rules > 1").withColumn("stage", F.lit(0)).unionByName(c.withColumn("stage", F.lit(1))).select("s1_id", "cand_id", "stage", "rank"))


@register("""select s1_id, cand_id, row_number() over (partition by s1_id order by b.s, b.r, cand_id)::int as rank from (select s1_id, cand_id, min({'s': s, 'r': r}) as b from (
 select s1_id, cand_id, 0 as s, rank as r from cands union all select s1_id, cand_id, 1, 1 from truth where cand_id is not null) group by 1, 2)""", "cands", "truth")
def candidate_union_matches(spark, d):
    return O.union_with_matches(candidates(spark, d), R.er_truth(spark, d).where("cand_id is not null").withColumn("rank", F.lit(1)))


@register("select source1_entity_id, candidate_entity_ids from lists", "lists")
def id_list_sink(spark, d):
    """Written as a result file and read again."""
    path = workspace(spark, "lists") + "/candidate_pairs"
    O.write_lists(O.id_lists(R.reference_side(er(spark, d)).select(F.col("entity_id").alias("s1_id")), candidates(spark, d), column="candidate_entity_ids"), path)
    back = spark.read.option("sep", "\t").option("header", True).option("quote", "").schema("source1_entity_id string, candidate_entity_ids string").csv(path)
    return back.select("source1_entity_id", F.coalesce("candidate_entity_ids", F.lit("")).alias("candidate_entity_ids"))


@register("""select count(*) as total_s1, sum(n)::bigint as total_candidates, round(sum(n) / count(*), 2) as avg_candidates, (list_sort(list(n)))[(floor(0.5 * count(*)))::int + 1] as p50, (list_sort(list(n)))[(floor(0.95 * count(*)))::int + 1] as p95,
 (list_sort(list(n)))[(floor(0.99 * count(*)))::int + 1] as p99, sum((n = 0)::int)::bigint as without from (select entity_id, count(cand_id) as n from s1 left join cands on s1_id = entity_id group by 1)""", "s1", "cands")
def candidate_stats(spark, d):
    return E.candidate_stats(R.reference_side(er(spark, d)).select(F.col("entity_id").alias("s1_id")), candidates(spark, d))


@register("""select country, count(*) as n_entities, sum(n_true)::bigint as total_links, sum(cand_tp)::bigint as retrieved_links, round(case when sum(n_true) > 0 then sum(cand_tp) / sum(n_true) else 1.0 end, 6) as link_recall,
 sum((n_true > 0 and cand_tp = n_true)::int)::bigint as full_recall, sum((n_true > 0)::int)::bigint as with_matches, sum((n_true = 0 and n_c > 0)::int)::bigint as singletons_with_candidates,
 round(avg(n_c), 6) as mean_candidates, median(n_c) as median_candidates, max(n_c)::bigint as max_candidates, sum((n_c = 0)::int)::bigint as empty_entities
 from ent join countries using (s1_id) left join (select s1_id, count(*) as k from cands group by 1) using (s1_id) cross join lateral (select coalesce(k, 0) as n_c) group by rollup(country)""", "ent", "countries")
def blocking_recall_report(spark, d):
    r = E.recall_report(R.er_truth(spark, d), candidates(spark, d), countries_of(spark, d))
    return r.withColumns({"link_recall": F.round("link_recall", 6), "mean_candidates": F.round("mean_candidates", 6)})


@register("select country, count(*) as n, round(avg(p), 6) as \"precision\", round(avg(r), 6) as recall, round(avg(f), 6) as f05 from ent join countries using (s1_id) group by rollup(country)", "ent", "countries")
def macro_f05(spark, d):
    m = E.macro_f05(R.er_truth(spark, d), claims(spark, d), countries_of(spark, d))
    return m.select("country", "n", *(six(F.col(c), c) for c in ("precision", "recall", "f05")))


@register("""select round(avg(f), 6) as macro_f05, round(avg(p), 6) as macro_precision, round(avg(r), 6) as macro_recall, round(sum((n_true = 0 and n_pred = 0)::int) / sum((n_true = 0)::int), 6) as singleton_accuracy,
 round(avg(case when n_true > 0 then f end), 6) as non_singleton_f05, round(sum(cand_tp) / sum(n_true), 6) as candidate_recall, round(sum(tp) / sum(n_true), 6) as prediction_recall, count(*) as total_entities,
 sum((n_true = 0)::int)::bigint as singletons, sum(n_true)::bigint as true_links, sum(n_true - cand_tp)::bigint as blocking_misses, sum(cand_tp - tp)::bigint as model_rejections, sum(n_pred - tp)::bigint as false_positives, 0::bigint as subset_violations from ent""", "ent")
def evaluation_report(spark, d):
    r = E.report(R.er_truth(spark, d), claims(spark, d), candidates(spark, d))
    return r.select(*(six(F.col(c), c) if t == "double" else F.col(c) for c, t in r.dtypes))


_TAUS = ", ".join(f"({t})" for t in E.TAUS_H)


@register(f"""select country, tau::double as tau, round(f05, 6) as f05, row_number() over (partition by country order by f05 desc, tau) = 1 as best from (select country, tau, round(avg(case when n_true = 0 then (n_pred = 0)::int::double when tp = 0 then 0.0 else 1.25 * (tp / n_pred) * (tp / n_true) / (0.25 * (tp / n_pred) + tp / n_true) end), 9) as f05
 from (select i.s1_id, countries.country, tau, n_true, count(b.cand_id) as n_pred, count(t.cand_id) as tp from (select s1_id, count(cand_id) as n_true from truth group by 1) i join countries using (s1_id) cross join (values {_TAUS}) v(tau)
 left join (select * from (select *, row_number() over (partition by cand_id order by prob desc, s1_id) as n from scored) where n = 1) b on b.s1_id = i.s1_id and b.prob >= tau
 left join (select distinct * from truth where cand_id is not null) t on t.s1_id = b.s1_id and t.cand_id = b.cand_id group by all) group by 1, 2)""", "scored", "truth", "countries")
def threshold_sweep(spark, d):
    s = E.threshold_sweep(R.er_truth(spark, d), scored(spark, d), countries_of(spark, d))
    return s.select("country", "tau", six(F.col("f05"), "f05"), "best")


def threshold_sweep_fine(spark, d):
    """All 34 thresholds of the single-threshold search."""
    s = E.threshold_sweep(R.er_truth(spark, d), scored(spark, d), countries_of(spark, d), E.TAUS_C)
    return s.select("country", "tau", six(F.col("f05"), "f05"), "best")


register()(threshold_sweep_fine)
ORACLES["threshold_sweep_fine"] = ORACLES["threshold_sweep"].replace(_TAUS, ", ".join(f"({t})" for t in E.TAUS_C))


# Validation.


def result_tables(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Matches with planted faults, candidates, required ids, known ids."""
    s1, pool = sides(spark, d)
    ids = s1.select(F.col("entity_id").alias("s1_id"))
    c = O.id_lists(ids, candidates(spark, d), column="candidate_entity_ids")
    number = F.substring("source1_entity_id", 4, 7).cast("int")
    text = F.col("candidate_entity_ids")
    m = c.where(number % 10 != 3).select(
        "source1_entity_id",
        F.when(number % 10 == 5, F.concat_ws(",", F.lit("S2-9999999"), F.lit("S2-9999999"), text)).when(number % 10 == 7, F.concat(text, F.lit(","), "source1_entity_id")).otherwise(text).alias("matched_entity_ids"),
    )
    return m, c, ids, pool.select("entity_id")


_MATCHES = """m as (select source1_entity_id, case k % 10 when 5 then 'S2-9999999,S2-9999999,' || c when 7 then c || ',' || source1_entity_id else c end as l
 from (select source1_entity_id, candidate_entity_ids as c, substr(source1_entity_id, 4, 7)::int as k from lists) where k % 10 <> 3),
x as (select source1_entity_id as s1_id, unnest(list_filter(string_split(l, ','), lambda t: t <> '')) as cand_id from m)"""


@register(f"select * from (with {_MATCHES} select distinct s1_id, cand_id from x where not exists (select 1 from cands c where c.s1_id = x.s1_id and c.cand_id = x.cand_id))", "lists")
def validate_subset(spark, d):
    m, c, _, _ = result_tables(spark, d)
    return V.outside_candidates(m, c).distinct()


def _finding(table: str, check: str, rows: str, severity: str = "error") -> str:
    return f"select '{table}' as \"table\", '{severity}' as severity, '{check}' as \"check\", count(distinct id) as n, coalesce(array_to_string((list_sort(list_distinct(list(id))))[1:5], ','), '') as examples from ({rows})"


def _list_findings(table: str, m: str, x: str) -> list[str]:
    return [
        _finding(table, "duplicate_rows", f"select source1_entity_id as id from {m} group by 1 having count(*) > 1"),
        _finding(table, "duplicates_in_list", f"select s1_id as id from {x} group by s1_id, cand_id having count(*) > 1"),
        _finding(table, "self_match", f"select s1_id as id from {x} where s1_id = cand_id"),
        _finding(table, "wrong_prefix", f"select cand_id as id from {x} where cand_id not like 'S2-%' and cand_id not like 'S3-%'"),
        _finding(table, "missing_rows", f"select entity_id as id from s1 where entity_id not in (select source1_entity_id from {m})"),
        _finding(table, "extra_rows", f"select source1_entity_id as id from {m} where source1_entity_id not in (select entity_id from s1)"),
        _finding(table, "unknown_ids", f"select cand_id as id from {x} where (cand_id like 'S2-%' or cand_id like 'S3-%') and cand_id not in (select entity_id from pool)"),
    ]


_SUBSET = _finding("matches", "matches_outside_candidates", "select s1_id as id from x where not exists (select 1 from cands c where c.s1_id = x.s1_id and c.cand_id = x.cand_id)", "warning")


@register("select * from (with " + _MATCHES + ", y as (select s1_id, cand_id from cands) " + " union all ".join([*_list_findings("matches", "m", "x"), *_list_findings("candidates", "lists", "y"), _SUBSET]) + ")", "lists", "pool")
def validation_report(spark, d):
    return V.validate(*(stage_table(t, "results") for t in result_tables(spark, d)))


@register("select * from (with " + _MATCHES + " select distinct s1_id, cand_id from x where (cand_id like 'S2-%' or cand_id like 'S3-%') and cand_id not in (select entity_id from pool))", "lists", "pool")
def validate_unknown_ids(spark, d):
    m, _, _, known = result_tables(spark, d)
    return V.exploded(m, "matched_entity_ids").where(F.col("cand_id").rlike("^S[23]-")).join(known.withColumnRenamed("entity_id", "cand_id"), "cand_id", "left_anti").select("s1_id", "cand_id").distinct()


# Vectors.


def all_vectors(spark, d) -> DataFrame:
    return R.table(spark, d, "embeddings").select(F.col("vec_id").cast("bigint").alias("id"), F.col("label").alias("part"), F.col("embedding").alias("vec"))


def whole_search(spark, d) -> tuple[DataFrame, DataFrame]:
    """Queries of ids divisible by 50, and all rows, the queries too."""
    v = all_vectors(spark, d).drop("part")
    return v.where("id % 50 = 0"), v


_DOT_PART = "select q.vec_id as q_id, t.vec_id as t_id, round(list_inner_product(q.embedding::double[], t.embedding::double[]), 9) as s, row_number() over (partition by q.vec_id order by s desc, t.vec_id)::int as rank from embeddings q join embeddings t on q.label = t.label where q.vec_id % 50 = 0"


@register(f"select q_id, t_id, round(s, 6) as score, rank from ({_DOT_PART}) where rank <= 20")
def embedding_topk_by_label(spark, d):
    v = all_vectors(spark, d)
    return N.top_k(v.where("id % 50 = 0"), v).select("q_id", "t_id", six(F.col("score"), "score"), "rank")


_DOT_ALL = "select q.vec_id as q_id, t.vec_id as t_id, round(list_inner_product(q.embedding::double[], t.embedding::double[]), 9) as s, row_number() over (partition by q.vec_id order by s desc, t.vec_id)::int as rank from embeddings q cross join embeddings t where q.vec_id % 50 = 0"


@register(f"select q_id, t_id, round(s, 6) as score, rank from ({_DOT_ALL}) where rank <= 20")
def embedding_topk_all(spark, d):
    return N.top_k_of_all(*whole_search(spark, d)).select("q_id", "t_id", six(F.col("score"), "score"), "rank")


@register(f"select q_id, t_id, round(s, 6) as score from ({_DOT_ALL}) where rank <= 20 and s >= 0.3")
def embedding_matches_all(spark, d):
    return N.matches(N.top_k_of_all(*whole_search(spark, d)), 0.3).select("q_id", "t_id", six(F.col("score"), "score"))


@register()
def ann_ivf_topk(spark, d):
    return N.approximate_top_k(*whole_search(spark, d))


@register()
def block_topk_cosine(spark, d):
    """The 30 nearest by dense vectors in the first prefix rule's block, for every S1."""
    return B.dense_candidates(*sides(spark, d))


@register()
def four_key_with_fallback(spark, d):
    return B.four_key_candidates(*sides(spark, d))


@register()
def encode_texts(spark, d):
    return N.encode(er(spark, d), "business_name").select("entity_id", "embedding")


# Matcher.


def _training(spark, d) -> DataFrame:
    pairs = candidates(spark, d)
    return stage_table(A.label_pairs(P.features_c(pairs, *sides(spark, d)), R.er_truth(spark, d)), "features")


@register()
def gbt_matcher(spark, d):
    rows = _training(spark, d)
    return M.predict(M.fit(rows, P.FEATURES_C, trees=20), rows).select("s1_id", "cand_id", "label", "prob")


@register()
def feature_importances(spark, d):
    return M.importances(M.fit(_training(spark, d), P.FEATURES_C, trees=20))


@register()
def matcher_held_out(spark, d):
    """Validation pairs with the probabilities of a matcher that stopped early, and each country's threshold."""
    every = R.reference_side(er(spark, d)).select("entity_id", "country")
    _, thresholds, scored_ = M.train_matcher(_training(spark, d), every, R.er_truth(spark, d), P.FEATURES_C, trees=250)
    return scored_.join(every.withColumnRenamed("entity_id", "s1_id"), "s1_id").join(thresholds, "country", "left")


# Other scripts.


#: One letter of each script for Latin letters, so that spelling a name in the script and back gives the name. The twins don't read them.
_SCRIPTS = {
    "cyrillic": ("abdefgiklmnoprstuvyz", "абдефгиклмнопрстувыз"),
    "greek": ("abdegiklmnoprstuxz", "αβδεγικλμνοπρστυξζ"),
    "devanagari": ("kgjtdnpbmyrlvsh", "कगजतदनपबमयरलवसह"),
}


@register("select s.script, n_nationkey, regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') as value from nation, (values ('cyrillic'), ('greek'), ('devanagari')) s(script)")
def latinize_scripts(spark, d):
    """Compact keys of names that are spelled in other scripts."""
    n = R.table(spark, d, "nation").select("n_nationkey", F.lower("n_name").alias("name"))
    each = [n.select(F.lit(k).alias("script"), "n_nationkey", X.compact(X.latinize(F.translate("name", a, b))).alias("value")) for k, (a, b) in _SCRIPTS.items()]
    return each[0].unionByName(each[1]).unionByName(each[2])


# Whole runs.


def run_of(spark, d, run: Callable, **options) -> DataFrame:
    """The three sources as files, through a run; what it has written."""
    place, every = workspace(spark, "run"), stage_table(er(spark, d), "run-records")
    paths = []
    for n in (1, 2, 3):
        paths.append(f"{place}/s{n}")
        R.write_records(every.where(F.col("entity_id").startswith(f"S{n}-")), paths[-1])
    return run(spark, *paths, f"{place}/out", **options).results()


@register(f"""select l.source1_entity_id, l.candidate_entity_ids, coalesce(m.ids, '') as matched_entity_ids from lists l left join (
 select s1_id, string_agg(cand_id, ',' order by rank, cand_id) as ids from cands join cmp a on a.entity_id = s1_id join cmp b on b.entity_id = cand_id
 where round(has_exact_rule * 0.5 + ({Q.dice('a.latin_compact', 'b.latin_compact')}) * 0.3 + ({Q.dice('a.addr_compact', 'b.addr_compact')}) * 0.2, 9) >= 0.5 group by 1) m on m.s1_id = l.source1_entity_id""", "lists", "cmp")
def run_c(spark, d):
    return run_of(spark, d, U.run_rules)


@register(f"""select * from (with hc as (select s1_id, cand_id, row_number() over (partition by s1_id order by best.r, best.place, cand_id)::int as rank from (
 select s.entity_id as s1_id, p.entity_id as cand_id, min({{'r': s."rule", 'place': p.place}}) as best from hkeys s join (
 select *, row_number() over (partition by "rule", country_key, bkey order by entity_id) as place from hkeys where entity_id not like 'S1-%') p
 on s."rule" = p."rule" and s.country_key = p.country_key and s.bkey = p.bkey and p.place <= case p."rule" when 'k1' then 20 when 'k4' then 0 else 10 end where s.entity_id like 'S1-%' group by 1, 2)),
 hs as (select s1_id, cand_id, round(0.5 * (1 - levenshtein(a.name_norm, b.name_norm) / greatest(length(a.name_norm), length(b.name_norm), 1)) + 0.3 * ({Q.jaccard('a.name_norm', 'b.name_norm', '1.0')})
 + 0.2 * ({Q.jaccard('a.addr_norm', 'b.addr_norm', '1.0')}), 9) as prob, round(jaro_winkler_similarity(a.name_norm, b.name_norm), 6) as jw from hc join nrm a on a.entity_id = s1_id join nrm b on b.entity_id = cand_id),
 cl as (select * from (select *, row_number() over (partition by cand_id order by prob desc, s1_id) as n from hs where prob >= 0.6) where n = 1),
 rs as (select * from (select *, row_number() over (partition by cand_id order by s1_id) as m from (select * from (select *, row_number() over (partition by s1_id order by prob desc, cand_id) as n from hs where s1_id not in (select s1_id from cl))
 where n = 1 and prob >= 0.25 and jw >= 0.85 and cand_id not in (select cand_id from cl))) where m = 1),
 mt as (select s1_id, string_agg(cand_id, ',' order by prob desc, cand_id) as ids from (select s1_id, cand_id, prob from cl union all select s1_id, cand_id, prob from rs) group by 1),
 ca as (select s1_id, string_agg(cand_id, ',' order by rank, cand_id) as ids from hc group by 1)
 select entity_id as source1_entity_id, coalesce(ca.ids, '') as candidate_entity_ids, coalesce(mt.ids, '') as matched_entity_ids from s1 left join ca on ca.s1_id = entity_id left join mt on mt.s1_id = entity_id)""", "hkeys", "s1")
def run_h(spark, d):
    return run_of(spark, d, U.run_prefixes)


@register()
def run_e(spark, d):
    return run_of(spark, d, U.run_vectors)


# Streaming.


@register("select s1_id, cand_id, matched_rules, has_exact_rule, rank from cands", "cands")
def incremental_candidates(spark, d):
    s1, pool = sides(spark, d)
    folder = workspace(spark, "arrivals") + "/s1"
    R.write_records(s1, folder)
    return I.resolve_all(spark, folder, pool)
