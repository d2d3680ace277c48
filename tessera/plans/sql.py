"""Pieces of DuckDB SQL that the twins of the queries are put together from."""

from __future__ import annotations

from tessera.functions.blocking_keys import COMMON_ADDRESS_WORDS
from tessera.functions.text import ADDRESS_WORDS, LEGAL_ENDINGS, LEGAL_FORMS

R = lambda x, name: f"round({x}, 6) as {name}"


def norm(x: str) -> str:
    s = f"replace(lower(strip_accents(coalesce({x}, ''))), 'ß', 'ss')"
    s = rf"regexp_replace({s}, '([0-9]+)(st|nd|rd|th)\b', '\1th', 'g')"
    s = rf"regexp_replace({s}, '([0-9])([a-zA-Z])', '\1 \2', 'g')"
    s = rf"regexp_replace({s}, '([a-zA-Z])([0-9])', '\1 \2', 'g')"
    return rf"trim(regexp_replace({s}, '[^\p{{L}}\p{{N}}\p{{M}}]+', ' ', 'g'))"


def tokens(x: str) -> str:
    return rf"list_filter(string_split(trim(regexp_replace({x}, '\s+', ' ', 'g')), ' '), lambda t: t <> '')"


def expand(x: str, table: dict[str, str]) -> str:
    cases = " ".join(f"when '{k}' then '{v}'" for k, v in table.items())
    return f"coalesce(array_to_string(list_transform({tokens(x)}, lambda t: case t {cases} else t end), ' '), '')"


def norm_name(x: str) -> str:
    return expand(norm(x), LEGAL_FORMS)


def norm_addr(x: str) -> str:
    return expand(norm(x), ADDRESS_WORDS)


def norm_unicode(x: str) -> str:
    s = rf"regexp_replace(replace(replace(lower(coalesce({x}, '')), 'ß', 'ss'), '&', ' and '), '[^\p{{L}}\p{{N}}\p{{M}}_\s]', ' ', 'g')"
    return rf"trim(regexp_replace({s}, '\s+', ' ', 'g'))"


def strip_suffix(x: str) -> str:
    every = ", ".join(f"'{e}'" for e in LEGAL_ENDINGS)
    return rf"case when {x} in ({every}) then '' else trim(regexp_replace({x}, '^(.*?) ({'|'.join(LEGAL_ENDINGS)})$', '\1')) end"


def latin(x: str) -> str:
    return f"strip_accents(replace(coalesce({x}, ''), 'ß', 'ss'))"


def compact(x: str) -> str:
    return f"regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]', '', 'g')"


def nth(words: str, n: int) -> str:
    return f"coalesce(({words})[{n}], '')"


def long_words(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({latin(x)}), '[^a-z ]', '', 'g'), ' '), lambda t: length(t) >= 4)"


def numbers(x: str) -> str:
    return rf"regexp_extract_all({x}, '\b(\d+)\b', 1)"


def prefix3(x: str) -> str:
    s = rf"regexp_replace({x}, '\s+', '', 'g')"
    return f"case when {s} = '' then '__empty__' else substr({s}, 1, 3) end"


def stripped3(x: str) -> str:
    return prefix3(rf"trim(regexp_replace({x}, '^(the|shri|sri|dr|dba|inc|mr|ms|m/s|m\s*s|center|national|all|new|om)\s+', '', 'i'))")


def addr_key(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in COMMON_ADDRESS_WORDS)
    n = nth(numbers(x), 1)
    w = nth(rf"list_filter(regexp_extract_all({x}, '\b([a-zA-Z]{{4,}})\b', 1), lambda t: t not in ({stop}))", 1)
    return f"case when {n} <> '' and {w} <> '' then {n} || '_' || {w} when {n} <> '' then 'n_' || {n} when {w} <> '' then 'w_' || {w} else '__none__' end"


def word2(x: str) -> str:
    w = nth(tokens(x), 2)
    return f"case when {w} = '' then '__none__' else substr({w}, 1, 3) end"


def jaccard(a: str, b: str, empty: str) -> str:
    x, y = tokens(a), tokens(b)
    every = f"len(list_distinct(list_concat({x}, {y})))"
    return f"case when {every} = 0 then {empty} else len(list_distinct(list_intersect({x}, {y}))) / {every} end"


def dice(a: str, b: str) -> str:
    g = lambda c: f"list_distinct(case when length({c}) >= 3 then list_transform(range(1, length({c}) - 1), lambda i: substr({c}, i, 3)) else [{c}] end)"
    return f"case when {a} = {b} then 1.0 when {a} = '' or {b} = '' then 0.0 else 2 * len(list_intersect({g(a)}, {g(b)})) / (len({g(a)}) + len({g(b)})) end"


def soundex(x: str) -> str:
    letters = rf"regexp_replace(upper({x}), '[^\p{{L}}]', '', 'g')"
    d = f"regexp_replace(translate({letters}, 'BFPVCGJKQSXZDTLMNR', '111122222222334556'), '[^1-6]', '0', 'g')"
    for k in range(7):
        d = f"regexp_replace({d}, '{k}+', '{k}', 'g')"
    return f"case when {letters} = '' then '0000' else rpad(substr(substr({letters}, 1, 1) || replace(substr({d}, 2), '0', ''), 1, 4), 4, '0') end"


#: Common table expressions; each may use those before it.
CTES = {
    "er": r"""select 'S' || (1 + doc_id % 3) || '-' || lpad(doc_id::varchar, 7, '0') as entity_id, array_to_string(w[1:6], ' ') as business_name,
  n_chars::varchar || ' ' || array_to_string(w[7:12], ' ') as business_address, lang as country
  from (select *, string_split(regexp_replace("text", '[ \t\n\f\r]+', ' ', 'g'), ' ') as w from documents)""",
    "s1": "select * from er where entity_id like 'S1-%'",
    "pool": "select * from er where entity_id not like 'S1-%'",
    "doc_ids": "select 'S' || (1 + doc_id % 3) || '-' || lpad(doc_id::varchar, 7, '0') as id, \"text\" as t from documents",
    "truth": "select a.id as s1_id, b.id as cand_id from doc_ids a left join doc_ids b on a.t = b.t and b.id not like 'S1-%' where a.id like 'S1-%'",
    "org": """select 'S' || (1 + c_custkey % 3) || '-' || lpad(c_custkey::varchar, 7, '0') as entity_id, c_name as business_name, '' as business_address, n_name as country
  from customer join nation on c_nationkey = n_nationkey""",
    "nrm": f"select entity_id, {norm_name('business_name')} as name_norm, {norm_addr('business_address')} as addr_norm, case when trim(country) = '' then '__unknown__' else lower(trim(country)) end as country_key from er",
    "hkeys": f"""select entity_id, 'k1' as "rule", country_key, {prefix3('name_norm')} as bkey from nrm union all select entity_id, 'k2', country_key, {stripped3('name_norm')} from nrm
  union all select entity_id, 'k3', country_key, {addr_key('addr_norm')} from nrm union all select entity_id, 'k4', country_key, {word2('name_norm')} from nrm""",
    "cmp": f"""select *, upper(trim(country)) as country_norm, {compact('business_name')} as name_compact, {compact(latin('business_name'))} as latin_compact, {compact('business_address')} as addr_compact,
  regexp_extract(business_address, '[0-9]+') as addr_num, regexp_extract(lower(business_address), '[a-z]{{3,}}') as addr_word,
  {nth(long_words('business_name'), 1)} as name_tok1, {nth(long_words('business_name'), 2)} as name_tok2 from er""",
    "ckeys": """select entity_id, 1 as rule_id, latin_compact || '|' || country_norm as bkey from cmp where length(latin_compact) >= 3 and country_norm <> ''
  union all select entity_id, 2, name_compact || '|' || country_norm from cmp where length(name_compact) >= 3 and name_compact <> latin_compact and country_norm <> ''
  union all select entity_id, 3, left(latin_compact, 6) || '|' || country_norm from cmp where length(latin_compact) >= 6 and country_norm <> ''
  union all select entity_id, 4, addr_num || '|' || addr_word || '|' || country_norm from cmp where addr_num <> '' and length(addr_word) >= 3 and country_norm <> ''
  union all select entity_id, 5, name_tok1 || '|' || country_norm from cmp where length(name_tok1) >= 4 and country_norm <> ''
  union all select entity_id, 7, left(addr_compact, 10) || '|' || country_norm from cmp where length(addr_compact) >= 10 and country_norm <> ''
  union all select entity_id, 8, '[' || array_to_string(list_sort([latin_compact[1], latin_compact[2], latin_compact[3]]), ', ') || ']|' || country_norm from cmp where length(latin_compact) >= 3 and country_norm <> ''""",
    "posts": "select * from ckeys where entity_id not like 'S1-%' and bkey in (select bkey from ckeys where entity_id not like 'S1-%' group by bkey having count(*) <= 500)",
    "hits": """select s.entity_id as s1_id, p.entity_id as cand_id, count(distinct p.rule_id) as matched_rules, max(case when p.rule_id in (1, 2) then 1 else 0 end) as has_exact_rule
  from (select distinct entity_id, bkey from ckeys where entity_id like 'S1-%') s join posts p on s.bkey = p.bkey group by all""",
    "cands": "select * from (select *, row_number() over (partition by s1_id order by has_exact_rule desc, matched_rules desc, cand_id)::int as rank from hits) where rank <= 20",
    "scored": """select s1_id, cand_id, rank, ('0x' || substr(md5(s1_id || '|' || cand_id), 1, 6))::int / 16777215 as prob, ('0x' || substr(md5(cand_id || '|' || s1_id), 1, 6))::int / 16777215 as similarity, er.country
  from cands join er on er.entity_id = s1_id""",
    "claims": "select * from (select *, row_number() over (partition by cand_id order by prob desc, s1_id) as n from scored where prob >= 0.5) where n = 1",
    "pred": "select s1_id, cand_id from claims",
    "countries": "select entity_id as s1_id, country from s1",
    "per": """select i.s1_id, count(distinct t.cand_id) as n_true, count(distinct p.cand_id) as n_pred,
  count(distinct case when t.cand_id in (select cand_id from pred q where q.s1_id = i.s1_id) then t.cand_id end) as tp,
  count(distinct case when t.cand_id in (select cand_id from cands q where q.s1_id = i.s1_id) then t.cand_id end) as cand_tp
  from (select distinct s1_id from truth) i left join truth t on t.s1_id = i.s1_id left join pred p on p.s1_id = i.s1_id group by 1""",
    "prf": """select *, case when n_true = 0 then (n_pred = 0)::int::double when n_pred > 0 then tp / n_pred else 0.0 end as p,
  case when n_true = 0 then (n_pred = 0)::int::double else tp / n_true end as r from per""",
    "ent": "select *, case when n_true = 0 then p when p + r > 0 then 1.25 * p * r / (0.25 * p + r) else 0.0 end as f from prf",
    "lists": """select i.s1_id as source1_entity_id, coalesce(string_agg(cand_id, ',' order by rank, cand_id), '') as candidate_entity_ids
  from (select distinct entity_id as s1_id from s1) i left join cands c on c.s1_id = i.s1_id group by 1""",
}
_NEEDS = {
    "s1": ["er"], "pool": ["er"], "truth": ["doc_ids"], "nrm": ["er"], "hkeys": ["nrm"], "cmp": ["er"], "ckeys": ["cmp"], "posts": ["ckeys"], "hits": ["posts"], "cands": ["hits"],
    "scored": ["cands"], "claims": ["scored"], "pred": ["claims"], "countries": ["s1"], "per": ["truth", "pred", "cands"], "prf": ["per"], "ent": ["prf"], "lists": ["s1", "cands"],
}


def query(body: str, *names: str) -> str:
    """body after the expressions that it names, and those that they need."""
    used: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS.get(n, []):
            add(m)
        if n not in used:
            used.append(n)

    for n in names:
        add(n)
    return ("with " + ",\n".join(f"{n} as ({CTES[n]})" for n in used) + "\n" if used else "") + body
