"""SQL twins of operators that run outside SQL."""

from __future__ import annotations

OP4_SQL = r"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+') as w from documents
), p as (
  select r, unnest(w) as word, unnest(range(len(w))) as pos, len(w) as n from d
), k as (
  select *, case when pos + 35 <= n then md5(string_agg(word, ' ') over (partition by r order by pos rows between current row and 34 following)) end as h from p
), s as (
  select *, h is not null and count(*) over (partition by h) > 1 as again from k
), c as (
  select *, bool_or(again) over (partition by r order by pos rows between 34 preceding and current row) as gone from s
), g as (
  select r, count(*) filter (where gone) as n_removed, string_agg(word, ' ' order by pos) filter (where not gone) as kept from c group by r
)
select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join g on d.r = g.r
"""

OP10_SQL = r"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), i as (
  select item_id, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null
), v as (
  select distinct item_id, least(len(w), 13) as n, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda s: array_to_string(w[s:s + 12], ' '))) as k from i where len(w) > 0
), m as (
  select r, l.n, unnest(range(1, len(w) - l.n + 2)) as s, unnest(list_transform(range(1, len(w) - l.n + 2), lambda s: array_to_string(w[s:s + l.n - 1], ' '))) as k from d, (select distinct n from v) l where len(w) >= l.n
), f as (
  select r, m.n, s, item_id from m join v on m.n = v.n and m.k = v.k
), h as (
  select r, count(distinct pos) as n_hit from (select r, unnest(range(s, s + n)) as pos from f) group by r
), t as (
  select r, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct r, item_id::varchar as id from f) group by r
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join h on d.r = h.r left join t on d.r = t.r
"""
