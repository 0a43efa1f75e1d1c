"""DuckDB SQL for the queries that SQL can express in reasonable time: quality rules, decontamination, n-gram join.

The others need a tokenizer, a trained model, an automaton or patterns with lookaround; tests hold them against
brute-force versions, round trips and held-out labels.
"""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^ \t\n\v\f\r]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

QUALITY = rf"""
with t as (select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, {_SPACED}) as words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\v\f\r]')) as lines from t),
grams as (select rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as g from (select rid, words, unnest(range(1, len(words) - 1)) as i from w) as x),
twice as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as k from grams) as x where k > 1),
rep as (select rid, count(distinct p) as n from (select rid, unnest([i, i + 1, i + 2]) as p from twice) as x group by rid),
t1 as (select w.rid, doc_id, lang, source, cast(len(words) as bigint) as n_words, length(regexp_replace(t, '[ \t\n\v\f\r]+', '', 'g')) as word_chars,
  length(t) - length(translate(t, '#*$%&|<>', '')) as n_symbols, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words, cast(len(lines) as bigint) as n_lines
  from w left join rep on rep.rid = w.rid),
r as (select *, 1000 * n_symbols // greatest(word_chars, 1) as r1, 1000 * n_dup_lines // greatest(n_lines, 1) as r2, 1000 * n_repeat_words // greatest(n_words, 1) as r3, 100 * word_chars // greatest(n_words, 1) as r4,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from t1),
b as (select *, (r1 >> greatest(length(bin(r1)) - 6, 0)) << greatest(length(bin(r1)) - 6, 0) as b1, (r2 >> greatest(length(bin(r2)) - 6, 0)) << greatest(length(bin(r2)) - 6, 0) as b2, (r3 >> greatest(length(bin(r3)) - 6, 0)) << greatest(length(bin(r3)) - 6, 0) as b3, (r4 >> greatest(length(bin(r4)) - 6, 0)) << greatest(length(bin(r4)) - 6, 0) as b4 from r),
u as (select lang, source, k, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) as v from
  (select lang, source, unnest([1, 2, 3, 4]) as k, unnest([r1, r2, r3, r4]) as v from r where not base_failed) as x),
sketch as (select lang, source, k, v, count(*) as n from u group by all),
groups as (select lang, source, false as whole, k, v, n from sketch union all select lang, null, true, k, v, sum(n) from sketch group by lang, k, v),
c as (select *, sum(n) over (w order by v) as upto, sum(n) over w as total, lead(v) over (w order by v) as above, lag(v) over (w order by v) as below, case when k in (2, 3) then 980 else 900 end as share, case k when 1 then 20 when 2 then 50 else 30 end as unit from groups window w as (partition by lang, source, whole, k)),
m as (select *, min(v) filter (where 2 * upto >= total) over (partition by lang, source, whole, k) as mid from c),
f as (select lang, source, whole, k, any_value(total) as total, any_value(mid) as mid, min(v) filter (where 1000 * upto >= share * total) as edge, max(v) filter (where 1000 * (total - upto + n) >= share * total) as low_edge,
  min(struct_pack(pos := v, gap := above - v)) filter (where 1000 * upto >= share * total and above - v >= greatest(unit, v - mid)) as hi,
  max(struct_pack(pos := v, gap := v - below)) filter (where 1000 * (total - upto + n) >= share * total and v - below >= greatest(unit, mid - v)) as lo
  from m group by lang, source, whole, k),
g as (select lang, source, whole, k, total, mid, edge, low_edge, hi.pos + hi.gap // 2 as hi, lo.pos - lo.gap // 2 as lo from f),
own as (select o.lang, o.source, o.k,
  case when o.total < 100 or (o.edge > l.hi and o.mid <= l.hi) then l.hi else o.hi end as hi, case when o.total < 100 or (o.low_edge < l.lo and o.mid >= l.lo) then l.lo else o.lo end as lo
  from g as o join g as l on l.whole and not o.whole and o.lang is not distinct from l.lang and o.k = l.k),
j as (select r.*, not exists (select 1 from own where r.lang is not distinct from own.lang and r.source is not distinct from own.source
  and (case own.k when 1 then b1 when 2 then b2 when 3 then b3 else b4 end > own.hi or (own.k = 4 and b4 < own.lo))) as inside from b as r)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and inside as kept from j
"""

DECONTAMINATION = rf"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) as words from documents),
b as (select item_id, regexp_extract_all({_LOWER}, {_ALNUM}) as words from benchmark),
win as (select distinct item_id, size, array_to_string(words[i:i + size - 1], ' ') as w from (select item_id, words, size, unnest(range(1, len(words) - size + 2)) as i from (select *, least(len(words), 13) as size from b where len(words) > 0) as x) as y),
sizes as (select distinct size from win),
place as (select rid, size, i, array_to_string(words[i:i + size - 1], ' ') as w from (select rid, words, size, unnest(range(1, len(words) - size + 2)) as i from d cross join sizes where len(words) >= size) as x),
hit as (select rid, item_id, win.size, i from place join win on win.size = place.size and win.w = place.w),
covered as (select rid, count(distinct p) as n from (select rid, unnest(range(i, i + size)) as p from (select distinct rid, i, size from hit) as x) as y group by rid),
items as (select rid, count(*) as n, string_agg(item, ',' order by item) as listed from (select distinct rid, cast(item_id as varchar) as item from hit) as x group by rid),
r as (select d.doc_id, cast(len(words) as bigint) as n_words, coalesce(c.n, 0) as n_hit, coalesce(i.n, 0) as n_items, sha256(coalesce(i.listed, '')) as items_sha256 from d left join covered as c on c.rid = d.rid left join items as i on i.rid = d.rid)
select *, n_hit > 0 and 20 * n_hit >= n_words as contaminated from r
"""

NGRAM_JOIN = rf"""
with recursive d as (select row_number() over () as rid, doc_id, regexp_extract_all({_LOWER}, {_SPACED}) as words from documents),
s as (select distinct rid, case when len(words) < 4 then array_to_string(words, ' ') else array_to_string(words[i:i + 3], ' ') end as g
  from (select rid, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) as i from d where len(words) > 0) as x),
sized as (select *, count(*) over (partition by rid) as n from s),
pairs as (select a.rid as a, b.rid as b, count(*) as k, any_value(a.n) as na, any_value(b.n) as nb from sized as a join sized as b on a.g = b.g and a.rid < b.rid where 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) group by a.rid, b.rid),
links as (select a, b from pairs where 100 * k >= 85 * (na + nb - k)),
sides as (select a, b from links union all select b, a from links),
reach(rid, other) as (select rid, rid from d union select reach.rid, sides.b from reach join sides on sides.a = reach.other),
least_id as (select reach.rid, min(d.doc_id) as component_id from reach join d on d.rid = reach.other group by reach.rid)
select d.doc_id, coalesce(n.n, 0) as n_shingles, l.component_id from d join least_id as l on l.rid = d.rid left join (select rid, count(*) as n from s group by rid) as n on n.rid = d.rid
"""

SQL: dict[str, str] = {"op1_quality_rules": QUALITY, "op4_decontamination": DECONTAMINATION, "op9_ngram_join": NGRAM_JOIN}
