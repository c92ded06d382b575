"""DuckDB SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

from .quality_rules import ALPHA, CUTOFFS, DELTA

SPACE = r"\x20\x09-\x0D"
FROM_A, TO_A = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


def _lower(x: str) -> str:
    return f"translate({x}, {FROM_A}, {TO_A})"


OP2 = rf"""
with p as (
  select page_id, url, case when url is null or strpos(url, '://') = 0 then '' else substr(url, strpos(url, '://') + 3) end rest from pages
), q as (
  select page_id, {_lower(r"regexp_extract(rest, '^[^/?#]*')")} host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') path from p
), k as (
  select *, case when host <> '' then regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(/|\.html)$', '') end canon from q
), n as (
  select *, count(*) over (partition by canon) copies from k
), r as (
  select n.*, u.verdict rv, u.rule,
    row_number() over (partition by page_id, n.host, n.path order by length(u.rule) desc nulls last) rk
  from n left join (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) v(verdict, rhost, rpath)
    on (n.host = v.rhost or ends_with(n.host, '.' || v.rhost)) and starts_with(n.path, v.rpath)
  left join lateral (select v.verdict, v.rhost || v.rpath rule) u on true
)
select page_id, host, path, rule, coalesce(rv, case when canon is not null and copies > 1 then 'block' else 'allow' end) verdict
from r where rk = 1
"""

OP3 = rf"""
with l as (
  select doc_id, text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) pos, unnest(string_split(coalesce(text, ''), chr(10))) line from documents
), k as (
  select *, {_lower(f"regexp_replace(regexp_replace(line, '[{SPACE}]+', ' ', 'g'), '^ | $', '', 'g')")} as nkey,
    coalesce(sum(length(line) + 1) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0)::bigint as off from l
), u as (
  select *, len(list_filter(string_split(nkey, ' '), lambda x: x <> '')) nw, case when nw >= 8 then 1 else 0 end counts from k
), f as (
  select *, first_value(doc_id) over w keeper, row_number() over w rn from u window w as (partition by case when counts = 1 then nkey else doc_id || ' ' || pos end, counts order by doc_id, pos)
), d as (
  select *, counts = 1 and rn > 1 gone from f
)
select doc_id, coalesce(sum(nw) filter (gone), 0)::bigint n_removed_words, count(*) filter (gone) n_removed, coalesce(sum(length(line)) filter (gone), 0)::bigint n_removed_chars, count(*) n_units,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) kept_sha256,
  coalesce(string_agg(off || ':' || length(line) || ':' || keeper, ',' order by pos) filter (gone), '') removed_spans
from d group by doc_id
"""

OP6 = rf"""
with recursive w as (
  select doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^{SPACE}]+') ws from documents
), s as (
  select doc_id, case when len(ws) >= 3 then list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')))
    when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end sh, len(ws) nw from w
), n as (select doc_id, len(sh)::bigint n, sh from s),
r as (
  select min(doc_id) rep, sig, any_value(sh) sh, any_value(n) n from (select *, md5(array_to_string(list_sort(sh), '|')) sig from n where n > 0) group by sig
), t as (select rep, n, unnest(sh) g from r),
x as (
  select a.rep a, b.rep b from t a join t b on a.g = b.g and a.rep < b.rep and 10 * a.n >= 9 * b.n and 10 * b.n >= 9 * a.n
  group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))
), e as (select a, b from x union select b, a from x),
c as (select rep node, rep root from r union select e.b, c.root from c join e on c.node = e.a),
m as (select node, min(root) comp from c group by node)
select n.doc_id, n.n n_shingles, coalesce(m.comp, n.doc_id) component_id
from n left join (select *, md5(array_to_string(list_sort(sh), '|')) sig from r) r2 on n.n > 0 and md5(array_to_string(list_sort(n.sh), '|')) = r2.sig
left join m on m.node = r2.rep
"""

OP7 = rf"""
with dw as (
  select doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents
), iw as (
  select item_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark
), win as (
  select distinct item_id, least(len(ws), 13) n, unnest(list_transform(range(1, len(ws) - least(len(ws), 13) + 2), lambda i: array_to_string(ws[i:i + least(len(ws), 13) - 1], ' '))) g from iw where len(ws) > 0
), sizes as (select distinct n from win),
dg as (
  select doc_id, n, unnest(range(1, len(ws) - n + 2)) p, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) g from dw, sizes where len(ws) >= n
), hit as (select dg.doc_id, dg.p, dg.n, win.item_id from dg join win on dg.n = win.n and dg.g = win.g),
pos as (select doc_id, count(distinct q) n_hit from (select distinct doc_id, unnest(range(p, p + n)) q from hit) group by doc_id),
its as (select doc_id, count(distinct item_id) n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) ids from hit group by doc_id)
select dw.doc_id, len(ws)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) contaminated
from dw left join pos using (doc_id) left join its using (doc_id)
"""

OP9 = rf"""
with l as (
  select doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) pos, unnest(string_split(coalesce(text, ''), chr(10))) line from documents
), k as (
  select *, {_lower(f"regexp_replace(line, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')")} as nkey from l
), o as (select nkey, min(doc_id) own, count(distinct doc_id) n from k where length(nkey) >= 10 group by nkey),
d as (select k.*, coalesce(o.n > 1 and k.doc_id <> o.own, false) gone from k left join o on k.nkey = o.nkey)
select doc_id, count(*) n_lines, count(*) filter (gone) n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) kept_sha256
from d group by doc_id
"""

_R = len(CUTOFFS)
_TESTS = " union all ".join(
    f"select stratum, '{m}' as rule, {i} step, {c}::double cutoff, count(*) n, count(*) filter ({m} > {c}) r from good group by stratum" for m, cs in CUTOFFS.items() for i, c in enumerate(cs)
)
_RATE = ALPHA / _R
OP10 = rf"""
with w as (
  select doc_id, coalesce(lang, 'und') stratum, coalesce(text, '') t, sha256(coalesce(text, '')) th, regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+') ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) ls from documents
), g as (
  select doc_id, unnest(range(1, len(ws) - 6)) p, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' '))) g from w where len(ws) >= 8
), tw as (select doc_id, p from (select *, count(*) over (partition by doc_id, g) c from g) where c > 1),
rep as (select doc_id, count(distinct q) n from (select doc_id, unnest(range(p, p + 8)) q from tw) group by doc_id),
b as (
  select w.doc_id, stratum, th, len(ws)::bigint n_words, length(regexp_replace(t, '[{SPACE}]+', '', 'g'))::bigint word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint n_symbols, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines,
    coalesce(rep.n, 0)::bigint n_repeat_words, len(ls)::bigint n_lines, length(regexp_replace(t, '[^A-Z]+', '', 'g')) n_caps
  from w left join rep using (doc_id)
), m as (
  select *, case when n_words > 0 then n_symbols / n_words::double else 0 end symbol_ratio, case when word_chars > 0 then n_caps / word_chars::double else 0 end caps_ratio,
    case when n_lines > 0 then n_dup_lines / n_lines::double else 0 end dup_line_ratio, case when n_words > 0 then n_repeat_words / n_words::double else 0 end repeat_ratio,
    n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed
  from b
), good as (
  select stratum, th, {", ".join(f"max({x}) as {x}" for x in CUTOFFS)}
  from m semi join (select doc_id from labels group by doc_id having min(quality) = 1) l using (doc_id) group by stratum, th
),
tests as ({_TESTS}),
pv as (
  select *, case when r < n * {_RATE!r} then
    list_sum(list_transform(range(0, r + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({_RATE!r}) + (n - k) * ln(1 - {_RATE!r})))) else 1 end p,
    (select count(distinct stratum) from good) s
  from tests
), walked as (select *, min(case when p <= {DELTA} / (s * {_R}) then 1 else 0 end) over (partition by stratum, rule order by step rows between unbounded preceding and current row) ok from pv),
cuts as (select stratum, {", ".join(f"min(cutoff) filter (ok = 1 and rule = '{m}') cut_{m}" for m in CUTOFFS)} from walked group by stratum)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not ({" or ".join(f"coalesce({m} > cut_{m}, false)" for m in CUTOFFS)}) kept
from m left join cuts using (stratum)
"""

ORACLE_SQL = {
    "op2_url_filters": OP2,
    "op3_substring_dedup": OP3,
    "op6_ngram_jaccard_join": OP6,
    "op7_decontamination": OP7,
    "op9_line_dedup": OP9,
    "op10_quality_rules": OP10,
}
