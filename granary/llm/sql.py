"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .licenses import BETWEEN, BY_LINE, LONGEST_NOTICE, NAMES, NOTICE, PART_OF, RULES, SENTENCES, SPDX_LINE, TITLE, TITLE_WORD, WRAPPED, ordered_pattern

_EXACT = r"""
with flat as (
  select doc_id, coalesce(length(text), 0) as n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as t
  from documents
)
select doc_id,
       first_value(doc_id) over w as keep_id,
       count(*) over (partition by t) as group_size,
       row_number() over w = 1 as kept,
       sha256(t) as text_sha256
from flat window w as (partition by t order by n desc, doc_id)
"""

_SECRETS = r"""
with parts as (
  select doc_id, coalesce(text, '') as text from documents
), pieces as (
  select doc_id, kind, rx, list_prepend('', regexp_extract_all(text, rx)) as found,
         regexp_split_to_array(text, rx) as gaps
  from parts, (values ('assign', '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+', 0),
                      ('access', 'AKIA[A-Z0-9]+', 1), ('hex', '[0-9a-f]+', 2)) k(kind, rx, ord)
  where kind <> 'hex' or regexp_matches(text, '[0-9a-f]{32}')
), spans as (
  select doc_id, kind, found[i] as m,
         list_sum(list_transform(gaps[1:i - 1], lambda g: length(g)))
           + coalesce(list_sum(list_transform(found[1:i - 1], lambda g: length(g))), 0) as a
  from (select doc_id, kind, found, gaps, unnest(range(2, len(found) + 1)) as i from pieces)
), kept as (
  select doc_id, kind, a::bigint as a, (a + length(m))::bigint as b from spans
  where case kind when 'assign' then
               length(regexp_extract(m, '(?i)^(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 8
             when 'access' then length(m) >= 16 else length(m) >= 32 end
), ours as (
  select doc_id,
         count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
         string_agg(kind || ':' || a || ':' || b, ',' order by a, case kind when 'assign' then 0 when 'access' then 1 else 2 end) as spans
  from kept group by doc_id
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from documents left join ours using (doc_id)
"""

_SHINGLES = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
  from documents
), sets as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
         else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end as ss
  from w
), flat as (select doc_id, len(ss) as n, unnest(ss) as s from sets),
pairs as (
  select x.doc_id as a, y.doc_id as b, x.n as n, y.n as m, count(*) as k
  from flat x join flat y on x.s = y.s and x.doc_id < y.doc_id and 100 * least(x.n, y.n) >= 75 * greatest(x.n, y.n)
  group by all
), links as (
  select a, b from pairs where 100 * k >= 75 * (n + m - k)
  union select b, a from pairs where 100 * k >= 75 * (n + m - k)
), reach(doc_id, root) as (
  select doc_id, doc_id from documents
  union
  select l.b, r.root from reach r join links l on l.a = r.doc_id
)
select s.doc_id, len(ss)::bigint as n_shingles, c.component_id
from sets s join (select doc_id, min(root) as component_id from reach group by doc_id) c using (doc_id)
"""

_DECONTAMINATE = r"""
with lowered as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from documents
), items as (
  select item_id::varchar as item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from benchmark
), windows as (
  select distinct item_id, least(len(ws), 10) as size, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') as win
  from (select item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) as i from items where len(ws) > 0)
), sizes as (select distinct size from windows),
spots as (
  select doc_id, pos, w.item_id, w.size
  from (select doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) as pos from lowered, sizes) d
  join windows w on w.size = d.size and w.win = array_to_string(d.ws[d.pos:d.pos + d.size - 1], ' ')
), hits as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(pos, pos + size)) as p from spots) group by doc_id
), named as (
  select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
  from (select distinct doc_id, item_id from spots) group by doc_id
)
select l.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from lowered l left join hits using (doc_id) left join named using (doc_id)
"""

_LINES = r"""
with lines as (
  select doc_id, i, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents)
), keys as (
  select k, min(doc_id) as first from lines where length(k) >= 10 group by k having min(doc_id) < max(doc_id)
), marked as (
  select doc_id, i, line, coalesce(first < doc_id, false) as gone from lines left join keys using (k)
)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""

_AUDIT = r"""
with parts as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as ws
  from documents
), judged as (
  select part, t, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
         [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
          regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) over (partition by t), false)] as fails
  from parts left join (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id) using (doc_id)
), masks as (
  select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from judged group by all
), letters(x, k) as (values ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)),
orders as (
  select a.x || b.x || c.x || d.x || e.x as filter_order, [a.k, b.k, c.k, d.k, e.k] as ks
  from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
), steps as (
  select part, filter_order, step, ks[step] as k, fails, n, good, toxic,
         fails[ks[step]] as own, len(list_filter(ks[1:step - 1], lambda j: fails[j])) > 0 as gone
  from masks, orders, range(1, 6) r(step)
), found as (
  select part, filter_order, step::int as step, k,
         coalesce(sum(n) filter (not own and not gone), 0)::bigint as kept, coalesce(sum(n) filter (own and not gone), 0)::bigint as removed,
         coalesce(sum(n) filter (own and gone), 0)::bigint as redundant,
         coalesce(sum(n) filter (own and len(list_filter(fails, lambda f: f)) = 1), 0)::bigint as unique_fails,
         coalesce(sum(good) filter (own and not gone), 0)::bigint as good_lost, coalesce(sum(toxic) filter (own and not gone), 0)::bigint as toxic_lost
  from steps group by all
)
select * exclude (k), (sum(removed) over (partition by part, k))::bigint as shapley from found
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _licenses() -> str:
    known = ", ".join(f"({_quoted(s)}, {_quoted(n)})" for n, s in SENTENCES.items())
    spoken = ", ".join(f"({_quoted(n)}, {_quoted(license)})" for n, license in NAMES.items())
    names = list(dict.fromkeys(name for name, _, _ in RULES))

    def holds(identifiers: list[str]) -> str:
        p = _quoted(ordered_pattern(identifiers))
        return f"(regexp_matches(wrapped, {p}) or regexp_matches(by_line, {p}))"

    rules = []
    for name in names:
        cases = " ".join(f"when {holds(ids)} then {_quoted(f'{name}:{rule}')}" for own, rule, ids in RULES if own == name)
        first = f"case {cases} end"
        if name in PART_OF:
            other = " or ".join(holds(ids) for own, _, ids in RULES if own == PART_OF[name])
            first = f"case when not ({other}) then {first} end"
        rules.append(first)

    def sequence(ends: str, name: str) -> str:
        return f"""
{name} as (
  select doc_id, ',' || string_agg(name || ',', '' order by i) as {name}, count(*) as n_{name} from (
    select doc_id, i, coalesce(known.name, case when length(sentence) <= {LONGEST_NOTICE} then case when sentence like 'spdx %' then p.license || '~spdx'
             else coalesce(n.license || '~notice', case when regexp_matches(sentence, {_quoted(TITLE_WORD)}) then t.license || '~title' end) end end) as name
    from (
      select doc_id, i, trim(regexp_replace(s, {_quoted(BETWEEN)}, ' ', 'g')) as sentence
      from (select doc_id, unnest(ss) as s, generate_subscripts(ss, 1) as i
            from (select doc_id, regexp_split_to_array(t, {_quoted(ends)}) as ss from lowered))
    ) left join known using (sentence)
    left join spoken n on n.name = regexp_extract(sentence, {_quoted(NOTICE)}, 1) left join spoken t on t.name = regexp_extract(sentence, {_quoted(TITLE)}, 1)
    left join spoken p on p.name = regexp_extract(sentence, {_quoted(SPDX_LINE)}, 1)
  ) where name is not null group by doc_id
)"""

    return f"""
with known(sentence, name) as (values {known}), spoken(name, license) as (values {spoken}),
lowered as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ“”‘’', 'abcdefghijklmnopqrstuvwxyz    ') as t from documents
),
{sequence(WRAPPED, "wrapped")},
{sequence(BY_LINE, "by_line")},
both_ways as (
  select doc_id, coalesce(wrapped, ',') as wrapped, coalesce(by_line, ',') as by_line,
         coalesce(n_wrapped, 0) as n_wrapped, coalesce(n_by_line, 0) as n_by_line
  from documents left join wrapped using (doc_id) left join by_line using (doc_id)
), ruled as (
  select *, list_filter([{", ".join(rules)}], lambda r: r is not null) as rs from both_ways
)
select doc_id, greatest(n_wrapped, n_by_line)::bigint as n_sentences,
       trim(case when n_wrapped > n_by_line then wrapped else by_line end, ',') as sentences,
       array_to_string(rs, ',') as rules,
       array_to_string(list_transform(rs, lambda r: string_split(r, ':')[1]), ',') as licenses
from ruled
"""


SQL = {
    "op1_exact_dedup": _EXACT,
    "op2_secret_scan": _SECRETS,
    "op4_ngram_jaccard_join": _SHINGLES,
    "op6_decontamination": _DECONTAMINATE,
    "op9_license_scan": _licenses(),
    "op10_line_dedup": _LINES,
    "op12_filter_audit": _AUDIT,
}
