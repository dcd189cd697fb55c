"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

#: The counts of the quality rules, then the beta prior over hosts.
_RULES = rf"""
with docs as (
  select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{WORD}') as w
  from documents),
runs as (
  select doc_id, i, list_aggregate(w[i:i+4], 'string_agg', ' ') as run
  from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from docs where len(w) >= 5)),
repeated as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, run) as n from runs) where n > 1),
covered as (
  select doc_id, count(distinct i + k) as n from repeated, (select unnest(range(0, 5)) as k) group by doc_id),
lines as (
  select doc_id, count(*) - count(distinct line) as n
  from (select doc_id, unnest(string_split(text, chr(10))) as line from docs)
  where regexp_matches(line, '{WORD}') group by doc_id),
counts as (
  select d.doc_id, d.source, len(d.w)::bigint as n_words,
    length(regexp_replace(d.text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
    (length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    coalesce(l.n, 0)::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words
  from docs d left join lines l on l.doc_id = d.doc_id left join covered c on c.doc_id = d.doc_id),
judged as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from counts),
hosts as (
  select source, count(*) as n, sum(base_failed::bigint) as failed from judged where source is not null group by source),
mean as (select sum(n) as n_all, sum(failed)::double / sum(n) as m from hosts),
var as (select sum(n * power(failed::double / n - m, 2)) / any_value(n_all) as v from hosts, mean),
prior as (select m, case when v > 0 then greatest(m * (1 - m) / v - 1, 0) end as k from mean, var),
bad as (
  select source from hosts, prior
  where case when k is null then m else (failed + m * k) / (n + k) end > 0.5)
"""

SQL: dict[str, str] = {
    "op9_quality_rules": _RULES + """
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and (source is null or source not in (select source from bad)) as kept
from judged""",
    "op1_line_dedup": rf"""
with lines as (
  select doc_id, source, line, pos, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as form
  from (select doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) as line,
      unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) as pos from documents)),
spread as (
  select form, min(doc_id) as first_doc from lines
  where len(regexp_extract_all(line, '{WORD}')) >= 1
  group by form having count(distinct source) >= 8),
firsts as (
  select l.form, l.doc_id, min(l.pos) as pos from lines l join spread s on s.form = l.form and s.first_doc = l.doc_id
  group by l.form, l.doc_id),
marked as (
  select l.*, s.form is not null and not (l.doc_id = f.doc_id and l.pos = f.pos) as cut
  from lines l left join spread s on s.form = l.form left join firsts f on f.form = l.form)
select doc_id, count(*)::bigint as n_lines, sum(cut::bigint)::bigint as n_removed,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not cut), '')) as kept_sha256
from marked group by doc_id""",
    "op13_lexical_search": r"""
with folded as (select row_number() over () as row_id, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
  words as (select row_id, doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from folded),
  held as (select row_id, doc_id, term, count(*)::bigint as tf from words group by all),
  docs as (select row_id, sum(tf)::bigint as n from held group by 1),
  corpus as (select count(*)::bigint as big_n, sum(n)::bigint as big_l from docs),
  terms as (select term, floor(1000 * ln((2.0::double * big_n + 2) / (2.0::double * count(*) + 1)))::bigint as w from held, corpus group by term, big_n),
  asked as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
  scored as (select item_id, row_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l))))::bigint as score
    from asked join terms using (term) join held using (term) join docs using (row_id), corpus group by all)
select item_id, rank::int as rank, doc_id, score from (
  select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0) where rank <= 50""",
}
