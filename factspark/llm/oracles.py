"""DuckDB SQL for the rows of those queries that SQL can express, over whole tables."""

from __future__ import annotations

from factspark.llm.lines import LEAST_WORDS
from factspark.llm.sentences import PAIR_WORDS, SPAN
from factspark.llm.suffix import LENGTH

_BLANK = "chr(9) || chr(11) || chr(12) || chr(13) || ' '"
_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"

# From pieces (doc_id, k, piece) and windows (doc_id, k, width, key) to the pieces that a later copy of a window covers, and the runs they make.
_REPEATS = """
     ranked as (select *, row_number() over (partition by width, key order by doc_id, k) as copy from windows),
     gone as (select distinct doc_id, unnest(range(k, k + width)) as k from ranked where copy > 1),
     marked as (select p.doc_id, p.k, p.piece, g.k is not null as drop from pieces p left join gone g on p.doc_id = g.doc_id and p.k = g.k),
     edged as (select *, drop and not coalesce(lag(drop) over (partition by doc_id order by k), false) as edge from marked),
     grouped as (select *, sum(edge::int) over (partition by doc_id order by k) as run from edged),
     long as (select doc_id, max(n) as longest from (select doc_id, run, count(*) as n from grouped where drop group by all) group by doc_id),
     summed as (select doc_id, count(*) as n, count(*) filter (drop) as removed, count(*) filter (edge) as runs,
                       coalesce(string_agg(piece, '' order by k) filter (not drop), '') as kept from edged group by doc_id)
"""

LINES = rf"""
with d as (select doc_id, coalesce(text, '') as text from documents),
     cut as (select doc_id, line, n, count(*) over (partition by doc_id) as lines, trim(line, {_BLANK}) as solid
             from (select doc_id, unnest(ls) as line, unnest(range(1, len(ls) + 1)) as n from (select doc_id, string_split(text, chr(10)) as ls from d))),
     placed as (select *, greatest(sum((solid <> '')::int) over (partition by doc_id order by n), 1) as k from cut),
     pieces as (select doc_id, k::bigint as k, string_agg(line || case when n < lines then chr(10) else '' end, '' order by n) as piece, max(solid) as solid,
                       len(regexp_extract_all(max(solid), '{_WORD}')) as words from placed group by all having max(solid) <> ''),
     pairs as (select *, lead(solid) over (partition by doc_id order by k) as following from pieces),
     windows as (select doc_id, k, 1 as width, solid as key from pieces where words >= {LEAST_WORDS}
                 union all select doc_id, k, 2, solid || chr(10) || following from pairs where following is not null),
{_REPEATS}
select doc_id, coalesce(n, 0)::bigint as n_lines, coalesce(removed, 0)::bigint as n_removed, coalesce(runs, 0)::bigint as n_runs, coalesce(longest, 0)::bigint as longest_run,
       coalesce(kept, text) as text
from d left join summed using (doc_id) left join long using (doc_id)
"""

# Sentences are cut by a control character after each end; a piece without a word, and what stands before a piece's first word, go to the one before.
SPANS = rf"""
with d as (select doc_id, coalesce(text, '') as text from documents),
     cut as (select doc_id, unnest(ps) as part, unnest(range(1, len(ps) + 1)) as n
             from (select doc_id, string_split(regexp_replace(regexp_replace(text, '([.!?])([\t\x0b\x0c\r ])', '\1' || chr(1) || '\2', 'g'), '\n', chr(10) || chr(1), 'g'), chr(1)) as ps from d)),
     worded as (select *, regexp_extract_all(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') as w,
                       length(regexp_extract(part, '^[^0-9A-Za-z\x{{80}}-\x{{10FFFF}}]*')) as before from cut),
     placed as (select *, sum((len(w) > 0)::int) over (partition by doc_id order by n) as k from worded),
     bits as (select doc_id, greatest(k, 1) as k, n, 1 as side, part as bit, null::varchar[] as w from placed where len(w) = 0
              union all select doc_id, greatest(k - 1, 1), n, 0, part[1 : before], null from placed where len(w) > 0
              union all select doc_id, k, n, 1, part[before + 1 :], w from placed where len(w) > 0),
     pieces as (select doc_id, k::bigint as k, string_agg(bit, '' order by n, side) as piece, array_to_string(any_value(w), ' ') as said, len(any_value(w)) as words
                from bits group by all having any_value(w) is not null),
     runs as (select *, {", ".join(f"lead(said, {j}) over o as s{j}, lead(words, {j}) over o as n{j}" for j in range(1, SPAN))} from pieces window o as (partition by doc_id order by k)),
     windows as (select doc_id, k, {SPAN} as width, {" || '|' || ".join(["said", *(f"s{j}" for j in range(1, SPAN))])} as key from runs where s{SPAN - 1} is not null
                 union all select doc_id, k, 2, said || '|' || s1 from runs where words + n1 >= {PAIR_WORDS}),
{_REPEATS}
select doc_id, coalesce(n, 0)::bigint as n_sentences, coalesce(removed, 0)::bigint as n_removed, coalesce(runs, 0)::bigint as n_runs, coalesce(kept, text) as text
from d left join summed using (doc_id)
"""

# Bytes as pairs of hexadecimal digits; blocks of 256 bytes keep the substrings cheap.
SUFFIXES = f"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
     blocks as (select doc_id, j, substring(x, 512 * j + 1, {512 + 2 * LENGTH - 2}) as y from (select doc_id, x, unnest(range(0, length(x) // 512 + 1)) as j from d)),
     w as (select doc_id, 256 * j + i as i, substring(y, 2 * i + 1, {2 * LENGTH}) as s from (select doc_id, j, y, unnest(range(0, least(256, length(y) // 2 - {LENGTH - 1}))) as i from blocks)),
     f as (select s, min(doc_id) as first from w group by s),
     bad as (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from w join f using (s) where first < doc_id),
     numbered as (select doc_id, i, sum((before is null or i > before + {LENGTH})::int) over (partition by doc_id order by i) as r from bad),
     spans as (select doc_id, r, min(i) as b, max(i) + {LENGTH} as e from numbered group by all),
     gaps as (select doc_id, b, e, coalesce(lag(e) over (partition by doc_id order by b), 0) as a from spans),
     cut as (select doc_id, sum(e - b) as removed, count(*) as n, string_agg(substring(x, 2 * a + 1, 2 * (b - a)), '' order by b) || substring(any_value(x), 2 * max(e) + 1) as kept
             from gaps join d using (doc_id) group by doc_id)
select doc_id, (length(x) // 2)::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(n, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, x))) as kept_sha256
from d left join cut using (doc_id)
"""


def _extra(column: str) -> str:
    """By how many characters escaping lengthens a text: one for each control string, backslash and closing bracket."""
    controls = ("<s>", "</s>", "[INST]", "[/INST]", "[TURN:", "[/TURN]", "\\", "]")
    return " + ".join(f"(length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in controls)


CHAT = f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
     s as (select *, length(text) + {_extra("text")} + case role when 'user' then length('<s>[INST]  [/INST]') when 'assistant' then length('</s>')
                     else length('[TURN:][/TURN]') + length(role) + {_extra("role")} end as chars from t),
     g as (select conv_id, count(*) as n, string_agg(role || chr(10) || text || chr(10), '' order by turn) as said,
                  coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '') as learned, sum(chars) as chars from s group by conv_id)
select conv_id, n::bigint as n_turns, sha256(said) as turns_sha256, length(learned)::bigint as loss_chars, sha256(learned) as loss_sha256, chars::bigint as formatted_chars from g
"""
