"""SQL for DuckDB of the queries that SQL can express."""

from __future__ import annotations

from quillstone.llm.chat import BUDGET, HISTORY, TOKEN, TURN_TOKENS
from quillstone.llm.license_texts import KNOWN, KNOWN_DIGESTS
from quillstone.llm.licenses import SPELLINGS

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    """The canonical form of a licence text, as an expression."""
    t = f"lower(coalesce({text}, ''))"
    t = rf"regexp_replace({t}, '(?m)^[^\p{{L}}\n]*(?:©|(?:copyright|\(c\))[^\n]*(?:\(c\)|©|\b(?:19|20)[0-9][0-9]\b))[^\n]*$', chr(10) || chr(10), 'g')"
    t = rf"regexp_replace({t}, '(?:\A|\n[ \t]*\n)[^\p{{L}}\n]*copyright(?:[ \t]+[^\x20\x09-\x0D]+){{1,8}}[ \t]*(?:\n[ \t]*\n|\n?\z)', chr(10) || chr(10), 'g')"
    t = rf"regexp_replace({t}, 'all[\x20\x09-\x0D]+rights[\x20\x09-\x0D]+reserved', ' ', 'g')"
    t = rf"regexp_replace(regexp_replace(' ' || {t} || ' ', '[\x20\x09-\x0D]+', '  ', 'g'), ' \(?(?:[0-9][0-9]?|[a-z])[.)] ', ' ', 'g')"
    t = rf"' ' || regexp_replace({t}, '[^\p{{L}}\p{{N}}]+', '  ', 'g') || ' '"
    for other, kept in SPELLINGS:
        t = f"replace({t}, ' {other} ', ' {kept} ')"
    return f"trim(regexp_replace({t}, ' +', ' ', 'g'))"


_OP1 = f"""
WITH known AS (SELECT * FROM (VALUES {", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, t in KNOWN)}) AS v(license, text)),
long AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{d}')" for k, d in KNOWN_DIGESTS)}) AS v(license, digest)),
digests AS (SELECT digest, min(license) AS license FROM (SELECT license, sha256({_canonical("text")}) AS digest FROM known UNION ALL SELECT license, digest FROM long) GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
notices AS (
    SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notice_ids
    FROM lines JOIN digests ON sha256({_canonical("line")}) = digest
    WHERE regexp_matches(line, '(?i)licen[cs]e|spdx') GROUP BY doc_id
)
SELECT d.doc_id, sha256({_canonical("text")}) AS text_digest, license AS license_id, notice_ids
FROM documents d LEFT JOIN digests ON sha256({_canonical("text")}) = digest LEFT JOIN notices n ON n.doc_id = d.doc_id
"""

_OP6 = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{_UP}', '{_LOW}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CHAR = lambda shift: f"substr('{_BASE32}', 1 + ((v // {1 << shift}) % 32)::INT, 1)"
_OP9 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
parts AS (SELECT page_id, g, ('0x' || substr(hex, 5 * g + 1, 5))::BIGINT AS v FROM p, range(8) AS r(g)),
b AS (SELECT page_id, string_agg({" || ".join(_CHAR(s) for s in (15, 10, 5, 0))}, '' ORDER BY g) AS payload_digest FROM parts GROUP BY page_id)
SELECT p.page_id, strlen(html)::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN p.page_id = max(p.page_id) OVER (PARTITION BY html) THEN 'response' ELSE 'revisit' END AS record_type,
       nullif(max(p.page_id) OVER (PARTITION BY html), p.page_id) AS refers_to
FROM p JOIN b USING (page_id)
"""

_TOKENS = f"len(regexp_extract_all(text, '{TOKEN}'))"


def _escaped(text: str) -> str:
    return rf"regexp_replace(replace({text}, '\', '\\'), '([<\[])(\|(?:im_start|im_sep|im_end|endoftext)\|>|/?s>|/?INST\]|</?SYS>>)', '\1\\\2', 'g')"


_MARKS = len("<|im_start|><|im_sep|><|im_end|>")
_OP10 = f"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, {_TOKENS} + {TURN_TOKENS} AS tokens,
      length({_escaped("role")}) + length({_escaped("text")}) + {_MARKS} AS chars FROM c),
q AS (SELECT *, pos = 1 AND lower(role) = 'system' AS sys, max(CASE WHEN pos = 1 AND lower(role) = 'system' THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS sys_tokens FROM r),
s AS (SELECT *, sys_tokens > {BUDGET // 2} AS alone, {BUDGET} - CASE WHEN sys_tokens > {BUDGET // 2} THEN 0 ELSE sys_tokens END AS room FROM q),
t AS (SELECT *, greatest(room * 3 // 8, 1) AS stretch, NOT sys AND tokens > greatest(room * 3 // 8, 1) AS long,
      coalesce(sum(CASE WHEN sys THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s),
u AS (SELECT *, coalesce(CASE WHEN lag(sys) OVER o THEN alone OR tokens > room ELSE lag(start // stretch) OVER o != start // stretch OR long OR lag(long) OVER o END, false)::INT AS opens,
      room - CASE WHEN lead(long) OVER o THEN lead(tokens) OVER o ELSE 0 END AS room_next FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY pos)),
v AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id ORDER BY pos) AS win FROM u),
w AS (SELECT *, max(win) OVER (PARTITION BY conv_id) AS last, row_number() OVER e AS nth, sum(tokens) OVER e AS from_end, first(room_next) OVER e AS room_left
      FROM v WINDOW e AS (PARTITION BY conv_id, win ORDER BY pos DESC)),
-- each turn once, the system turn again in windows that have room for it, the last turns again in the next window
f AS (SELECT conv_id, count(DISTINCT win) FILTER (tokens > room AND win > 0) AS without FROM w WHERE NOT sys GROUP BY conv_id),
x AS (SELECT w.*, chars * CASE WHEN sys THEN 1 + CASE WHEN alone THEN 0 ELSE last - coalesce(without, 0) END
        WHEN nth <= {HISTORY} AND from_end <= least(room // 4, room_left) AND win < last THEN 2 ELSE 1 END AS written FROM w LEFT JOIN f USING (conv_id))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (lower(role) = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (lower(role) = 'assistant'), '')) AS loss_sha256,
       sum(written)::BIGINT AS formatted_chars
FROM x GROUP BY conv_id
"""

ORACLES = {
    "op1_license_scan": _OP1,
    "op6_exact_dedup": _OP6,
    "op9_arc_to_warc": _OP9,
    "op10_chat_format": _OP10,
}
