"""DuckDB statements for the queries that SQL can express in full."""

from __future__ import annotations

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _FOLD + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
items AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
wins AS (
    SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS win
    FROM (SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM wins),
places AS (SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS win FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size)),
hits AS (SELECT r, places.size, i, item_id FROM places JOIN wins ON places.size = wins.size AND places.win = wins.win),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""


def _marks(text: str) -> str:
    """How many characters the template escapes in a text."""
    parts = [("\\", 1), ("<|", 2), ("<s>", 3), ("</s>", 4), ("[INST]", 6), ("[/INST]", 7)]
    return " + ".join(f"(length({text}) - length(replace({text}, '{m}', ''))) // {n}" for m, n in parts)


OP2 = f"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256,
    CAST(sum(length('<|turn|>') + length(role) + {_marks("role")} + length('<|text|>') + length(text) + {_marks("text")} + length('<|end|>')) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id
"""

OP10 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
r AS (SELECT page_id, html, strlen(html) AS n, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
    CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to
FROM r
"""

_ALL_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

PII_BASE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
c AS (SELECT doc_id, x, regexp_extract_all(x, '[0-9](?:[\x20-]?[0-9])+') AS cards, regexp_extract_all(x, '\+[0-9][\x20().0-9-]+[0-9]') AS phones,
    regexp_extract_all(x, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') AS ips, regexp_extract_all(x, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS emails FROM t),
d AS (SELECT *, list_filter(list_transform(cards, lambda m: regexp_replace(m, '[^0-9]', '', 'g')), lambda m: length(m) BETWEEN 12 AND 19) AS digits FROM c)
SELECT doc_id, CAST(len(emails) AS BIGINT) AS n_email,
    CAST(len(list_filter(ips, lambda m: list_max(list_transform(string_split(m, '.'), lambda p: CAST(p AS DOUBLE))) <= 255)) AS BIGINT) AS n_ip,
    CAST(len(list_filter(digits, lambda m: list_sum(list_transform(range(1, length(m) + 1), lambda i: CASE WHEN (length(m) - i) % 2 = 0 THEN CAST(m[i:i] AS INTEGER)
        ELSE (CAST(m[i:i] AS INTEGER) * 2) // 10 + (CAST(m[i:i] AS INTEGER) * 2) % 10 END)) % 10 = 0)) AS BIGINT) AS n_card,
    CAST(len(list_filter(phones, lambda m: length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 9 AND 15)) AS BIGINT) AS n_phone
FROM d
"""

MIXING_TARGETS = f"""
WITH d AS (SELECT doc_id, source, len({_ALL_WORDS}) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight, 3.0::DOUBLE * source_size AS most FROM s),
r AS (SELECT *, (SELECT sum(source_size) FROM s) - coalesce(sum(most) OVER before, 0) AS rest, (SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER before, 0) AS open
    FROM w WINDOW before AS (ORDER BY most / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, round(least(most, weight * (SELECT max(rest / open) FROM r)), 4) AS target
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""

QUALITY_BASE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x, {_ALL_WORDS} AS w FROM documents),
three AS (SELECT r, i, w[i:i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM three) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
b AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda v: length(v))), 0) AS BIGINT) AS word_chars,
    CAST(length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(string_split(x, chr(10)), lambda v: regexp_matches(v, '[^\x20\x09-\x0D]')) AS lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN covered USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b
"""
