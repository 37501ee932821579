"""The SQL of those queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

#: Mask bits 1, 2, 4, 8, 16 stand for A to E.
OP11 = rf"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
m AS (SELECT d.doc_id, part, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask, coalesce(quality, 0) = 1 AS good, coalesce(toxic, 0) = 1 AS toxic
    FROM d LEFT JOIN (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 END) AS quality, max(CASE WHEN toxic = 1 THEN 1 END) AS toxic FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id),
cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY 1, 2),
letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
prefixes(filter_order, before, bit, done) AS (SELECT '', 0, 0, 0 UNION ALL SELECT filter_order || letter, done, letters.bit, done | letters.bit FROM prefixes, letters WHERE done & letters.bit = 0),
steps AS (SELECT c.part, p.filter_order AS prefix, coalesce(sum(n) FILTER (mask & done = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails, coalesce(sum(good) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS toxic_lost FROM cells c, prefixes p WHERE p.filter_order <> '' GROUP BY 1, 2),
every AS (SELECT s.part, p.filter_order, CAST(length(prefix) AS INTEGER) AS step, s.* EXCLUDE (part, prefix) FROM prefixes p JOIN steps s ON starts_with(p.filter_order, s.prefix) WHERE length(p.filter_order) = 5)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
    CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)) AS BIGINT) AS shapley FROM every"""

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12 = rf"""WITH q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
d AS (SELECT doc_id, len(terms) AS n, terms FROM (SELECT doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL) WHERE len(terms) > 0),
s AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM d),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
w AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, big_n),
x AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l)))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY 1, 2)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM x WHERE score > 0) WHERE place <= 50"""

_ESC = r"replace(replace(replace({0}, '\', '\0'), '###', '\1'), '</turn>', '\2')"

OP13 = rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, turn, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) x(turn, role)),
r AS (SELECT *, coalesce(role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), true) AS opens FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length({_ESC.format('text')}) + 7 + CASE WHEN opens THEN length(replace({_ESC.format('role')}, chr(10), '\3')) + 6 ELSE 0 END) AS BIGINT) AS formatted_chars FROM r GROUP BY 1"""
