"""The results of the line, phrase and prefix-trie operators in SQL."""

from __future__ import annotations

_LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE: dict[str, str] = {
    "op11_prefix_trie": """
WITH own AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
               sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
    FROM conversations WHERE conv_id IS NOT NULL),
bits AS (  -- crc32 of the decimal id, eight shifts for each byte
    SELECT DISTINCT conv_id FROM own),
crc AS (
    SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
               string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ord(ch) AS BIGINT))),
               lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                   lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)), 4294967295::BIGINT) % 6 AS h
    FROM bits),
turns AS (
    SELECT c.conv_id, o.i, o.role, o.text FROM crc c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 100 WHERE o.i <= c.h
    UNION ALL
    SELECT c.conv_id, o.i + 1000000, o.role, o.text FROM crc c JOIN own o ON o.conv_id = c.conv_id WHERE o.i > c.h),
rebuilt AS (
    SELECT c.conv_id, coalesce(list(sha256(length(t.role) || ':' || t.role || t.text) ORDER BY t.i) FILTER (t.i IS NOT NULL), []) AS w,
           coalesce(list(length(t.text) ORDER BY t.i) FILTER (t.i IS NOT NULL), []) AS size
    FROM crc c LEFT JOIN turns t ON t.conv_id = c.conv_id GROUP BY c.conv_id),
prefixes AS (
    SELECT conv_id, d AS depth, md5(array_to_string(w[1:d], '')) AS node, md5(array_to_string(w[1:d - 1], '')) AS above,
           len(w) = d AS ends, CASE WHEN d = 0 THEN 0 ELSE size[d] END AS points
    FROM (SELECT conv_id, w, size, unnest(range(0, len(w) + 1)) AS d FROM rebuilt)),
nodes AS (
    SELECT node, any_value(CASE WHEN depth > 0 THEN above END) AS above, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs,
           (count(*) - 1) * any_value(points) AS saved,
           sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM prefixes GROUP BY node),
children AS (SELECT above, count(*) AS n FROM nodes WHERE above IS NOT NULL GROUP BY above),
below AS (  -- each node under all that are above it
    SELECT DISTINCT a.node, b.node AS under FROM prefixes a JOIN prefixes b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
sums AS (
    SELECT s.node, count(*) FILTER (c.n IS NULL) AS n_leaves, sum(n.saved) AS saved_tokens
    FROM below s JOIN nodes n ON n.node = s.under LEFT JOIN children c ON c.above = s.under GROUP BY s.node)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0)::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s USING (node) LEFT JOIN nodes p ON p.node = n.above LEFT JOIN children c ON c.above = n.node
""",
    "op12_prefix_free_phrases": f"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_LOW}), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents),
parsed AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (
    SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f
    FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM parsed, (VALUES (1), (2), (3)) sizes(m) WHERE len(w) >= m)
    GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE m = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM grams WHERE m > 1 AND f >= 10),
inside AS (
    SELECT lang, phrase, max(f) AS held
    FROM (SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM candidates WHERE m = 3)
    GROUP BY lang, phrase),
cuts AS (
    SELECT c.lang, c.phrase, c.f AS a, k, l.f AS l, r.f AS r,
           (1000000::HUGEINT * c.f * c.f) // (l.f::HUGEINT * r.f) AS score
    FROM (SELECT c.*, unnest(range(1, m)) AS k FROM candidates c LEFT JOIN inside i USING (lang, phrase)
          WHERE held IS NULL OR 100 * held < 50 * f) c
    JOIN grams l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
    JOIN grams r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:c.m], ' ')),
best AS (SELECT DISTINCT ON (lang, phrase) * FROM cuts ORDER BY lang, phrase, score, k),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
""",
    "op13_twice_seen_lines": f"""
WITH docs AS (SELECT row_number() OVER () AS nr, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT nr, doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM docs),
keyed AS (SELECT *, translate(trim(line, {_WHITE}), {_LOW}) AS key FROM lines),
repeated AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT nr) >= 5),
marked AS (
    SELECT k.*, r.key IS NOT NULL AND k.doc_id IS DISTINCT FROM r.last AS drops FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (drops) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT drops), '')) AS kept_sha256
FROM marked GROUP BY nr, doc_id
""",
}
