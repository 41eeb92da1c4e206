"""The same results in SQL, where SQL can express them over whole tables."""

from .oracle_more import ORACLE as MORE

ORACLE: dict[str, str] = {
    "op4_quotation_links": r"""
WITH RECURSIVE numbered AS (
    SELECT row_number() OVER () AS nr, conv_id, turn, role,
           string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)) AS lines
    FROM conversations),
lines AS (
    SELECT nr, conv_id, turn, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM numbered),
marked AS (
    SELECT *, regexp_extract(line, '^[ \t]*((>[ \t]*)*)') AS mark FROM lines),
leveled AS (
    SELECT nr, conv_id, turn, i, length(regexp_replace(mark, '[^>]', '', 'g')) AS level,
           CASE WHEN contains(mark, '>') THEN substr(line, length(mark) + 1) ELSE line END AS rest
    FROM marked),
edged AS (
    SELECT *, trim(rest, ' ' || chr(9)) = '' AS blank,
           lag(trim(rest, ' ' || chr(9)) = '') OVER w AS blank_before, lag(level) OVER w AS level_before,
           lead(level) OVER w AS level_behind
    FROM leveled WINDOW w AS (PARTITION BY nr ORDER BY i)),
islands AS (
    SELECT *, sum(CASE WHEN blank_before IS NULL OR blank_before OR level_before <> level THEN 1 ELSE 0 END)
              OVER (PARTITION BY nr ORDER BY i) AS island
    FROM edged WHERE NOT blank),
blocks AS (
    SELECT nr, conv_id, turn, level,
           sha256(translate(trim(regexp_replace(string_agg(rest, ' ' ORDER BY i), '[ \t]+', ' ', 'g')),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS key
    FROM islands GROUP BY nr, conv_id, turn, island, level),
bodies AS (
    SELECT nr, trim(coalesce(string_agg(rest, chr(10) ORDER BY i) FILTER (
        level = 0 AND NOT (coalesce(level_behind > 0, false)
                           AND regexp_matches(rest, '(wrote|writes|schrieb|écrit|escribió) ?:$'))), ''), chr(10)) AS body
    FROM edged GROUP BY nr),
origins AS (
    SELECT conv_id, key, min(turn) AS origin FROM blocks WHERE level = 0 GROUP BY conv_id, key),
linked AS (
    SELECT DISTINCT q.conv_id, q.turn, q.level, q.key, o.origin
    FROM blocks q JOIN origins o ON q.conv_id = o.conv_id AND q.key = o.key
    WHERE q.level > 0 AND o.origin < q.turn),
answers AS (
    SELECT conv_id, turn, arg_max(origin, ROW(-level, origin)) AS parent_turn, count(*) AS n_linked
    FROM linked GROUP BY conv_id, turn),
chains AS (
    SELECT conv_id, turn, parent_turn AS root_turn, 1 AS depth FROM answers
    UNION ALL
    SELECT c.conv_id, c.turn, a.parent_turn, c.depth + 1
    FROM chains c JOIN answers a ON a.conv_id = c.conv_id AND a.turn = c.root_turn),
roots AS (
    SELECT conv_id, turn, arg_max(root_turn, depth) AS root_turn, max(depth) AS depth FROM chains GROUP BY conv_id, turn),
counts AS (
    SELECT nr, count(*) FILTER (level > 0) AS n_quotes, max(level) AS max_level FROM blocks GROUP BY nr)
SELECT n.conv_id, n.turn, n.role, b.body, coalesce(c.n_quotes, 0)::BIGINT AS n_quotes,
       coalesce(a.n_linked, 0)::BIGINT AS n_linked, coalesce(c.max_level, 0)::BIGINT AS max_level, a.parent_turn,
       coalesce(r.root_turn, n.turn) AS root_turn, coalesce(r.depth, 0)::BIGINT AS depth
FROM numbered n JOIN bodies b USING (nr) LEFT JOIN counts c USING (nr)
LEFT JOIN answers a ON a.conv_id = n.conv_id AND a.turn = n.turn
LEFT JOIN roots r ON r.conv_id = n.conv_id AND r.turn = n.turn
""",
    "op2_suffix_decontamination": r"""
WITH items AS (
    SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark),
sized AS (SELECT item, w, least(10, len(w)) AS n FROM items WHERE len(w) > 0),
windows AS (
    SELECT DISTINCT item, n,
           unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS words
    FROM sized),
sizes AS (SELECT DISTINCT n FROM windows),
docs AS (
    SELECT row_number() OVER () AS nr, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
places AS (
    SELECT nr, n, unnest(range(1, len(w) - n + 2)) AS place,
           unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS words
    FROM docs, sizes WHERE len(w) >= n),
hits AS (SELECT p.nr, p.place, p.n, w.item FROM places p JOIN windows w ON p.n = w.n AND p.words = w.words),
covered AS (
    SELECT nr, count(DISTINCT word) AS n_hit
    FROM (SELECT nr, unnest(range(place, place + n)) AS word FROM (SELECT DISTINCT nr, place, n FROM hits)) GROUP BY nr),
named AS (
    SELECT nr, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
    FROM (SELECT DISTINCT nr, item FROM hits) GROUP BY nr)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (nr) LEFT JOIN named USING (nr)
""",
    "op6_capture_index": """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
marked AS (
    SELECT page_id, payload, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY payload) AS first FROM payloads),
parts AS (  -- five hex digits are four digits of base 32
    SELECT *, list_transform(range(8), lambda g: CAST('0x' || substr(hex, g * 5 + 1, 5) AS INTEGER)) AS twenty FROM marked)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(twenty, lambda v:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 15) + 1, 1)
           || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31) + 1, 1)
           || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31) + 1, 1)
           || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM parts
""",
} | MORE
