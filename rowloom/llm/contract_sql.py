"""DuckDB SQL of operators 11 and 12, whose contracts need a CRC-32 that DuckDB does not have."""

from __future__ import annotations

#: A table `crc_table` of one row: the 256 entries of the CRC-32 of zlib.
CRC_TABLE = """
    crc_bits AS (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), [CAST(x AS BIGINT) for x in range(8)]),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(i)),
    crc_table AS (SELECT list(v ORDER BY i) AS entries FROM crc_bits)"""


def crc32(text: str) -> str:
    """The unsigned CRC-32 of a string's UTF-8; needs `crc_table` in the FROM clause."""
    octets = f"[CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT) for i in range(octet_length(encode({text})))]"
    step = "lambda c, x: xor(c >> 8, entries[(xor(c, x) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), {step}), 4294967295)"


VARIANTS = f"""
    WITH RECURSIVE {CRC_TABLE},
    runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]{{6,}}')) AS run FROM documents),
    lowered AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id,
            translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs GROUP BY 1, 2),
    hashed AS (SELECT run, n, {crc32("doc_id || ':' || run")} AS h FROM lowered, crc_table),
    damaged AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
    words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM damaged WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
    places AS (SELECT word, n, unnest(range(0, length(word) + 1)) AS i FROM words),
    splits AS (SELECT word, n, i, substr(word, 1, i) AS p, substr(word, i + 1) AS s FROM places),
    skips AS (SELECT word, n, i, substr(word, 1, i) AS p, substr(word, i + 2) AS s FROM places WHERE i < length(word)),
    near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM skips a JOIN skips b ON a.i = b.i AND a.p = b.p AND a.s = b.s AND a.word != b.word
        UNION SELECT a.word, b.word, b.n FROM skips a JOIN splits b ON a.i = b.i AND a.p = b.p AND a.s = b.s
        UNION SELECT b.word, a.word, a.n FROM skips a JOIN splits b ON a.i = b.i AND a.p = b.p AND a.s = b.s),
    best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
    forms AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 5 * w.n THEN b.other END AS form,
            CASE WHEN b.other_n >= 5 * w.n THEN b.other_n END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
    chain AS (SELECT word, word AS root FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL),
    ends AS (SELECT c.word, c.root FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NULL)
    SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms f JOIN ends e ON f.word = e.word"""

#: The path program goes forward here, with the least (cost, audit) of every state; 0: empty, 1: s, 2: u, 3: a.
REPAIR = f"""
    WITH RECURSIVE {CRC_TABLE},
    filled AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
    hit AS (SELECT *, {crc32("key")} % 20 AS h FROM filled, crc_table),
    damaged AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
            CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
        FROM hit WHERE h != 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS j,
            regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS core FROM damaged),
    faults AS (SELECT *, CASE WHEN core = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY j) > 1 THEN 'duplicate'
            WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
            lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY j) || substr(role, 1, 1) AS pair FROM placed),
    counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
            count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
            count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faults GROUP BY conv_id),
    inserts(x, y, price, letters, lines) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
        (0, 2, 2, 'I', chr(10) || 'user:'), (1, 2, 2, 'I', chr(10) || 'user:'), (3, 2, 2, 'I', chr(10) || 'user:'), (2, 3, 2, 'I', chr(10) || 'assistant:'),
        (0, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
    edits(letter, initial, x, y, price, role) AS (VALUES ('D', NULL, 0, 0, 3, NULL), ('D', NULL, 1, 1, 3, NULL), ('D', NULL, 2, 2, 3, NULL), ('D', NULL, 3, 3, 3, NULL),
        ('K', 's', 0, 1, 0, NULL), ('K', 'u', 0, 2, 0, NULL), ('K', 'u', 1, 2, 0, NULL), ('K', 'u', 3, 2, 0, NULL), ('K', 'a', 2, 3, 0, NULL),
        ('R', NULL, 0, 2, 2, 'user'), ('R', NULL, 1, 2, 2, 'user'), ('R', NULL, 3, 2, 2, 'user'), ('R', NULL, 2, 3, 2, 'assistant')),
    moves AS (SELECT f.conv_id, f.j, i.x, e.y, i.price + e.price + CASE WHEN e.letter != 'D' AND f.fault = 'truncated' THEN 1 ELSE 0 END AS price,
            i.letters || e.letter AS letters, i.lines || CASE WHEN e.letter = 'D' THEN '' ELSE chr(10) || coalesce(e.role, f.role) || ':' || f.text END AS lines
        FROM faults f, inserts i JOIN edits e ON e.x = i.y
        WHERE (e.letter = 'D' OR f.fault NOT IN ('blank', 'duplicate')) AND (e.initial IS NULL OR e.initial = substr(f.role, 1, 1))),
    paths AS (SELECT conv_id, CAST(0 AS BIGINT) AS j, 0 AS state, {{'cost': 0, 'audit': '', 'lines': ''}} AS best FROM counts
        UNION ALL
        SELECT p.conv_id, p.j + 1, m.y, min({{'cost': p.best.cost + m.price, 'audit': p.best.audit || m.letters, 'lines': p.best.lines || m.lines}})
        FROM paths p JOIN moves m ON p.conv_id IS NOT DISTINCT FROM m.conv_id AND m.j = p.j + 1 AND m.x = p.state GROUP BY p.conv_id, p.j, m.y),
    ends AS (SELECT c.conv_id, min({{'cost': p.best.cost + i.price, 'audit': p.best.audit || i.letters, 'lines': p.best.lines || i.lines}}) AS best
        FROM counts c JOIN paths p ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND p.j = c.n JOIN inserts i ON i.x = p.state AND i.y IN (0, 3) GROUP BY c.conv_id),
    every AS (SELECT DISTINCT conv_id FROM conversations)
    SELECT v.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
        coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost,
        coalesce(best.audit, '') AS audit, sha256(substr(coalesce(best.lines, ''), 2)) AS repaired_sha256
    FROM every v LEFT JOIN counts c ON v.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON v.conv_id IS NOT DISTINCT FROM e.conv_id"""
