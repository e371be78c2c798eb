"""DuckDB SQL for the operators that SQL can express over whole tables."""

from __future__ import annotations

from lectern.llm.quality import BOILERPLATE, CLOSING, LOST_PERCENT, MIN_WORDS, NAVIGATION_WORDS, REPEATED_PERCENT, SENTENCE_END, SEPARATORS, WINDOW

WORD = r"'[^\x20\x09-\x0D]+'"


def crc32(value: str) -> str:
    """The CRC-32 of a short ASCII text, null as empty: its bits one after another."""
    start, polynomial = (1 << 32) - 1, int("EDB88320", 16)
    codes = f"list_transform(string_split(coalesce(CAST({value} AS VARCHAR), ''), ''), lambda c: CAST(CASE WHEN c = '' THEN 0 ELSE ascii(c) END AS UBIGINT))"
    codes = f"CASE WHEN coalesce(CAST({value} AS VARCHAR), '') = '' THEN CAST([] AS UBIGINT[]) ELSE {codes} END"
    bit = f"lambda s, z: xor(s >> 1, {polynomial} * (s & 1))"
    byte = f"lambda c, b: list_reduce(list_concat([xor(c, b)], CAST([0, 0, 0, 0, 0, 0, 0, 0] AS UBIGINT[])), {bit})"
    return f"CAST(xor(list_reduce(list_concat([CAST({start} AS UBIGINT)], {codes}), {byte}), CAST({start} AS UBIGINT)) AS BIGINT)"


def _field(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"coalesce(CAST(octet_length(encode({text})) AS VARCHAR) || ':' || {text}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(f) for f in ("doc_id", "source", "lang", "n_chars", text)) + ")"


MANIFEST = f"""
WITH RECURSIVE rows_ AS (
    SELECT doc_id, coalesce('s' || source, '') AS g, {_leaf("text")} AS leaf,
           {_leaf(f"CASE WHEN {crc32('doc_id')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS found
    FROM documents),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY g) AS size FROM rows_),
low AS (
    SELECT g, 0 AS level, place, size, leaf AS digest FROM placed
    UNION ALL
    SELECT g, level + 1, place // 3, (size + 2) // 3, sha256(string_agg(digest, '' ORDER BY place)) FROM low WHERE size > 1
    GROUP BY g, level, place // 3, size),
tops AS (
    SELECT g, digest AS subroot, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS size FROM low WHERE size = 1),
high AS (
    SELECT 0 AS level, place, size, subroot AS digest FROM tops
    UNION ALL
    SELECT level + 1, place // 3, (size + 2) // 3, sha256(string_agg(digest, '' ORDER BY place)) FROM high WHERE size > 1
    GROUP BY level, place // 3, size),
low_sides AS (
    SELECT a.g, a.level, a.place, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS l,
           coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS r
    FROM low a JOIN low b ON a.g = b.g AND a.level = b.level AND a.place // 3 = b.place // 3 WHERE a.size > 1 GROUP BY ALL),
high_sides AS (
    SELECT a.level, a.place, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS l,
           coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS r
    FROM high a JOIN high b ON a.level = b.level AND a.place // 3 = b.place // 3 WHERE a.size > 1 GROUP BY ALL),
up AS (
    SELECT doc_id, leaf, g, place AS own, 0 AS level, place, false AS above, found AS now, '' AS proof, size FROM placed
    UNION ALL
    SELECT u.doc_id, u.leaf, u.g, u.own, CASE WHEN u.size > 1 THEN u.level + 1 ELSE 0 END,
           CASE WHEN u.size > 1 THEN u.place // 3 ELSE t.place END, u.above OR u.size = 1,
           CASE WHEN u.size > 1 THEN sha256(coalesce(s.l, h.l) || u.now || coalesce(s.r, h.r)) ELSE u.now END,
           CASE WHEN u.size > 1 THEN u.proof || coalesce(s.l, h.l) || coalesce(s.r, h.r) ELSE u.proof END,
           CASE WHEN u.size > 1 THEN (u.size + 2) // 3 ELSE t.size END
    FROM up u JOIN tops t ON u.g = t.g
    LEFT JOIN low_sides s ON NOT u.above AND s.g = u.g AND s.level = u.level AND s.place = u.place
    LEFT JOIN high_sides h ON u.above AND h.level = u.level AND h.place = u.place
    WHERE u.size > 1 OR NOT u.above)
SELECT u.doc_id, u.leaf, t.subroot, h.digest AS root, sha256(u.proof) AS proof_sha256, u.now AS folded_root, u.now = h.digest AS verified
FROM up u JOIN tops t ON u.g = t.g CROSS JOIN (SELECT digest FROM high WHERE size = 1) h
WHERE u.above AND u.size = 1
"""


def _signs(column: str, pattern: str) -> str:
    return f"(length({column}) - length(regexp_replace({column}, '{pattern}', '', 'g')))"


def _class(marks: str) -> str:
    return "[" + "".join("\\" + m if m in "]\\^-" else "''" if m == "'" else m for m in marks) + "]"


_NOTICE = "|".join(BOILERPLATE)
_BLANK = r"[\x20\x09-\x0D]"
QUALITY = f"""
WITH texts AS (
    SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WORD}) AS words FROM documents),
lines AS (
    SELECT k, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM texts),
judged AS (
    SELECT k, line, i, len(regexp_extract_all(line, {WORD})) AS n, {_signs("line", "[#*$%&|<>]")} AS signs, {_signs("line", "!")} AS shouts,
           {_signs("line", _class(SEPARATORS))} AS items,
           regexp_matches(regexp_replace(line, '{_BLANK}+$', ''), '{_class(SENTENCE_END)}{_class(CLOSING)}*$') AS ended,
           regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_NOTICE}') AS notice
    FROM lines),
ruled AS (
    SELECT k, n, row_number() OVER (PARTITION BY k, line ORDER BY i) > 1 AS again,
           CASE WHEN (signs >= 3 AND 5 * signs > n) OR (shouts >= 3 AND 2 * shouts > n) THEN 'punctuation'
                WHEN (items >= 3 AND 5 * items > n) OR (n <= {NAVIGATION_WORDS} AND NOT ended) THEN 'navigation'
                WHEN notice THEN 'boilerplate' END AS rule
    FROM judged WHERE n > 0),
by_line AS (
    SELECT k, count_if(again) AS n_dup_lines, sum(n) FILTER (rule = 'punctuation') AS p, sum(n) FILTER (rule = 'navigation') AS v,
           sum(n) FILTER (rule = 'boilerplate') AS b
    FROM ruled GROUP BY k),
numbered AS (SELECT k, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM texts),
windows AS (
    SELECT k, i, list(word) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS w FROM numbered),
found AS (
    SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, w) AS times FROM windows WHERE len(w) = {WINDOW}) WHERE times > 1),
covered AS (
    SELECT k, count(DISTINCT i + j) AS n_repeat_words FROM found, range({WINDOW}) r(j) GROUP BY k),
counted AS (
    SELECT t.doc_id, CAST(len(t.words) AS BIGINT) AS n_words, CAST(length(t.text) - length(regexp_replace(t.text, {WORD}, '', 'g')) AS BIGINT) AS word_chars,
           CAST({_signs("t.text", "[#*$%&|<>]")} AS BIGINT) AS n_symbols, CAST(coalesce(l.n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(c.n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(l.p, 0) AS BIGINT) AS n_punctuation,
           CAST(coalesce(l.v, 0) AS BIGINT) AS n_navigation, CAST(coalesce(l.b, 0) AS BIGINT) AS n_boilerplate
    FROM texts t LEFT JOIN by_line l USING (k) LEFT JOIN covered c USING (k))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEATED_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEATED_PERCENT} * n_words)
       AND 100 * (n_punctuation + n_navigation + n_boilerplate) <= {LOST_PERCENT} * n_words AS kept
FROM counted
"""

# Whole numbers that may be null are floats in result frames, and so here.
PERIODIC = f"""
WITH texts AS (
    SELECT row_number() OVER () AS k, doc_id, {crc32("doc_id")} AS h, regexp_extract_all(coalesce(text, ''), {WORD}) AS words FROM documents),
marked AS (
    SELECT *, len(words) AS n, h // 10 AS g, CASE WHEN len(words) > 0 THEN (h // 10) % len(words) END AS a FROM texts),
tailed AS (
    SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM marked),
numbered AS (
    SELECT t.k, u.i, t.words[1 + CASE WHEN t.h % 10 = 0 AND u.i >= t.a THEN t.a + (u.i - t.a) % t.p ELSE u.i END] AS word
    FROM tailed t, unnest(range(t.n)) u(i)),
same AS (
    SELECT x.k, x.i, y.i - x.i AS q FROM numbered x JOIN numbered y ON x.k = y.k AND x.word = y.word AND y.i > x.i),
stretched AS (
    SELECT k, q, i, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS stretch FROM same),
long_ AS (
    SELECT k, q, min(i) AS start, count(*) + q AS length FROM stretched GROUP BY k, q, stretch HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT k, start, length, min(q) AS period FROM long_ GROUP BY k, start, length),
ranked AS (
    SELECT r.*, row_number() OVER (PARTITION BY k ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS rank FROM runs r),
by_text AS (
    SELECT k, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256
    FROM runs GROUP BY k),
dropped AS (
    SELECT DISTINCT k, unnest(range(start + period, start + length)) AS i FROM runs),
left_ AS (
    SELECT n.k, sha256(string_agg(n.word, ' ' ORDER BY n.i)) AS collapsed_sha256
    FROM numbered n ANTI JOIN dropped d ON n.k = d.k AND n.i = d.i GROUP BY n.k)
SELECT t.doc_id, CAST(coalesce(b.n_runs, 0) AS BIGINT) AS n_runs, CAST(r.start AS DOUBLE) AS start, CAST(r.length AS DOUBLE) AS length,
       CAST(r.period AS DOUBLE) AS period, CAST(1000 * r.length // r.period AS DOUBLE) AS exponent_milli,
       coalesce(b.runs_sha256, sha256('')) AS runs_sha256, coalesce(l.collapsed_sha256, sha256('')) AS collapsed_sha256
FROM texts t LEFT JOIN by_text b USING (k) LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) r USING (k) LEFT JOIN left_ l USING (k)
"""
