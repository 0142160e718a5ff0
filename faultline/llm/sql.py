"""DuckDB texts of the queries that SQL can express."""

from __future__ import annotations

_WORD = r"'[^\x20\x09-\x0D]+'"
_SPACE = r"'[\x20\x09-\x0D]+'"

QUALITY_CTE = rf"""
d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS host, source IS NULL AS no_host,
        coalesce(text, '') AS t FROM {{docs}}),
w AS (SELECT *, regexp_extract_all(t, {_WORD}) AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_WORD})) AS lines FROM d),
win AS (SELECT row, unnest(range(len(w) - 2)) AS i,
          unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS x
        FROM w WHERE len(w) >= 3),
again AS (SELECT row, i FROM win QUALIFY count(*) OVER (PARTITION BY row, x) > 1),
covered AS (SELECT row, sum(n) AS n FROM (
          SELECT row, least(3, coalesce(lead(i) OVER (PARTITION BY row ORDER BY i) - i, 3)) AS n FROM again) GROUP BY row),
lines AS (SELECT row, host, no_host, t, len(regexp_extract_all(l, {_WORD})) AS n,
          lower(trim(regexp_replace(l, {_SPACE}, ' ', 'g'), ' ')) AS h
          FROM (SELECT row, host, no_host, md5(t) AS t, unnest(lines) AS l FROM w)),
often AS (SELECT host, no_host, h FROM lines GROUP BY ALL HAVING count(DISTINCT t) > 10),
gone AS (SELECT row, sum(n) AS n FROM lines JOIN often USING (host, no_host, h) GROUP BY row),
f AS (SELECT w.row, doc_id, len(w) AS n_words, length(regexp_replace(t, {_SPACE}, '', 'g')) AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        coalesce(c.n, 0) AS n_repeat_words, len(w) - coalesce(g.n, 0) AS left_words
      FROM w LEFT JOIN covered c USING (row) LEFT JOIN gone g USING (row)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
"""

QUALITY = f"""
WITH {QUALITY_CTE.format(docs="documents")}
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND 100 * left_words >= 20 * n_words AS kept, CAST(left_words AS BIGINT) AS left_words
FROM judged
"""

#: The table of the reflected CRC-32 polynomial, made by its rule.
_CRC_TABLE = """list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"""

VARIANTS = rf"""
WITH RECURSIVE
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, count(*) AS n,
           translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
         FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents)
         WHERE length(run) >= 6 GROUP BY ALL),
crc AS (SELECT {_CRC_TABLE} AS t),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295,
             list_transform(range(1, 1 + strlen(x) * 2, 2), lambda i: CAST('0x' || substr(hex(encode(x)), i, 2) AS BIGINT))),
             lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS h
           FROM (SELECT *, id || ':' || run AS x FROM runs), crc),
words AS (SELECT word, sum(n) AS n FROM (SELECT n, CASE WHEN h % 199 = 0
              THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
          WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS short
         FROM (SELECT word, n, unnest(range(1, 1 + length(word))) AS i FROM words)),
near AS (SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.short = b.short AND a.i = b.i AND a.word <> b.word
         UNION SELECT l.word, w.word, w.n FROM less l JOIN words w ON l.short = w.word
         UNION SELECT w.word, l.word, l.n FROM less l JOIN words w ON l.short = w.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS top FROM near GROUP BY word),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * w.n THEN other END AS form,
             CASE WHEN top >= 5 * w.n THEN top END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, 0 AS d FROM formed
          UNION ALL SELECT c.word, f.form, d + 1 FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, form, r.root, CAST(n AS BIGINT) AS n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n
FROM formed f JOIN (SELECT word, arg_max(root, d) AS root FROM chain GROUP BY word) r USING (word)
"""

INTERACTIONS = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
fails AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
            [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
             100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'),
             coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)] AS x
          FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
letters AS (SELECT unnest(range(1, 6)) AS f),
orders AS (SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM letters a, letters b, letters c, letters d, letters e
           WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT array_to_string(list_transform(o, lambda f: substr('ABCDE', f, 1)), '') AS filter_order, i AS step, o[i] AS f, o[:i - 1] AS before
          FROM orders, (SELECT unnest(range(1, 6)) AS i)),
kinds AS (SELECT part, x, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS t FROM fails GROUP BY ALL),
met AS (SELECT part, filter_order, step, f, n, g, t, x[f] AS failed,
          len(list_filter(before, lambda b: x[b])) > 0 AS gone, len(list_filter(x, lambda b: b)) = 1 AS alone FROM kinds, steps),
counted AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT failed AND NOT gone), 0) AS kept,
          coalesce(sum(n) FILTER (failed AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (failed AND gone), 0) AS redundant,
          coalesce(sum(n) FILTER (failed AND alone), 0) AS unique_fails, coalesce(sum(g) FILTER (failed AND NOT gone), 0) AS good_lost,
          coalesce(sum(t) FILTER (failed AND NOT gone), 0) AS toxic_lost FROM met GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""

ORACLE_SQL = {
    "op8_line_frequency": QUALITY,
    "op12_permuterm_variants": VARIANTS,
    "op13_filter_interactions": INTERACTIONS,
}
