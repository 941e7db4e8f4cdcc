"""DuckDB SQL for the queries that SQL can express."""

OP8 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
k AS (
  SELECT doc_id, pos, line,
    translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(f.key) FILTER (WHERE k.doc_id <> f.last_doc)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL OR k.doc_id = f.last_doc), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY k.doc_id
"""

#: Quantiles, spreads, evidence and bounds as in quality_rules.MEASURES, LEAST_ROWS and CAP.
OP3 = r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, lang, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i : i + 4]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM h WHERE n > 1) GROUP BY doc_id),
f AS (
  SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_bangs, len(ls)::BIGINT AS n_lines
  FROM w LEFT JOIN r USING (doc_id)),
m AS (
  SELECT doc_id, lang, source, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS failed, unnest(['symbols', 'bangs', 'word_length', 'repeats', 'dup_lines']) AS measure,
    unnest([50, 50, 25, 50, 50]) AS lo, unnest([90, 90, 75, 95, 97]) AS hi, unnest([4, 4, 4, 4, 1]) AS spread,
    unnest([n_symbols >= 3, n_bangs >= 3, n_words >= 1, n_repeat_words >= 15, n_dup_lines >= 3]) AS evident,
    unnest([coalesce(n_symbols * 1000 // nullif(n_words, 0), 0), coalesce(n_bangs * 1000 // nullif(n_words, 0), 0),
      coalesce(word_chars * 1000 // nullif(n_words, 0), 0), coalesce(n_repeat_words * 1000 // nullif(n_words, 0), 0),
      coalesce(n_dup_lines * 1000 // nullif(n_lines, 0), 0)]) AS v FROM f),
c AS (
  SELECT *, CASE WHEN v < 256 THEN v ELSE (length(bin(v)) - 8) * 256 + (v >> (length(bin(v)) - 8)) END AS code FROM m WHERE NOT failed),
s AS (
  SELECT 'own' AS kind, lang, source, measure, lo, hi, spread, code, count(*) AS n FROM c GROUP BY ALL
  UNION ALL SELECT 'language', lang, NULL, measure, lo, hi, spread, code, count(*) FROM c GROUP BY ALL),
u AS (
  SELECT *, sum(n) OVER (PARTITION BY kind, lang, source, measure ORDER BY code) AS upto, sum(n) OVER (PARTITION BY kind, lang, source, measure) AS total FROM s),
q AS (
  SELECT kind, lang, source, measure, spread, total, min(code) FILTER (WHERE 100 * upto >= lo * total) AS a, min(code) FILTER (WHERE 100 * upto >= hi * total) AS b,
    min(code) FILTER (WHERE 100 * upto >= 50 * total) AS h
  FROM u GROUP BY ALL),
t AS (
  SELECT *, CASE WHEN a < 256 THEN a ELSE ((a - (a // 256) * 256 + 1) << (a // 256)) - 1 END AS low,
    CASE WHEN b < 256 THEN b ELSE ((b - (b // 256) * 256 + 1) << (b // 256)) - 1 END AS high,
    CASE WHEN h < 256 THEN h ELSE ((h - (h // 256) * 256 + 1) << (h // 256)) - 1 END AS middle FROM q),
e AS (SELECT kind, lang, source, measure, total, middle, high + spread * (high - low) AS fence FROM t),
p AS (SELECT lang, measure, list_sort(list(fence))[(count(*) + 1) // 2] AS median FROM e WHERE kind = 'own' AND total >= 30 GROUP BY lang, measure),
k AS (
  SELECT o.lang, o.source, o.measure, least(CASE WHEN o.total >= 30 THEN o.fence ELSE l.fence END, 150 * greatest(p.median, o.middle) // 100) AS fence
  FROM e o JOIN e l ON o.kind = 'own' AND l.kind = 'language' AND o.lang IS NOT DISTINCT FROM l.lang AND o.measure = l.measure
  LEFT JOIN p ON o.lang IS NOT DISTINCT FROM p.lang AND o.measure = p.measure),
x AS (
  SELECT doc_id, bool_or(coalesce(v > fence AND evident, false)) AS above
  FROM m LEFT JOIN k ON m.lang IS NOT DISTINCT FROM k.lang AND m.source IS NOT DISTINCT FROM k.source AND m.measure = k.measure GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT above AS kept
FROM f JOIN x USING (doc_id)
"""

ORACLE = {
    "op3_quality_rules": OP3,
    "op8_line_dedup": OP8,
}
