"""The SQL that gives the rows of ``op13_periodic_runs``; whole numbers that may be null are doubles, as clients hold them."""

from ambry.llm.merkle_sql import CRC32

RUNS = rf"""
WITH split AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
        CAST({CRC32.format('CAST(doc_id AS VARCHAR)')} AS BIGINT) AS h
    FROM documents
), drawn AS (
    SELECT *, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS rewritten, h // 10 AS g FROM split
), placed AS (
    SELECT *, CASE WHEN rewritten THEN g % n END AS a, CASE WHEN rewritten THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM drawn
), words AS (
    SELECT r, n, i, CASE WHEN rewritten AND i >= a THEN ws[a + (i - a) % p + 1] ELSE ws[i + 1] END AS w
    FROM (SELECT *, unnest(range(n)) AS i FROM placed)
), numbered AS (
    SELECT r, n, i, w, dense_rank() OVER (ORDER BY w) AS k FROM words
), pairs AS (
    SELECT x.r, x.i, y.i - x.i AS p FROM numbered x
    JOIN numbered y ON x.r = y.r AND x.k = y.k AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
), stretches AS (
    SELECT r, p, min(i) AS start, count(*) + p AS length
    FROM (SELECT *, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS island FROM pairs)
    GROUP BY r, p, island HAVING count(*) + p >= greatest(24, 3 * p)
), runs AS (
    SELECT r, start, length, min(p) AS period FROM stretches GROUP BY r, start, length
), kept AS (
    SELECT r, i, w FROM words WHERE NOT EXISTS (
        SELECT 1 FROM runs WHERE runs.r = words.r AND words.i >= start + period AND words.i < start + length
    )
), collapsed AS (
    SELECT r, string_agg(w, ' ' ORDER BY i) AS text FROM kept GROUP BY r
), listed AS (
    SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS all_runs,
        arg_min({{'start': start, 'length': length, 'period': period}}, (-(length / period), start, period)) AS best
    FROM runs GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.start AS DOUBLE) AS start, CAST(best.length AS DOUBLE) AS length,
    CAST(best.period AS DOUBLE) AS period, CAST(1000 * best.length // best.period AS DOUBLE) AS exponent_milli, sha256(coalesce(all_runs, '')) AS runs_sha256,
    sha256(coalesce(text, '')) AS collapsed_sha256
FROM split LEFT JOIN listed USING (r) LEFT JOIN collapsed USING (r)
"""
