"""The quality query as SQL."""

from __future__ import annotations

from ambry.llm.quality import DOUBT, RISK, SIGNALS, STEPS

RULES = f"""
WITH split AS (
  SELECT row_number() OVER () AS row_id, doc_id, lang, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents),
windows AS (
  SELECT row_id, i, array_to_string(ws[i:i + 7], ' ') AS win
  FROM (SELECT row_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM split)),
twice AS (
  SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, win) AS n FROM windows) WHERE n > 1),
repeated AS (
  SELECT row_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT row_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY row_id),
base AS (
  SELECT row_id, doc_id, lang, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM split LEFT JOIN repeated USING (row_id)),
rows AS (
  SELECT *, least(n_symbols / greatest(n_words, 1), 4.0) / 4 AS symbols,
         least(n_dup_lines * 10 / greatest(n_words, 1), 1.0) AS dup_lines,
         n_repeat_words / greatest(n_words, 1) AS repeats,
         least(word_chars / greatest(n_words, 1), 24.0) / 24 AS long_words
  FROM base),
long_rows AS (
  {" UNION ALL ".join(f"SELECT row_id, doc_id, lang, '{k}' AS signal, {k} AS value FROM rows" for k in SIGNALS)}),
good AS (
  SELECT lang, signal, least(floor(value * {STEPS}), {STEPS})::INT AS step FROM long_rows
  WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
strata AS (SELECT count(*) AS n FROM (SELECT DISTINCT lang FROM good)),
tested AS (
  SELECT g.lang, g.signal, s.step, count(*) AS total, count(*) FILTER (g.step >= s.step) AS rejected
  FROM good g, (SELECT unnest(range(1, {STEPS + 1})) AS step) s GROUP BY ALL),
shown AS (
  SELECT *, CASE WHEN rejected < total * {RISK / len(SIGNALS)!r} THEN
           list_sum(list_transform(range(0, rejected + 1), lambda k: exp(
             lgamma(total + 1) - lgamma(k + 1) - lgamma(total - k + 1)
             + k * ln({RISK / len(SIGNALS)!r}) + (total - k) * ln(1 - {RISK / len(SIGNALS)!r}))))
         ELSE 1.0 END <= {DOUBT!r} / (len_strata * {len(SIGNALS)}) AS sure
  FROM tested, (SELECT n AS len_strata FROM strata)),
cutoffs AS (
  SELECT lang, signal, (failed + 1) / {STEPS}.0 AS cutoff
  FROM (SELECT lang, signal, coalesce(max(step) FILTER (NOT sure), 0) AS failed FROM shown GROUP BY ALL)
  WHERE failed < {STEPS}),
rejected AS (
  SELECT DISTINCT row_id FROM long_rows l JOIN cutoffs c
  ON l.signal = c.signal AND l.lang IS NOT DISTINCT FROM c.lang AND l.value >= c.cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
         AND row_id NOT IN (SELECT row_id FROM rejected) AS kept
FROM rows
"""
