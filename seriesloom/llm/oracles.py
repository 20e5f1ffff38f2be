"""The same results in DuckDB SQL, for the operators SQL can express."""

from __future__ import annotations

from . import quality

_LOWER_LINE = "lower(line)"
_PHRASES = " OR ".join(f"contains({_LOWER_LINE}, '{p}')" for p in quality.BOILERPLATE)

QUALITY = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, string_split(text, chr(10)) AS ls FROM docs),
windows AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w
  FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM words)
),
repeated AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, w) > 1),
covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM repeated) GROUP BY r
),
lines AS (SELECT r, unnest(ls) AS line FROM words),
judged AS (
  SELECT r, line, regexp_matches(line, '[^\x20\x09-\x0D]') AS filled,
    length(regexp_replace(line, '{quality.MARKS}', '', 'g')) AS marks, len(regexp_extract_all(line, '{quality.SEPARATOR}')) AS parts,
    regexp_matches(line, '{quality.SENTENCE_MARKS}') AS sentence, {_PHRASES} AS phrase
  FROM lines
),
passed AS (
  SELECT *, NOT filled OR (
    marks * 100 <= length(line) * {quality.MAX_MARKS} AND (length(line) < {quality.UNPUNCTUATED} OR sentence)
    AND NOT (parts >= {quality.MIN_SEPARATORS} AND length(line) <= (parts + 1) * {quality.MAX_ITEM})
    AND NOT (length(line) <= {quality.SHORT_LINE} AND phrase)) AS ok
  FROM judged
),
per_line AS (
  SELECT r, count(*) FILTER (filled) - count(DISTINCT line) FILTER (filled) AS n_dup_lines,
    coalesce(sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) FILTER (ok), 0) AS stays
  FROM passed GROUP BY r
),
measured AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '{quality.SYMBOLS}'))::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words, stays
  FROM words JOIN per_line USING (r) LEFT JOIN covered USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words AS base_failed,
  NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words)
    AND (word_chars - stays) * 100 <= word_chars * {quality.MAX_LOST} AS kept
FROM measured
"""

NEGATIVES = """
WITH good AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    CASE WHEN len(a.v) = 0 THEN 0 ELSE list_inner_product(a.v, b.v) END::BIGINT AS score
  FROM (SELECT DISTINCT vec_id, label, v FROM good WHERE vec_id % 100 = 0) a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

ORACLES = {"op3_quality": QUALITY, "op13_negatives": NEGATIVES}
