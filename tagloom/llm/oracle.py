"""SQL for DuckDB with the same rows as the queries that SQL can express."""

from __future__ import annotations

from tagloom.llm.url_filters import BASE_RULES, PATTERN_RULES, rule_regex


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rules(rules) -> str:
    rows = ", ".join(
        f"({_sql(r.name)}, {_sql(rule_regex(r.pattern))}, {_sql(r.action)})" for r in rules
    )
    return f"(VALUES {rows}) AS r(name, regex, action)"


BLANK = r"[\x20\x09-\x0D]"

OP5 = r"""
WITH lines AS (
  SELECT doc_id, i, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(l) AS line, unnest(generate_series(1, len(l))) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), owners AS (
  SELECT k, min(doc_id) AS owner FROM lines WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) > 1
)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (owner IS NOT NULL AND owner <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i)
              FILTER (owner IS NULL OR owner = doc_id), '')) AS kept_sha256
FROM lines LEFT JOIN owners USING (k) GROUP BY doc_id
"""

OP6 = rf"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANK}+'), lambda x: x <> '') AS w
  FROM documents
), windows AS (
  SELECT doc_id, i, list_slice(w, i, i + 7) AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM words)
), twice AS (
  SELECT doc_id, i FROM windows
  QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM twice, generate_series(0, 7) AS s(k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words)
  WHERE regexp_replace(line, '{BLANK}+', '', 'g') <> '' GROUP BY doc_id
), c AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(text, '{BLANK}', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) AS n_capitals,
         coalesce(l.dup, 0)::BIGINT AS n_dup_lines, coalesce(l.n, 0) AS n_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN lines l USING (doc_id) LEFT JOIN repeated r USING (doc_id)
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 2 * n_symbols > n_words OR 2 * n_capitals > word_chars
            OR word_chars < 2 * n_words OR word_chars > 25 * n_words
            OR 2 * n_dup_lines > n_lines) AS kept
FROM b
"""

OP9 = rf"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url FROM pages
), t AS (
  SELECT page_id,
         translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(url, '(?s)^.*?://[^/?#]*(.*)$', 1) AS rest
  FROM u
), base AS (
  SELECT t.page_id, arg_max(r.name, length(r.name)) AS rule, arg_max(r.action, length(r.name)) AS action
  FROM t, {_rules(BASE_RULES)} WHERE regexp_matches(t.host || t.rest, r.regex) GROUP BY t.page_id
), pat AS (
  SELECT t.page_id, min(r.action) AS action
  FROM t, {_rules(PATTERN_RULES)} WHERE regexp_matches(t.host || t.rest, r.regex) GROUP BY t.page_id
)
SELECT t.page_id, t.host, t.path, base.rule, coalesce(base.action, pat.action, 'allow') AS verdict
FROM t LEFT JOIN base USING (page_id) LEFT JOIN pat USING (page_id)
"""

OP11 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS p
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         list_dot_product(a.p, b.p)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.p) = len(b.p) WHERE a.vec_id % 50 = 0
), pos AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT pos.anchor_id, positive_id,
       row_number() OVER (PARTITION BY pos.anchor_id, positive_id ORDER BY score DESC, id)::INTEGER
         AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN s ON pos.anchor_id = s.anchor_id AND NOT same
  AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

ORACLE = {
    "op5_line_dedup": OP5, "op6_quality_rules": OP6, "op9_url_filters": OP9,
    "op11_hard_negatives": OP11,
}
