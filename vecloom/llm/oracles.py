"""DuckDB SQL for the queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["op4_minhash_near_dedup"] = rf"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g
  FROM t
), n AS (SELECT doc_id, len(g) AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(g) AS g FROM s),
i AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n_shingles + q.n_shingles - k)
), both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (
  SELECT doc_id AS v, doc_id AS r FROM n
  UNION
  SELECT reach.v, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.r
), c AS (SELECT v, min(r) AS component_id FROM reach GROUP BY v)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c ON v = doc_id
"""

SQL["op5_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents
), g AS (SELECT n, count(*) AS group_size, first(doc_id ORDER BY cp DESC, doc_id) AS keep_id FROM t GROUP BY n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM t JOIN g USING (n)
"""

# Distinct documents are distinct sets of lines.
SQL["op6_quality_rules"] = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), wins AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM t WHERE len(w) >= 3
), win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM wins
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c >= 2
), repeated AS (
  SELECT doc_id, count(DISTINCT i + d) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) v(d) GROUP BY doc_id
), line AS (
  SELECT doc_id, host, unnest(string_split(x, chr(10))) AS l FROM t
), full_line AS (
  SELECT doc_id, host, l, regexp_extract_all(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS lw
  FROM line WHERE regexp_matches(l, '[^\x20\x09-\x0D]')
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM full_line GROUP BY doc_id
), norm AS (
  SELECT doc_id, host, array_to_string(lw, ' ') AS l, len(lw) AS k FROM full_line
), names AS (
  SELECT doc_id, md5(array_to_string(list_sort(list(DISTINCT l)), chr(10))) AS name FROM norm GROUP BY doc_id
), often AS (
  SELECT host, l FROM norm JOIN names USING (doc_id) GROUP BY host, l HAVING count(DISTINCT name) >= 20
), lost AS (
  SELECT doc_id, sum(k) AS removed_words FROM norm JOIN often USING (host, l) GROUP BY doc_id
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(removed_words, 0) AS BIGINT) AS removed_words
  FROM t LEFT JOIN repeated USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN lost USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
    AND (removed_words = 0 OR (n_words - removed_words >= 30 AND n_words - removed_words >= 0.25 * n_words)) AS kept
FROM m
"""
