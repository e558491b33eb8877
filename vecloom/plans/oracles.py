"""DuckDB SQL for the registered queries, written from their definitions."""

from __future__ import annotations

SQL: dict[str, str] = {}

_Q = "q AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 20 = 0)"
_I = "i AS (SELECT vec_id AS label, label AS grp, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def _ranked(scored: str, k: int, order: str = "label") -> str:
    return f"r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, {order}) AS INTEGER) AS rank FROM ({scored})), t AS (SELECT * FROM r WHERE rank <= {k})"


_SCORED = "SELECT qid, label, list_dot_product(qv, v) AS sim FROM q, i"
_OUT = "SELECT qid, rank, label, round(sim, 6) AS sim FROM t"

SQL["knn_top10"] = f"WITH {_Q}, {_I}, {_ranked(_SCORED, 10)} {_OUT}"
SQL["knn_top10_sql_engine"] = SQL["knn_top10"]
SQL["knn_single_topk"] = f"""
WITH {_I}, f AS (SELECT arg_min(v, label) AS qv FROM i)
SELECT label, round(list_dot_product(qv, v), 6) AS sim FROM f, i ORDER BY round(list_dot_product(qv, v), 9) DESC, label LIMIT 10
"""
SQL["knn_grouped"] = f"WITH {_Q}, {_I}, {_ranked(_SCORED + ' WHERE grp IN (1, 3, 5)', 10)} {_OUT}"
SQL["knn_cutoff"] = f"WITH {_Q}, {_I}, {_ranked(_SCORED, 10)} {_OUT} WHERE sim > 0.3"
SQL["similarity_matrix"] = f"WITH {_Q}, {_I} SELECT qid, label, round(list_dot_product(qv, v), 6) AS sim FROM q, i"
_CHECK = "list_sum(list_transform(range(1, len(v) + 1), lambda k: v[k] * k))"
SQL["index_upsert"] = f"""
WITH {_I}, old AS (SELECT * FROM i WHERE label % 3 <> 0), new AS (SELECT * FROM i WHERE label % 2 = 0),
fresh AS (SELECT label, grp, v, row_number() OVER (ORDER BY label) - 1 AS k FROM new WHERE label NOT IN (SELECT label FROM old))
SELECT label, grp, label AS pos, round({_CHECK}, 5) AS checksum FROM old WHERE label NOT IN (SELECT label FROM new)
UNION ALL SELECT label, grp + 100, label, round(-({_CHECK}), 5) FROM new WHERE label IN (SELECT label FROM old)
UNION ALL SELECT label, grp + 100, k + (SELECT max(label) + 1 FROM old), round(-({_CHECK}), 5) FROM fresh
"""
SQL["index_delete"] = "SELECT vec_id AS label, vec_id AS pos FROM embeddings WHERE vec_id % 7 <> 0"
SQL["index_delete_predicate"] = "SELECT vec_id AS label, vec_id AS pos FROM embeddings WHERE NOT embedding[1] > 0"
SQL["index_get"] = f"""
WITH {_I} SELECT -label AS ord, label, CAST(k - 1 AS INTEGER) AS i, round(v[k], 6) AS x
FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS k FROM i WHERE label % 20 = 0)
"""
SQL["index_get_position"] = """
WITH p AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS at, count(*) OVER () AS n FROM embeddings)
SELECT a.vec_id AS ord, b.vec_id AS label FROM p a JOIN p b ON b.at = a.n - 1 - a.vec_id WHERE a.vec_id % 20 = 0
"""
SQL["group_labels"] = "SELECT vec_id AS label, vec_id AS pos FROM embeddings WHERE label IN (0, 2)"
SQL["group_counts"] = "SELECT label AS grp, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS gid, count(*) AS n FROM embeddings GROUP BY label"
SQL["index_merge_last_wins"] = """
WITH e AS (SELECT vec_id AS label, label AS grp, 0 AS s, vec_id AS p FROM embeddings WHERE vec_id % 2 = 0
  UNION ALL SELECT vec_id, label + 1000, 1, vec_id FROM embeddings WHERE vec_id % 3 = 0),
g AS (SELECT label, arg_max(grp, s) AS grp, min(s) AS s, label AS p FROM e GROUP BY label)
SELECT label, grp, row_number() OVER (ORDER BY s, p) - 1 AS pos FROM g
"""
SQL["label_intersection"] = "SELECT vec_id AS label FROM embeddings WHERE vec_id % 6 = 0"
SQL["label_difference"] = "SELECT vec_id AS label FROM embeddings WHERE vec_id % 3 <> 0"


def _parts(source: str, keys: str, where: str = "") -> str:
    return f"SELECT {keys}, CAST(k - 1 AS INTEGER) AS i, round(v[k], 6) AS x FROM (SELECT {keys}, v, unnest(range(1, len(v) + 1)) AS k FROM {source}) {where}"


_UNIT = "list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12))"
SQL["normalize_vectors"] = f"WITH {_I}, n AS (SELECT label, {_UNIT} AS v FROM i) {_parts('n', 'label')}"
_LONG = "l AS (SELECT label, grp, k, v[k] AS x FROM (SELECT label, grp, v, unnest(range(1, len(v) + 1)) AS k FROM i))"
SQL["demean_vectors"] = f"""
WITH {_I}, {_LONG}, m AS (SELECT k, avg(x) AS m FROM l GROUP BY k), c AS (SELECT label, k, x - m AS x FROM l JOIN m USING (k)),
n AS (SELECT label, sqrt(sum(x * x)) AS n FROM c GROUP BY label)
SELECT label, CAST(k - 1 AS INTEGER) AS i, round(CASE WHEN n = 0 THEN 0 ELSE x / n END, 6) AS x FROM c JOIN n USING (label)
"""


def _codes(bits: int) -> str:
    top = (1 << bits) - 1
    scale = 2.0 * 0.55 / top
    return f"list_transform(v, lambda x: CAST(least(greatest(round_even(x / {scale!r} + {0.55 / scale!r}, 0), 0), {top}) AS INTEGER))"


def _pack(bits: int, codes: str = "c") -> str:
    per = 8 // bits
    return f"list_transform(range(0, len({codes}) // {per}), lambda b: CAST({' + '.join(f'{codes}[b * {per} + {j + 1}] * {1 << (j * bits)}' for j in range(per))} AS INTEGER))"


def _packed(bits: int) -> str:
    return f"WITH {_I}, c AS (SELECT label, {_codes(bits)} AS c FROM i) SELECT label, array_to_string({_pack(bits)}, ',') AS packed FROM c"


def _values(bits: int, codes: str) -> str:
    scale = 2.0 * 0.55 / ((1 << bits) - 1)
    return f"list_transform({codes}, lambda q: {scale!r} * (q - {0.55 / scale!r}))"


for _b in (8, 4, 2, 1):
    SQL[f"quantize_q{_b}"] = _packed(_b)
SQL["dequantize_roundtrip"] = f"WITH {_I}, c AS (SELECT label, {_codes(4)} AS c FROM i), w AS (SELECT label, {_values(4, 'c')} AS v FROM c) {_parts('w', 'label')}"
SQL["convert_q8_to_q2"] = f"""
WITH {_I}, a AS (SELECT label, {_codes(8)} AS c FROM i), b AS (SELECT label, {_values(8, 'c')} AS v FROM a), c AS (SELECT label, {_codes(2)} AS c FROM b)
SELECT label, array_to_string({_pack(2)}, ',') AS packed FROM c
"""


def _quantized_index(bits: int) -> str:
    return f"i0 AS (SELECT vec_id AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), i1 AS (SELECT label, {_codes(bits)} AS c FROM i0), i AS (SELECT label, {_values(bits, 'c')} AS v FROM i1)"


SQL["qknn_top10_q8"] = f"WITH {_Q}, {_quantized_index(8)}, {_ranked(_SCORED, 10)} {_OUT}"
SQL["qknn_top10_q4"] = f"WITH {_Q}, {_quantized_index(4)}, {_ranked(_SCORED, 10)} {_OUT}"
SQL["quant_recall_at_10"] = f"""
WITH exact AS ({SQL["knn_top10"]}), other AS ({SQL["qknn_top10_q4"]})
SELECT e.qid, round(count(o.label) / 10.0, 6) AS recall, round(coalesce(sum(1 / log2(o.rank + 1)), 0) / sum(1 / log2(e.rank + 1)), 6) AS ndcg
FROM exact e LEFT JOIN other o ON o.qid = e.qid AND o.label = e.label GROUP BY e.qid
"""
SQL["spec_from_range"] = """
WITH x AS (SELECT CAST(min(x) AS DOUBLE) AS lo, CAST(max(x) AS DOUBLE) AS hi FROM (SELECT unnest(embedding) AS x FROM embeddings))
SELECT 'qint8' AS kind, round((hi - lo) / 255, 9) AS scale, round(-lo / ((hi - lo) / 255), 6) AS zero_point FROM x
"""
_CHUNKS = r"""
p AS (SELECT doc_id AS doc, list_filter(list_transform(string_split(text, chr(10)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) >= 100) AS p FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc, CAST(k - 1 AS INTEGER) AS chunk_no, p[k] AS text FROM (SELECT doc, p, unnest(range(1, len(p) + 1)) AS k FROM p))
"""
SQL["split_chunks"] = f"WITH {_CHUNKS} SELECT doc, chunk_no, md5(text) AS md5 FROM c"
SQL["split_chunks_maxlen"] = f"""
WITH {_CHUNKS}, s AS (SELECT doc, chunk_no, j, substring(text, j * 200 + 1, 200) AS text FROM (SELECT doc, chunk_no, text, unnest(range(0, CAST(ceil(length(text) / 200.0) AS BIGINT))) AS j FROM c))
SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY chunk_no, j) - 1 AS INTEGER) AS chunk_no, md5(text) AS md5, CAST(length(text) AS INTEGER) AS n FROM s
"""
SQL["doc_rebuild"] = f"WITH {_CHUNKS} SELECT doc, md5(string_agg(text, chr(10) || chr(10) ORDER BY chunk_no)) AS md5 FROM c GROUP BY doc"
SQL["dedupe_last_wins"] = "SELECT conv_id, min(turn) AS turn, md5(arg_max(text, turn)) AS md5 FROM conversations GROUP BY conv_id"
SQL["dedupe_keep_first"] = """
SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem) WHERE k = 1
"""


def _embedded(source: str, key: str) -> str:
    return f"""w AS (SELECT {key}, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS w FROM {source}),
b AS (SELECT {key}, CAST('0x' || substring(md5(w), 1, 2) AS INTEGER) % 64 AS i, count(*) AS c FROM w GROUP BY 1, 2),
n AS (SELECT {key}, sqrt(sum(c * c)) AS n FROM b GROUP BY {key})"""


SQL["hash_embed_docs"] = f"WITH {_embedded('documents', 'doc_id')} SELECT doc_id, CAST(i AS INTEGER) AS i, round(c / n, 6) AS x FROM b JOIN n USING (doc_id)"
SQL["embed_long_texts"] = f"""
WITH s AS (SELECT doc_id, doc_id * 100000 + j AS part, substring(text, j * 1000 + 1, 1000) AS text FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 1000.0) AS BIGINT))) AS j FROM documents)),
{_embedded('s', 'part')}, e AS (SELECT part // 100000 AS doc_id, i, c / n AS x FROM b JOIN n USING (part)),
k AS (SELECT doc_id, count(*) AS parts FROM s GROUP BY doc_id)
SELECT doc_id, CAST(i AS INTEGER) AS i, round(sqrt(sum(x * x) / any_value(parts)), 6) AS x FROM e JOIN k USING (doc_id) GROUP BY doc_id, i
"""
_CENTRES = f"{_I}, {_LONG}, a AS (SELECT grp, k, avg(x) AS x FROM l GROUP BY grp, k), an AS (SELECT grp, sqrt(sum(x * x)) AS n FROM a GROUP BY grp)"
SQL["doc_centroids"] = f"WITH {_CENTRES} SELECT grp, CAST(k - 1 AS INTEGER) AS i, round(x / greatest(n, 1e-12), 6) AS x FROM a JOIN an USING (grp)"
SQL["long_text_l2mean"] = f"""
WITH {_I}, {_LONG}, a AS (SELECT grp, k, avg(sign(x) * x * x) AS m FROM l GROUP BY grp, k)
SELECT grp, CAST(k - 1 AS INTEGER) AS i, round(sign(m) * sqrt(abs(m)), 6) AS x FROM a
"""
_DOCS = f"{_CENTRES}, dv AS (SELECT grp AS label, list(x / greatest(n, 1e-12) ORDER BY k) AS v FROM a JOIN an USING (grp) GROUP BY grp)"
SQL["doc_search"] = f"WITH {_Q}, {_DOCS}, {_ranked('SELECT qid, label, list_dot_product(qv, v) AS sim FROM q, dv', 5)} {_OUT}"
SQL["two_stage_search"] = f"""
WITH {_Q}, {_DOCS}, ds AS (SELECT qid, label AS grp, row_number() OVER (PARTITION BY qid ORDER BY round(list_dot_product(qv, v), 9) DESC, label) AS k FROM q, dv),
{_ranked("SELECT qid, label, list_dot_product(qv, v) AS sim FROM ds JOIN q USING (qid) JOIN i USING (grp) WHERE k <= 3", 10)} {_OUT}
"""
SQL["context_string"] = f"""
WITH {_Q}, {_I}, {_ranked(_SCORED, 5)}
SELECT qid, md5(string_agg(label || ': ' || text, chr(10) || chr(10) ORDER BY rank)) AS md5 FROM t JOIN documents ON doc_id = label GROUP BY qid
"""
SQL["metadata_merge"] = """
WITH m AS (SELECT l_orderkey, CAST(l_shipdate AS DATE) AS date, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_shipdate AS DATE)) AS k FROM lineitem)
SELECT vec_id AS label, label AS grp, vec_id AS pos, CAST(date AS VARCHAR) AS date FROM embeddings LEFT JOIN m ON l_orderkey = vec_id AND k = 1
"""
_DATED = "e AS (SELECT vec_id AS label, CAST(embedding AS DOUBLE[]) AS v, CAST(o_orderdate AS DATE) AS date FROM embeddings LEFT JOIN orders ON o_orderkey = vec_id)"
_KS = (10, 25, 50, 100)
SQL["windowed_topk_similarity"] = f"""
WITH {_DATED}, d AS (SELECT label, v, date_diff('day', DATE '1970-01-01', coalesce(date, DATE '1970-01-01')) AS d FROM e),
s AS (SELECT f.label AS f, c.label AS c, CASE WHEN c.d <= f.d THEN 'pre' ELSE 'pos' END AS side, round(list_dot_product(f.v, c.v), 12) AS sim
  FROM d f JOIN d c ON c.d - f.d > -730 AND c.d - f.d <= 730),
k AS (SELECT *, row_number() OVER (PARTITION BY f, side ORDER BY sim DESC, c) AS rn FROM s)
SELECT d.label, {", ".join(f"round(avg(sim) FILTER (WHERE side = '{x}' AND rn <= {n}), 6) AS {x}_{n}" for x in ("pre", "pos") for n in _KS)}
FROM d LEFT JOIN k ON f = d.label GROUP BY d.label
"""
_YEARS = f"{_DATED}, y AS (SELECT label, v, greatest(coalesce(year(date), 1996), 1996) AS year FROM e)"
_YEARLY = "ys AS (SELECT f.label, c.year, count(*) AS n, avg(list_dot_product(f.v, c.v)) AS sim FROM y f, y c GROUP BY f.label, c.year)"
SQL["yearly_mean_similarity"] = f"WITH {_YEARS}, {_YEARLY} SELECT label, CAST(year AS INTEGER) AS year, n, round(sim, 6) AS sim FROM ys"
SQL["novelty_scores"] = f"""
WITH {_YEARS}, {_YEARLY}, w AS (SELECT f.label, f.year AS y, ys.year, n, sim FROM y f JOIN ys ON ys.label = f.label AND ys.year > f.year - 2 AND ys.year <= f.year + 2)
SELECT label, CAST(y AS INTEGER) AS year, CASE WHEN y <= 2000 THEN round(sum(n * sim) FILTER (WHERE year <= y) / sum(n) FILTER (WHERE year <= y), 6) END AS pre,
  CASE WHEN y <= 2000 THEN round(sum(n * sim) FILTER (WHERE year > y) / sum(n) FILTER (WHERE year > y), 6) END AS pos FROM w GROUP BY label, y
"""
SQL["benchmark_report"] = """
WITH r AS (SELECT l_returnflag, l_linestatus, p_brand AS bench, 100 * avg(CAST(l_discount AS DOUBLE)) AS metric FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
g AS (SELECT l_returnflag, l_linestatus, 'Group1' AS bench, avg(metric) AS metric FROM r WHERE bench IN ('Brand#11', 'Brand#12', 'Brand#13') GROUP BY 1, 2),
a AS (SELECT * FROM r WHERE bench NOT IN ('Brand#11', 'Brand#12', 'Brand#13') UNION ALL SELECT * FROM g),
b AS (SELECT DISTINCT bench FROM a), o AS (SELECT bench, row_number() OVER (ORDER BY bench) AS place FROM b)
SELECT l_returnflag, l_linestatus, CAST(place AS INTEGER) AS place, bench, round(metric, 5) AS metric FROM a JOIN o USING (bench)
UNION ALL SELECT l_returnflag, l_linestatus, 0, 'Average', round(avg(metric), 5) FROM a GROUP BY 1, 2
"""
SQL["length_stats"] = "SELECT lang, count(*) AS n, round(avg(length(text)), 6) AS mean_len, round(stddev_samp(length(text)), 4) AS std_len FROM documents GROUP BY lang"
SQL["pair_similarity"] = f"WITH {_I} SELECT a.label AS id, round(list_dot_product(a.v, b.v), 6) AS sim FROM i a JOIN i b ON b.label + 1 = a.label"
SQL["cumulative_bounds"] = """
SELECT source, doc_id, CAST(sum(n_chars) OVER w - n_chars AS BIGINT) AS start, CAST(sum(n_chars) OVER w AS BIGINT) AS "end" FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)
"""
SQL["batch_ids"] = """
SELECT source, doc_id, CAST(k // 16 AS INTEGER) AS batch, least((k // 16 + 1) * 16, n) AS batch_end
FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM documents)
"""
SQL["group_lists"] = "SELECT conv_id, string_agg(role, ',' ORDER BY turn, role) AS roles FROM conversations GROUP BY conv_id"
SQL["rate_limit_usage"] = "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS requests FROM events"
SQL["rate_limit_wait"] = """
WITH p AS (SELECT n.event_id, epoch_us(n.ts) / 1e6 AS now, epoch_us(p.ts) / 1e6 AS past, row_number() OVER (PARTITION BY n.event_id ORDER BY p.ts DESC, p.event_id DESC) AS k
  FROM events n JOIN events p ON p.user_id = n.user_id AND p.ts >= n.ts - INTERVAL 1 DAY AND (p.ts < n.ts OR (p.ts = n.ts AND p.event_id <= n.event_id)))
SELECT event_id, round(coalesce(greatest(0.0, 86400 - (any_value(now) - max(past) FILTER (WHERE k > 2))), 0.0), 3) AS wait_s FROM p GROUP BY event_id
"""
SQL["resource_limits"] = "SELECT count(*) > 5000 AS req_over, coalesce(sum(length(props)), 0) > 10000000 AS tok_over, count(*) > 5000 OR coalesce(sum(length(props)), 0) > 10000000 AS any_over FROM events"
SQL["refresh_changed"] = """
WITH n AS (SELECT user_id AS name, max(ts) AS m FROM events GROUP BY 1), s AS (SELECT user_id AS name, max(ts) AS m FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT n.name FROM n LEFT JOIN s USING (name) WHERE s.m IS NULL OR n.m > s.m
"""
SQL["file_kinds"] = r"""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '\.([^./]+)$', 1)) AS extension FROM pages)
SELECT page_id, extension, CASE extension WHEN 'html' THEN 'text/html' WHEN 'htm' THEN 'text/html' WHEN 'txt' THEN 'text/plain' WHEN 'pdf' THEN 'application/pdf' WHEN 'json' THEN 'application/json'
  WHEN 'js' THEN 'text/javascript' WHEN 'css' THEN 'text/css' WHEN 'xml' THEN 'text/xml' WHEN 'csv' THEN 'text/csv' WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' ELSE 'unknown' END AS mime FROM p
"""
SQL["size_classes"] = "SELECT CAST(CASE WHEN n_chars <= 1 THEN 1 ELSE pow(2, ceil(log2(n_chars))) END AS BIGINT) AS size_class, count(*) AS n FROM documents GROUP BY 1"
SQL["stream_upsert"] = "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id"

SQL["gguf_fields"] = """
WITH r AS (SELECT count(*) AS regions FROM region), n AS (SELECT count(*) AS nations FROM nation), f(key, value) AS (
  SELECT 'general.name', 'nations' UNION ALL SELECT 'nation.count', CAST(nations AS VARCHAR) FROM n UNION ALL SELECT 'nation.regions', regions || ' x <STRING>' FROM r
  UNION ALL SELECT 'general.alignment', '32' UNION ALL SELECT 'nation.largest', '18446744073709551615' UNION ALL SELECT 'nation.least', '-9223372036854775808'
  UNION ALL SELECT 'nation.share', '0.5' UNION ALL SELECT 'nation.known', 'true')
SELECT rpad(key, 17, ' ') || ' = ' || value AS line FROM f
"""
SQL["gguf_tensors"] = """
WITH n AS (SELECT n_nationkey, n_regionkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS r, count(*) OVER () AS c FROM nation)
SELECT 'nation.keys' AS name, 'F32' AS type, c || 'x2' AS shape, CAST(2 * r AS INTEGER) AS i, CAST(n_nationkey AS DOUBLE) AS x, CAST(NULL AS VARCHAR) AS whole FROM n
UNION ALL SELECT 'nation.keys', 'F32', c || 'x2', CAST(2 * r + 1 AS INTEGER), CAST(n_regionkey AS DOUBLE), NULL FROM n
UNION ALL SELECT 'nation.ids', 'I64', CAST(c AS VARCHAR), CAST(r AS INTEGER), CAST(n_nationkey + 4611686018427387905 AS DOUBLE), CAST(n_nationkey + 4611686018427387905 AS VARCHAR) FROM n
"""
