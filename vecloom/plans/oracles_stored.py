"""DuckDB SQL for the queries of :mod:`vecloom.plans.stored`, written from their definitions."""

from __future__ import annotations

from .oracles import _CENTRES, _I, _LONG, _OUT, _Q, _embedded, _parts, _ranked, _codes, _pack, _values, SQL as CORE

SQL: dict[str, str] = {}

# Sparse vectors of documents (b, n), stored as 32-bit floats, and of the asked benchmark rows (qb, qn); their inner products by the dimensions that both have.
_TEXTS = f"""d AS (SELECT doc_id AS label, source AS grp, text FROM documents), {_embedded('d', 'label')},
q AS (SELECT item_id AS qid, text FROM benchmark WHERE item_id % 20 = 0),
qw AS (SELECT qid, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS w FROM q),
qb AS (SELECT qid, CAST('0x' || substring(md5(w), 1, 2) AS INTEGER) % 64 AS i, count(*) AS c FROM qw GROUP BY 1, 2),
qn AS (SELECT qid, sqrt(sum(c * c)) AS n FROM qb GROUP BY qid),
p AS (SELECT qid, label, sum(qb.c / qn.n * CAST(CAST(b.c / n.n AS FLOAT) AS DOUBLE)) AS k FROM qb JOIN qn USING (qid) JOIN b USING (i) JOIN n USING (label) GROUP BY 1, 2),
s AS (SELECT q.qid, d.label, d.grp, coalesce(k, 0.0) AS sim FROM q CROSS JOIN d LEFT JOIN p ON p.qid = q.qid AND p.label = d.label)"""
SQL["text_search"] = f"WITH {_TEXTS}, {_ranked('SELECT qid, label, sim FROM s', 10)} {_OUT}"
SQL["text_search_groups"] = f"""WITH {_TEXTS}, {_ranked("SELECT qid, label, sim FROM s WHERE grp IN ('src1', 'src2')", 5)} {_OUT} WHERE sim > 0.2"""
SQL["text_similarity"] = f"WITH {_TEXTS} SELECT qid, label, round(sim, 6) AS sim FROM s"
SQL["text_context"] = f"""
WITH {_TEXTS}, {_ranked('SELECT qid, label, sim FROM s', 3)}
SELECT qid, md5(string_agg(label || ': ' || text, chr(10) || chr(10) ORDER BY rank)) AS md5 FROM t JOIN d USING (label) GROUP BY qid
"""
_TWO = """
e AS (SELECT doc_id AS label, source AS grp, text, 0 AS s, doc_id AS p FROM documents WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id, source, {again}, 1, doc_id FROM documents WHERE doc_id % 3 = 0),
g AS (SELECT label, arg_max(grp, s) AS grp, arg_max(text, s) AS text, min(s) AS s, label AS p FROM e GROUP BY label),
placed AS (SELECT label, grp, text, row_number() OVER (ORDER BY s, p) - 1 AS pos FROM g)
"""
SQL["text_db_changes"] = f"WITH {_TWO.format(again=chr(39) + 'new ' + chr(39) + ' || text')} SELECT label, grp, pos, md5(text) AS md5 FROM placed WHERE label NOT IN (0, 6) AND label % 5 <> 0"
SQL["text_db_merge"] = f"WITH {_TWO.format(again='upper(source)')} SELECT label, grp, pos, md5(text) AS md5 FROM placed"
SQL["ingestion_counts"] = """
WITH c AS (SELECT 0 AS batch, count(*) FILTER (doc_id % 2 = 0) AS rows FROM documents UNION ALL SELECT 1, count(*) FILTER (doc_id % 3 = 0) FROM documents UNION ALL SELECT 2, count(*) FILTER (doc_id % 7 = 1) FROM documents)
SELECT CAST(batch AS INTEGER) AS batch, rows, CAST(sum(rows) OVER (ORDER BY batch) AS BIGINT) AS total FROM c
"""
SQL["text_db_get"] = "SELECT -doc_id AS ord, doc_id AS label, md5(text) AS md5 FROM documents WHERE doc_id % 20 = 0"
# every component of 64, those without a word being zero, by four bits
_ALL_DIMS = f"{_embedded('documents', 'doc_id')}, dims AS (SELECT unnest(range(0, 64)) AS i), dense AS (SELECT doc_id, list(coalesce(c / n, 0.0) ORDER BY dims.i) AS v FROM documents CROSS JOIN dims LEFT JOIN b USING (doc_id, i) LEFT JOIN n USING (doc_id) GROUP BY doc_id)"
SQL["text_db_snapshot"] = f"""
WITH {_ALL_DIMS}, c AS (SELECT doc_id, {_codes(4)} AS c FROM dense)
SELECT doc_id AS label, source AS grp, row_number() OVER (ORDER BY doc_id) - 1 AS pos, round(list_sum({_values(4, 'c')}), 6) AS total, md5(text) AS md5 FROM c JOIN documents USING (doc_id)
"""
SQL["index_snapshot"] = f"""
WITH {_I}, c AS (SELECT label, grp, {_codes(4)} AS c FROM i), g AS (SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS gid FROM (SELECT DISTINCT grp FROM i))
SELECT label, label AS pos, grp, CAST(gid AS INTEGER) AS gid, array_to_string({_pack(4)}, ',') AS packed, 4 AS bits FROM c JOIN g USING (grp)
"""
SQL["group_registration"] = """
WITH g AS (SELECT DISTINCT label AS grp FROM embeddings)
SELECT grp, CAST(row_number() OVER (ORDER BY CASE WHEN grp % 2 = 1 THEN 0 ELSE 1 END, grp) - 1 AS INTEGER) AS gid FROM g
"""
SQL["index_set_rows"] = f"WITH {_I} SELECT label, label AS pos, CASE WHEN label % 50 = 0 THEN 64.0 ELSE round(list_sum(v), 6) END AS total FROM i"
SQL["index_clear_and_insert"] = "SELECT vec_id AS label, row_number() OVER (ORDER BY vec_id DESC) - 1 AS pos FROM embeddings WHERE vec_id % 4 = 0"
SQL["label_checks"] = """
SELECT 'even and thirds disjoint' AS fact, (SELECT count(*) FROM embeddings WHERE vec_id % 6 = 0) = 0 AS holds UNION ALL SELECT 'even and odd disjoint', true
UNION ALL SELECT 'labels unique', (SELECT count(*) = count(DISTINCT vec_id) FROM embeddings) UNION ALL SELECT 'groups unique', (SELECT count(*) = count(DISTINCT label) FROM embeddings)
"""


def _chunks(source: str, key: str, text: str, least: int) -> str:
    return rf"""
pp AS (SELECT {key} AS doc, list_filter(list_transform(string_split({text}, chr(10)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) >= {least}) AS p FROM {source} WHERE {text} IS NOT NULL),
ch AS (SELECT doc, k - 1 AS chunk_no, p[k] AS text FROM (SELECT doc, p, unnest(range(1, len(p) + 1)) AS k FROM pp))"""


SQL["document_search"] = f"""
WITH {_chunks('documents', 'doc_id', 'text', 100)}, c AS (SELECT doc, chunk_no, doc * 100000 + chunk_no AS id, text FROM ch WHERE doc % 10 <> 0), {_embedded('c', 'id')},
e AS (SELECT id // 100000 AS doc, id, i, c / n AS x FROM b JOIN n USING (id)), k AS (SELECT doc, count(*) AS k FROM c GROUP BY doc),
m AS (SELECT doc, i, sum(x) / any_value(k) AS x FROM e JOIN k USING (doc) GROUP BY doc, i), mn AS (SELECT doc, sqrt(sum(x * x)) AS n FROM m GROUP BY doc),
q AS (SELECT item_id AS qid, text FROM benchmark WHERE item_id % 20 = 0),
qw AS (SELECT qid, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS w FROM q),
qb AS (SELECT qid, CAST('0x' || substring(md5(w), 1, 2) AS INTEGER) % 64 AS i, count(*) AS c FROM qw GROUP BY 1, 2),
qn AS (SELECT qid, sqrt(sum(c * c)) AS n FROM qb GROUP BY qid), qv AS (SELECT qid, i, c / n AS y FROM qb JOIN qn USING (qid)),
ds AS (SELECT qid, doc, sum(x * y) / any_value(n) AS sim FROM qv JOIN m USING (i) JOIN mn USING (doc) GROUP BY qid, doc),
best AS (SELECT qid, doc FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, doc) AS r FROM ds) WHERE r <= 5),
cs AS (SELECT qid, id, coalesce(sum(CAST(CAST(x AS FLOAT) AS DOUBLE) * y), 0.0) AS sim FROM best JOIN e USING (doc) JOIN qv USING (qid, i) GROUP BY qid, id)
SELECT qid, CAST(r AS INTEGER) AS rank, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, id) AS r FROM cs) WHERE r <= 10
"""
SQL["document_get"] = f"""
WITH {_chunks('documents', 'doc_id', 'text', 100)} SELECT -doc AS ord, doc, md5(string_agg(text, chr(10) || chr(10) ORDER BY chunk_no)) AS md5 FROM ch WHERE doc % 20 = 0 GROUP BY doc
"""
SQL["document_replacement"] = f"""
WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN substring(text, 1, 400) ELSE text END AS text FROM documents), {_chunks('t', 'doc_id', 'text', 100)}
SELECT doc, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM ch GROUP BY doc
"""
SQL["user_splitter"] = """
WITH p AS (SELECT doc_id AS doc, unnest(string_split(text, '. ')) AS t FROM documents WHERE text IS NOT NULL) SELECT doc, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS chars FROM p GROUP BY doc
"""
SQL["jsonl_database"] = "SELECT CAST(doc_id AS VARCHAR) AS label, row_number() OVER (ORDER BY doc_id) - 1 AS pos, md5(text) AS md5 FROM documents ORDER BY doc_id LIMIT 100"
SQL["csv_database"] = """SELECT CAST(doc_id AS VARCHAR) AS title, md5(' "a", ' || text) AS md5 FROM documents"""
SQL["text_lines"] = "SELECT n_name AS text FROM nation"
SQL["folder_documents"] = "SELECT page_id, md5(html || chr(10)) AS md5 FROM pages"
SQL["folder_database"] = f"WITH {_chunks('pages', 'page_id', 'html', 20)} SELECT doc AS page_id, count(*) AS n, false AS changed FROM ch GROUP BY doc"
SQL["text_decoding"] = "SELECT conv_id, turn, md5(text) AS md5 FROM conversations"
SQL["json_values"] = "SELECT event_id, event_type AS kind FROM events"
SQL["result_files"] = """
SELECT 'org' || l_linestatus AS org, 'my-model' AS model, 256 AS max_len, l_returnflag AS quant, p_brand AS bench, round(avg(l_discount), 6) AS metric
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_linestatus, l_returnflag, p_brand
"""
_EVAL = []
for _g in (0, 1, 2):
    _scored = "SELECT qid, label, list_dot_product(qv, v) AS sim FROM q, {i} WHERE grp = " + str(_g)
    _EVAL.append(f"""SELECT 'local/hash-64-qint4' AS run, 'test' AS split, 'group{_g}' AS bench, round(avg(ndcg), 6) AS metric FROM (
  WITH x AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, label) AS rank FROM ({_scored.format(i='i')})),
  y AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, label) AS rank FROM ({_scored.format(i='z')}))
  SELECT x.qid, coalesce(sum(1 / log2(y.rank + 1)), 0) / sum(1 / log2(x.rank + 1)) AS ndcg FROM x LEFT JOIN y ON y.qid = x.qid AND y.label = x.label AND y.rank <= 10 WHERE x.rank <= 10 GROUP BY x.qid)""")
SQL["retrieval_evaluation"] = f"WITH {_Q}, {_I}, z0 AS (SELECT label, grp, {_codes(4)} AS c FROM i), z AS (SELECT label, grp, {_values(4, 'c')} AS v FROM z0) {' UNION ALL '.join(_EVAL)}"
SQL["approximate_recall"] = "SELECT * FROM (VALUES ('lsh', true), ('ivf', true)) t(method, enough)"
SQL["embedder_parity"] = r"SELECT doc_id AS id, CASE WHEN regexp_matches(substring(text, 1, 200), '\p{L}') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sim FROM documents"
SQL["embedding_profile"] = "SELECT count(*) AS rows, round(avg(length(text)), 6) AS mean_len, round(stddev_samp(length(text)), 4) AS std_len, true AS timed FROM documents"
SQL["kernel_profile"] = "SELECT * FROM (VALUES (8, true), (4, true), (2, true), (1, true)) t(bits, timed)"
SQL["token_windows"] = "SELECT doc_id, md5(text) AS md5 FROM documents"
_STATES = f"{_I}, st AS (SELECT label, v[k * 8 + j + 1] AS x, k, j FROM (SELECT label, v, unnest(range(0, 8)) AS k FROM i), (SELECT unnest(range(0, 8)) AS j))"
SQL["token_state_pooling"] = f"""
WITH {_STATES}
SELECT label, 'mean' AS how, CAST(j AS INTEGER) AS i, round(avg(x), 6) AS x FROM st WHERE k < 6 GROUP BY label, j UNION ALL SELECT label, 'cls', CAST(j AS INTEGER), round(x, 6) FROM st WHERE k = 0
UNION ALL SELECT label, 'last', CAST(j AS INTEGER), round(x, 6) FROM st WHERE k = 5 UNION ALL SELECT label, 'max', CAST(j AS INTEGER), round(max(x), 6) FROM st WHERE k < 6 GROUP BY label, j
"""
SQL["size_histogram"] = "SELECT n_chars // 500 AS size, string_agg(doc_id, ',' ORDER BY doc_id) AS ids, count(*) AS n FROM documents GROUP BY 1"
SQL["quant_kinds"] = """
SELECT * FROM (VALUES (0, 'float', 32, false, NULL, NULL), (1, 'half', 16, false, NULL, NULL), (2, 'qint8', 8, true, round(3.0::DOUBLE / 255, 9), 85.0::DOUBLE), (3, 'qint4', 4, true, round(3.0::DOUBLE / 15, 9), 5.0),
(4, 'qint2', 2, true, 1.0, 1.0), (5, 'qint1', 1, true, 3.0, round(1.0::DOUBLE / 3, 9)), (6, 'qint1', 1, true, 2.0, 0.5)) t(n, kind, bits, quantized, scale, zero_point)
"""
SQL["sign_vectors"] = f"WITH {_I}, w AS (SELECT label, list_transform(v, lambda x: 2.0 * (least(greatest(round_even(x / 2.0 + 0.5, 0), 0), 1) - 0.5)) AS v FROM i) {_parts('w', 'label')}"
SQL["demean_squared"] = f"""
WITH {_I}, {_LONG}, m AS (SELECT k, avg(x) AS m FROM l GROUP BY k), c AS (SELECT label, k, x - m AS x FROM l JOIN m USING (k)), n AS (SELECT label, sum(x * x) AS n FROM c GROUP BY label)
SELECT label, CAST(k - 1 AS INTEGER) AS i, round(CASE WHEN n = 0 THEN 0 ELSE x / n END, 6) AS x FROM c JOIN n USING (label)
"""
SQL["metadata_from_csv"] = """
WITH m AS (SELECT l_orderkey AS key, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS date, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END NULLS FIRST) AS k FROM lineitem)
SELECT vec_id AS label, label AS grp, vec_id AS pos, CAST(date AS VARCHAR) AS date FROM embeddings LEFT JOIN m ON key = vec_id AND k = 1
"""
SQL["token_texts"] = "SELECT conv_id, turn, md5(array_to_string(string_split(text, ' ')[1:5], ' ')) AS md5 FROM conversations"
SQL["usage_windows"] = """
WITH e AS (SELECT user_id, length(props) AS n, epoch(ts) AS t FROM events), w AS (SELECT user_id, n, CAST(floor(t / 21600) * 21600 - k * 21600 AS BIGINT) AS start FROM e, (SELECT unnest(range(0, 4)) AS k))
SELECT start, user_id, count(*) AS requests, CAST(sum(n) AS BIGINT) AS tokens FROM w GROUP BY 1, 2
"""
SQL["document_centroid_search"] = f"""
WITH {_Q}, {_CENTRES}, dv AS (SELECT grp AS label, list(x / greatest(n, 1e-12) ORDER BY k) AS v FROM a JOIN an USING (grp) GROUP BY grp)
SELECT label, round(max(list_dot_product(qv, v)), 6) AS best, round(avg(list_dot_product(qv, v)), 6) AS mean FROM q, dv GROUP BY label
"""
SQL["packed_totals"] = "SELECT source, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(sum(greatest(1, ceil(n_chars / 8192.0))) AS BIGINT) AS pieces, true AS fits FROM documents GROUP BY source"
SQL["edit_script_lengths"] = r"""
WITH c AS (SELECT conv_id, turn, min(substring(regexp_replace(text, '[^\x00-\x7F]', '', 'g'), 1, 40)) AS t FROM conversations GROUP BY 1, 2)
SELECT a.conv_id || ':' || a.turn AS id, CAST(levenshtein(a.t, b.t) AS BIGINT) AS n FROM c a JOIN c b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.t <> b.t
"""
SQL["sharded_embedding"] = "SELECT 8 AS shards, count(*) AS n, count(*) * 64 AS values FROM documents"
CORE.update(SQL)
