"""Registered queries of the vector and document operators. Each runs over its whole tables; SQL is in :mod:`vecloom.plans.oracles`."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quant as Q
from ..functions import text as X
from ..functions.vec import next_power_of_two, normalize
from ..operators import aggregates as A
from ..operators import analytics, db, knn, limits, report
from ..operators import index as I
from ..operators.embed import HashEmbedder, embed_long, pack_batches, split_sizes
from .shared import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, Query] = {}
Q8, Q4, Q2, Q1 = (Q.QuantSpec.from_width(f"qint{b}", 0.0, 0.55) for b in (8, 4, 2, 1))
KS = (10, 25, 50, 100)


def register(f: Query) -> Query:
    _ALL[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("label"), F.col("label").alias("grp"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vec"))


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set of searches: every row whose id is divisible by 20."""
    return table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("qid", "rank", "label", F.round("sim", 6).alias("sim"))


def _components(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode("vec").alias("i", "x")).select(*keys, "i", F.round(F.col("x").cast("double"), 6).alias("x"))


@register
def knn_top10(spark, d):
    return _rounded(knn.topk(_queries(spark, d), _index(spark, d)))


@register
def knn_top10_sql_engine(spark, d):
    return _rounded(knn.topk(_queries(spark, d), _index(spark, d), engine="sql"))


@register
def knn_single_topk(spark, d):
    first = _index(spark, d).agg(F.min_by("vec", "pos").alias("v")).first()["v"]
    return knn.top_single(F.array(*[F.lit(float(x)) for x in first]), _index(spark, d)).select("label", F.round("sim", 6).alias("sim"))


@register
def knn_grouped(spark, d):
    return _rounded(knn.topk(_queries(spark, d), _index(spark, d), groups=[1, 3, 5]))


@register
def knn_cutoff(spark, d):
    return _rounded(knn.topk(_queries(spark, d), _index(spark, d), cutoff=0.3))


@register
def similarity_matrix(spark, d):
    return knn.similarity(_queries(spark, d), _index(spark, d), digits=6).select("qid", "label", "sim")


def _upsert_parts(spark, d):
    e = _index(spark, d)
    old = e.filter("label % 3 <> 0")
    new = e.filter("label % 2 = 0").select("label", (F.col("grp") + 100).alias("grp"), F.col("pos").alias("ord"), F.transform("vec", lambda x: -x).alias("vec"))
    return old, new


@register
def index_upsert(spark, d):
    old, new = _upsert_parts(spark, d)
    out = I.upsert(old, new)
    whole = F.aggregate(F.transform("vec", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return out.select("label", "grp", "pos", F.round(whole, 5).alias("checksum"))


@register
def index_delete(spark, d):
    e = _index(spark, d)
    return I.delete(e, e.filter("label % 7 = 0").select("label")).select("label", "pos")


@register
def index_delete_predicate(spark, d):
    return I.delete(_index(spark, d), where=F.get("vec", F.lit(0)) > 0).select("label", "pos")


@register
def index_get(spark, d):
    asked = _index(spark, d).filter("label % 20 = 0").select((-F.col("pos")).alias("ord"), "label")
    got = I.get(_index(spark, d), asked)
    return _components(got, "ord", "label")


@register
def index_get_position(spark, d):
    asked = _index(spark, d).filter("label % 20 = 0").select(F.col("pos").alias("ord"), (-1 - F.col("pos")).alias("at"))
    return I.get_positions(_index(spark, d), asked).select("ord", "label")


@register
def group_labels(spark, d):
    return I.group_labels(_index(spark, d), [0, 2])


@register
def group_counts(spark, d):
    ids = I.group_ids(_index(spark, d))
    return _index(spark, d).join(ids, "grp").groupBy("grp", "gid").agg(F.count("*").alias("n"))


@register
def index_merge_last_wins(spark, d):
    e = _index(spark, d)
    a, b = e.filter("label % 2 = 0"), e.filter("label % 3 = 0").withColumn("grp", F.col("grp") + 1000)
    return I.merge([a, b]).select("label", "grp", "pos")


@register
def label_intersection(spark, d):
    e = _index(spark, d)
    return I.intersection(e.filter("label % 2 = 0"), e.filter("label % 3 = 0"))


@register
def label_difference(spark, d):
    e = _index(spark, d)
    return I.difference(e, e.filter("label % 3 = 0"))


@register
def normalize_vectors(spark, d):
    return _components(_index(spark, d).select("label", normalize("vec").alias("vec")), "label")


@register
def demean_vectors(spark, d):
    return _components(A.demean(_index(spark, d).select("label", "vec")), "label")


def _packed(spark, d, spec):
    return _index(spark, d).select("label", F.array_join(Q.quantize("vec", spec).cast("array<string>"), ",").alias("packed"))


@register
def quantize_q8(spark, d):
    return _packed(spark, d, Q8)


@register
def quantize_q4(spark, d):
    return _packed(spark, d, Q4)


@register
def quantize_q2(spark, d):
    return _packed(spark, d, Q2)


@register
def quantize_q1(spark, d):
    return _packed(spark, d, Q1)


@register
def dequantize_roundtrip(spark, d):
    e = _index(spark, d).select("label", Q.dequantize(Q.quantize("vec", Q4), Q4).alias("vec"))
    return _components(e, "label")


@register
def convert_q8_to_q2(spark, d):
    e = I.quantized(_index(spark, d), Q8)
    return e.select("label", F.array_join(Q.convert("vec", Q8, Q2).cast("array<string>"), ",").alias("packed"))


@register
def qknn_top10_q8(spark, d):
    return _rounded(knn.topk(_queries(spark, d), I.quantized(_index(spark, d), Q8), spec=Q8))


@register
def qknn_top10_q4(spark, d):
    return _rounded(knn.topk(_queries(spark, d), I.quantized(_index(spark, d), Q4), engine="sql", spec=Q4))


@register
def quant_recall_at_10(spark, d):
    exact = knn.topk(_queries(spark, d), _index(spark, d))
    other = knn.topk(_queries(spark, d), I.quantized(_index(spark, d), Q4), spec=Q4)
    r = report.recall(exact, other).join(report.ndcg(exact, other), "qid")
    return r.select("qid", F.round("recall", 6).alias("recall"), F.round("ndcg", 6).alias("ndcg"))


@register
def spec_from_range(spark, d):
    spec = Q.QuantSpec.from_data("qint8", _index(spark, d), "vec")
    return spark.createDataFrame([(spec.kind, round(spec.scale, 9), round(spec.zero_point, 6))], "kind string, scale double, zero_point double")


def _chunks(spark, d, max_len=None):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    return db.chunk(docs, "\n", 100, max_len)


@register
def split_chunks(spark, d):
    return _chunks(spark, d).select("doc", "chunk_no", F.md5(F.col("text").cast("binary")).alias("md5"))


@register
def split_chunks_maxlen(spark, d):
    return _chunks(spark, d, 200).select("doc", "chunk_no", F.md5(F.col("text").cast("binary")).alias("md5"), F.length("text").alias("n"))


@register
def doc_rebuild(spark, d):
    return db.rebuild(_chunks(spark, d)).select("doc", F.md5(F.col("text").cast("binary")).alias("md5"))


@register
def dedupe_last_wins(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return I.keep_last(c, "conv_id", "text", "turn").select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("md5"))


@register
def dedupe_keep_first(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return I.keep_first(li, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey")


@register
def hash_embed_docs(spark, d):
    v = table(spark, d, "documents").select("doc_id", HashEmbedder(64).column("text").alias("vec"))
    return _components(v, "doc_id").filter("x <> 0")


@register
def embed_long_texts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return _components(embed_long(docs, "doc_id", "text", HashEmbedder(64), 1000), "doc_id").filter("x <> 0")


@register
def doc_centroids(spark, d):
    return _components(A.centroids(_index(spark, d), ["grp"]), "grp")


@register
def long_text_l2mean(spark, d):
    return _components(A.signed_square_mean(_index(spark, d), ["grp"]), "grp")


def _docs(spark, d):
    return A.centroids(_index(spark, d), ["grp"]).select(F.col("grp").alias("label"), F.col("grp").cast("long").alias("pos"), "vec")


@register
def doc_search(spark, d):
    return _rounded(knn.topk(_queries(spark, d), _docs(spark, d).withColumn("grp", F.lit(0)), 5))


@register
def two_stage_search(spark, d):
    return _rounded(db.two_stage(_queries(spark, d), _docs(spark, d), _index(spark, d), top_d=3, k=10))


@register
def context_string(spark, d):
    found = knn.topk(_queries(spark, d), _index(spark, d), 5)
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("label"), "text")
    return db.context(found, texts).select("qid", F.md5(F.col("context").cast("binary")).alias("md5"))


@register
def metadata_merge(spark, d):
    meta = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("date"))
    out = analytics.metadata_merge(_index(spark, d).select("label", "grp", "pos"), meta, "l_orderkey", ["l_linenumber", "date"])
    return out.select("label", "grp", "pos", F.col("date").cast("string").alias("date"))


def _dated(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("label"), F.col("o_orderdate").cast("date").alias("date"))
    return _index(spark, d).select("label", "vec").join(o, "label", "left")


@register
def windowed_topk_similarity(spark, d):
    e = _dated(spark, d)
    out = analytics.windowed_topk(e, e, years=2, ks=KS)
    return out.select("label", *[F.round(f"{s}_{k}", 6).alias(f"{s}_{k}") for s in ("pre", "pos") for k in KS])


@register
def yearly_mean_similarity(spark, d):
    sims, counts = analytics.yearly_means(_dated(spark, d), _dated(spark, d), 1996)
    return sims.join(F.broadcast(counts), "year").select("label", "year", "n", F.round("sim", 6).alias("sim"))


@register
def novelty_scores(spark, d):
    e = _dated(spark, d)
    sims, counts = analytics.yearly_means(e, e, 1996)
    return analytics.novelty(e, sims, counts, 1996, delta=2, year_cut=2000).select("label", "year", F.round("pre", 6).alias("pre"), F.round("pos", 6).alias("pos"))


@register
def benchmark_report(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    results = li.groupBy("l_returnflag", "l_linestatus", F.col("p_brand").alias("bench")).agg(F.avg("l_discount").alias("metric"))
    brands = [r["p_brand"] for r in table(spark, d, "part").select("p_brand").distinct().orderBy("p_brand").collect()]
    out = report.benchmark_report(results, ["l_returnflag", "l_linestatus"], brands, GROUPED, "Group1")
    wide = [c for c in out.columns if c not in ("l_returnflag", "l_linestatus")]
    place = F.create_map(*[x for i, c in enumerate(wide) for x in (F.lit(c), F.lit(i))])
    long = out.unpivot(["l_returnflag", "l_linestatus"], wide, "bench", "metric")
    return long.filter("metric is not null").select("l_returnflag", "l_linestatus", place[F.col("bench")].alias("place"), "bench", F.round("metric", 5).alias("metric"))


GROUPED = ["Brand#11", "Brand#12", "Brand#13"]


@register
def length_stats(spark, d):
    return A.length_stats(table(spark, d, "documents"), "text", ["lang"]).select("lang", "n", F.round("mean_len", 6).alias("mean_len"), F.round("std_len", 4).alias("std_len"))


@register
def pair_similarity(spark, d):
    a = _index(spark, d).select(F.col("label").alias("id"), "vec")
    b = _index(spark, d).select((F.col("label") + 1).alias("id"), "vec")
    return knn.pair_similarity(a, b).select("id", F.round("sim", 6).alias("sim"))


@register
def cumulative_bounds(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return A.bounds(docs, "n_chars", ["doc_id"], ["source"]).select("source", "doc_id", "start", "end")


@register
def batch_ids(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id")
    return A.batch_ids(docs, 16, ["doc_id"], ["source"])


@register
def group_lists(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return A.group_lists(c, "conv_id", "turn", "role").select("conv_id", F.array_join("role", ",").alias("roles"))


@register
def rate_limit_usage(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts").withColumn("req", F.lit(1).cast("long"))
    return limits.usage(e, "1 DAY", "user_id", "ts", {"requests": "req"}).select("event_id", "requests")


@register
def rate_limit_wait(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts").withColumn("req", F.lit(1).cast("long"))
    out = limits.wait(e, 86_400, "user_id", "ts", {"req": 2})
    return out.select("event_id", F.round("wait_s", 3).alias("wait_s"))


@register
def resource_limits(spark, d):
    e = table(spark, d, "events").select(F.lit(1).alias("req"), F.length("props").alias("tok"))
    return A.exceeds(e, {"req": 5_000, "tok": 10_000_000})


@register
def refresh_changed(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("name"), F.col("ts").alias("mtime"), "event_id")
    now = e.groupBy("name").agg(F.max("mtime").alias("mtime"))
    seen = e.filter("event_type = 'view'").groupBy("name").agg(F.max("mtime").alias("mtime"))
    return db.changed(now, seen)


@register
def file_kinds(spark, d):
    p = table(spark, d, "pages").select("page_id", X.extension("url").alias("extension"), X.mime_type("url").alias("mime"))
    return p.select("page_id", "extension", F.coalesce("mime", F.lit("unknown")).alias("mime"))


@register
def size_classes(spark, d):
    docs = table(spark, d, "documents").select("doc_id", next_power_of_two("n_chars").alias("size_class"))
    return docs.groupBy("size_class").agg(F.count("*").alias("n"))


@register
def pack_token_batches(spark, d):
    """Every character is in a batch: a document of more than 8,192 is packed in pieces."""
    docs = table(spark, d, "documents").select("source", "doc_id", F.coalesce("n_chars", F.length("text"), F.lit(0)).alias("size"))
    return pack_batches(split_sizes(docs, "size", 8192), "source", ["doc_id", "piece"], "size", 8192)


@register
def token_edit_ops(spark, d):
    c = table(spark, d, "conversations")
    a = c.select("conv_id", "turn", F.split("text", " ").alias("a"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.split("text", " ").alias("b"))
    pairs = a.join(b, ["conv_id", "turn"]).select(F.concat_ws(":", "conv_id", "turn").alias("id"), "a", "b")
    return report.edit_operations(pairs)


@register
def lsh_neighbors(spark, d):
    return _rounded(knn.lsh_topk(_queries(spark, d), _index(spark, d)))


@register
def ivf_neighbors(spark, d):
    return _rounded(knn.ivf_topk(_queries(spark, d), _index(spark, d)))


def _gguf(spark, d) -> str:
    """A small file made of the table of regions and nations."""
    from ..sources.gguf import write_gguf

    names = [r["r_name"] for r in table(spark, d, "region").orderBy("r_regionkey").collect()]
    keys = np.array([[r["n_nationkey"], r["n_regionkey"]] for r in table(spark, d, "nation").orderBy("n_nationkey").collect()], np.float32)
    path = f"{shared_dir(spark)}/vecloom/gguf-{uuid.uuid4().hex[:12]}/nations.gguf"
    fields = [("general.name", 8, "nations"), ("nation.count", 4, len(keys)), ("nation.regions", 9, (8, names)), ("general.alignment", 4, 32), ("nation.largest", 10, (1 << 64) - 1), ("nation.least", 11, -(1 << 63)), ("nation.share", 6, 0.5), ("nation.known", 7, True)]
    write_gguf(path, fields, [("nation.keys", keys), ("nation.ids", keys[:, 0].astype(np.int64) + ((1 << 62) + 1))])
    return path


@register
def gguf_fields(spark, d):
    from ..sources.gguf import describe, read_gguf

    return describe(read_gguf(spark, _gguf(spark, d))).select("line")


@register
def gguf_tensors(spark, d):
    from ..sources.gguf import read_gguf

    t = read_gguf(spark, _gguf(spark, d), "tensors")
    t = t.select("name", "type", F.array_join(F.col("shape").cast("array<string>"), "x").alias("shape"), "whole", F.posexplode("data").alias("i", "x"))
    return t.select("name", "type", "shape", "i", "x", F.get("whole", "i").cast("string").alias("whole"))


@register
def stream_upsert(spark, d):
    from ..streaming import upserts

    base = f"{shared_dir(spark)}/vecloom/stream-{uuid.uuid4().hex[:12]}"
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    e.repartition(3).write.parquet(f"{base}/in")
    stream = upserts.read_stream(spark, f"{base}/in", e.schema)
    upserts.upsert_stream(stream, f"{base}/state", "user_id", "event_id", f"{base}/checkpoint", buckets=4).awaitTermination()
    return upserts.current(spark, f"{base}/state")


def queries() -> dict[str, Query]:
    from . import stored  # noqa: F401, registers its own

    return dict(_ALL)


def oracle_sql() -> dict[str, str]:
    from . import oracles_stored, stored  # noqa: F401
    from .oracles import SQL

    return {k: v for k, v in SQL.items() if k in _ALL}
