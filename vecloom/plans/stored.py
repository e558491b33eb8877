"""Registered queries of databases, files, snapshots, evaluation and embedding: what is written somewhere and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import quant as Q
from ..functions import text as X
from ..functions.vec import pool
from ..operators import aggregates as A
from ..operators import analytics, db, embed, knn, report
from ..operators import index as I
from ..sources import files, snapshots
from ..streaming import upserts
from .queries import Q4, _components, _docs, _index, _queries, _rounded, register, table
from .shared import shared_dir


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/vecloom/{name}-{uuid.uuid4().hex[:12]}"


def _md5(c: str):
    return F.md5(F.col(c).cast("binary")).alias("md5")


def _texts(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("label"), "text", F.col("source").alias("grp"), F.col("doc_id").alias("ord"))


def _asked(spark, d) -> DataFrame:
    """The stated query set of text searches: every row of the benchmark whose id is divisible by 20."""
    return table(spark, d, "benchmark").filter("item_id % 20 = 0").select(F.col("item_id").alias("qid"), "text")


def _textdb(spark, d, **options) -> db.TextDB:
    return db.TextDB.create(spark, label="long", **options).add(_texts(spark, d))


@register
def text_search(spark, d):
    return _rounded(_textdb(spark, d).search(_asked(spark, d), top_k=10, engine="arrow"))


@register
def text_search_groups(spark, d):
    return _rounded(_textdb(spark, d).search(_asked(spark, d), groups=["src1", "src2"], top_k=5, cutoff=0.2))


@register
def text_similarity(spark, d):
    return _textdb(spark, d).similarity(_asked(spark, d)).select("qid", "label", F.round("sim", 6).alias("sim"))


@register
def text_context(spark, d):
    return _textdb(spark, d).context(_asked(spark, d), top_k=3).select("qid", _md5("context"))


@register
def text_db_changes(spark, d):
    """Two batches, the later one with other texts for some labels; then a list of labels and a predicate go."""
    t = _texts(spark, d)
    batches = [t.filter("label % 2 = 0"), t.filter("label % 3 = 0").withColumn("text", F.concat(F.lit("new "), "text"))]
    out = db.TextDB.create(spark, label="long").add(db.gather_batches(spark, batches)).remove([0, 6, 999_999], F.col("label") % 5 == 0)
    return out.rows.select("label", "grp", "pos", _md5("text"))


@register
def ingestion_counts(spark, d):
    t = _texts(spark, d)
    return db.ingestion_counts(db.gather_batches(spark, [t.filter("label % 2 = 0"), t.filter("label % 3 = 0"), t.filter("label % 7 = 1")]))


@register
def text_db_get(spark, d):
    return _textdb(spark, d).text(_texts(spark, d).filter("label % 20 = 0").select((-F.col("label")).alias("ord"), "label")).select("ord", "label", _md5("text"))


@register
def text_db_merge(spark, d):
    t = _texts(spark, d)
    shards = [db.TextDB.create(spark, label="long").add(x) for x in (t.filter("label % 2 = 0"), t.filter("label % 3 = 0").withColumn("text", F.upper("grp")))]
    return db.TextDB.merge(shards).rows.select("label", "grp", "pos", _md5("text"))


@register
def text_db_snapshot(spark, d):
    path = _fresh(spark, "textdb")
    _textdb(spark, d, spec=Q4).save(path)
    loaded = db.TextDB.load(spark, path)
    index, spec = snapshots.load_index(spark, path)
    vec = Q.dequantize("vec", spec)
    found = index.select("label", "grp", "pos", F.round(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))
    return found.join(loaded.rows.select("label", _md5("text")), "label")


@register
def index_snapshot(spark, d):
    path = _fresh(spark, "index")
    snapshots.save_index(path, I.quantized(_index(spark, d), Q4), Q4)
    index, spec = snapshots.load_index(spark, path)
    rows = I.all_groups(index, snapshots.load_groups(spark, path)).join(index.select("label", F.array_join(F.col("vec").cast("array<string>"), ",").alias("packed")), "label")
    return rows.select("label", "pos", "grp", "gid", "packed", F.lit(spec.bits).alias("bits"))


@register
def group_registration(spark, d):
    e = _index(spark, d)
    return I.register_groups(I.group_ids(e.filter("grp % 2 = 1")), e)


@register
def index_set_rows(spark, d):
    e = _index(spark, d)
    new = e.filter("pos % 50 = 0").select("pos", F.transform("vec", lambda x: x * 0 + 1).alias("vec"))
    return I.set_rows(e, new).select("label", "pos", F.round(F.aggregate(F.col("vec").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@register
def index_clear_and_insert(spark, d):
    e = _index(spark, d)
    return I.insert_only(I.clear(e), e.filter("label % 4 = 0").withColumn("ord", -F.col("pos"))).select("label", "pos")


@register
def label_checks(spark, d):
    e = _index(spark, d)
    even, thirds, odd = (e.filter(c) for c in ("label % 2 = 0", "label % 3 = 0", "label % 2 = 1"))
    facts = [("even and thirds disjoint", I.disjoint(even, thirds)), ("even and odd disjoint", I.disjoint(even, odd)), ("labels unique", I.is_unique(e)), ("groups unique", I.is_unique(e, "grp"))]
    return spark.createDataFrame(facts, "fact string, holds boolean")


# ---- documents


def _documents(spark, d) -> db.DocumentDB:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text", F.lit(0).alias("ord"))
    return db.DocumentDB.create(spark, doc="long", min_len=100).add(docs)


@register
def document_search(spark, d):
    """Best chunks among those of each query's five best documents; equal chunks are told apart by rank alone."""
    path = _fresh(spark, "documents")
    _documents(spark, d).remove(table(spark, d, "documents").filter("doc_id % 10 = 0").select(F.col("doc_id").alias("doc"))).save(path)
    found = db.DocumentDB.load(spark, path).search_chunks(_asked(spark, d), top_d=5, top_k=10)
    return found.select("qid", "rank", F.round("sim", 6).alias("sim"))


@register
def document_get(spark, d):
    asked = table(spark, d, "documents").filter("doc_id % 20 = 0").select((-F.col("doc_id")).alias("ord"), F.col("doc_id").alias("doc"))
    return _documents(spark, d).get(asked).select("ord", "doc", _md5("text"))


@register
def document_replacement(spark, d):
    """A document added again: its old chunks go."""
    again = table(spark, d, "documents").filter("doc_id % 3 = 0").select(F.col("doc_id").alias("doc"), F.substring("text", 1, 400).alias("text"), F.lit(1).alias("ord"))
    return _documents(spark, d).add(again).chunks.groupBy("doc").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@register
def user_splitter(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    return db.chunk(docs, lambda t: F.split(t, r"\. ", -1)).groupBy("doc").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


# ---- files


@register
def jsonl_database(spark, d):
    """JSON lines written and read back; the first 100 rows in the file's order."""
    path = _fresh(spark, "jsonl")
    table(spark, d, "documents").orderBy("doc_id").select(F.col("doc_id").cast("string").alias("title"), "text").write.json(path)
    return db.TextDB.from_jsonl(spark, path, max_rows=100).rows.select("label", "pos", _md5("text"))


@register
def csv_database(spark, d):
    """CSV with quotes and line breaks, two of its columns read back."""
    path = _fresh(spark, "csv")
    files.write_csv(table(spark, d, "documents").select("lang", F.col("doc_id").cast("string").alias("title"), "source", F.concat(F.lit(' "a", '), "text").alias("text")), path)
    return files.read_csv(spark, path, columns=["title", "text"]).select("title", _md5("text"))


@register
def text_lines(spark, d):
    path = _fresh(spark, "lines")
    table(spark, d, "nation").select("n_name").write.text(path)
    return files.read_lines(spark, path)


def _pages(spark, d) -> str:
    """Each page as a file of its own."""
    path = _fresh(spark, "pages")
    files.write_each(table(spark, d, "pages").select(F.concat(F.lit("page_id="), "page_id").alias("name"), "html"), "name", "html", path)
    return path


def _page(name: str):
    return F.regexp_extract(name, r"page_id=(\d+)\.", 1).cast("long").alias("page_id")


@register
def folder_documents(spark, d):
    return files.read_documents(spark, _pages(spark, d), "*.txt").select(_page("name"), _md5("text"))


@register
def folder_database(spark, d):
    """A folder's files as documents, saved and loaded; then every page of another folder's listing counts as changed, none of its own."""
    root, path = _pages(spark, d), _fresh(spark, "folder")
    db.FilesDB.create(spark, root, "*.txt", min_len=20).save(path)
    loaded = db.FilesDB.load(spark, path)
    n = loaded.db.chunks.groupBy(_page("doc")).agg(F.count("*").alias("n"))
    changed = loaded.changed().select(_page("name"), F.lit(True).alias("changed"))
    return n.join(changed, "page_id", "left").select("page_id", "n", F.coalesce("changed", F.lit(False)).alias("changed"))


@register
def text_decoding(spark, d):
    """UTF-8 with broken bytes: what is none is left out."""
    raw = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FFC3"))).alias("raw"))
    return raw.select("conv_id", "turn", F.md5(files.decode("raw").cast("binary")).alias("md5"))


@register
def json_values(spark, d):
    e = table(spark, d, "events").select("event_id", F.to_json(F.struct(F.struct(F.col("event_type").alias("kind")).alias("inner"))).alias("j"))
    return e.select("event_id", report.nested("j", ["inner", "kind"]).alias("kind"))


# ---- evaluation


@register
def result_files(spark, d):
    """Metrics written in a folder for each run and task, read back, the runs' names taken apart."""
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    metric = F.round(F.avg("l_discount"), 6)
    runs = li.groupBy(F.concat(F.lit("org"), "l_linestatus", F.lit("/my-model-"), F.lit("256-"), "l_returnflag").alias("run"), F.col("p_brand").alias("bench")).agg(metric.alias("metric"))
    path = _fresh(spark, "results")
    report.write_results(runs.withColumn("split", F.when(F.col("bench") == "Brand#11", "dev").otherwise("test")), path)
    return report.read_results(spark, path, lambda b: F.when(F.col(b) == "Brand#11", "dev").otherwise("test"))


@register
def retrieval_evaluation(spark, d):
    """nDCG of searches over 4-bit vectors against exact ones, a task for each group of the index."""
    tasks = {}
    for g in (0, 1, 2):
        part = _index(spark, d).filter(F.col("grp") == g)
        tasks[f"group{g}"] = (knn.topk(_queries(spark, d), part), knn.topk(_queries(spark, d), I.quantized(part, Q4), spec=Q4))
    return report.evaluate(tasks, "local/hash-64-qint4").select("run", "split", "bench", F.round("metric", 6).alias("metric"))


@register
def approximate_recall(spark, d):
    """Whether each approximate index finds at least nine in ten of the exact ten neighbours over the whole table."""
    exact = knn.topk(_queries(spark, d), _index(spark, d))
    out = None
    for name, found in (("lsh", knn.lsh_topk(_queries(spark, d), _index(spark, d))), ("ivf", knn.ivf_topk(_queries(spark, d), _index(spark, d)))):
        row = report.recall(exact, found).agg((F.avg("recall") >= 0.9).alias("enough")).select(F.lit(name).alias("method"), "enough")
        out = row if out is None else out.unionByName(row)
    return out


class _Interpreted:
    """The hashing embedder as a column expression, to hold the Arrow one against."""

    name, dims = "hash-64", 64

    def column(self, text):
        return X.hash_embedding(text, 64)


@register
def embedder_parity(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return report.embedder_parity(docs, embed.HashEmbedder(64), _Interpreted(), 200).select("id", F.round("sim", 6).alias("sim"))


@register
def tokenizer_parity(spark, d):
    import public_tokenizers

    turns = table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    return report.tokenizer_parity(turns, public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json"), 120)


@register
def embedding_profile(spark, d):
    docs = table(spark, d, "documents").select("text")
    p = report.profile(docs, embed.HashEmbedder(64).column("text"))
    row = [(p["rows"], round(p["mean_len"], 6), round(p["std_len"], 4), p["rows_per_second"] > 0)]
    return spark.createDataFrame(row, "rows long, mean_len double, std_len double, timed boolean")


@register
def kernel_profile(spark, d):
    rows = [(b, all(v > 0 for v in report.profile_kernels(4096, 64, b).values())) for b in (8, 4, 2, 1)]
    return spark.createDataFrame(rows, "bits int, timed boolean")


@register
def sharded_embedding(spark, d):
    """Vectors of all documents as one job, a folder a shard."""
    path = _fresh(spark, "vectors")
    embed.embedding_job(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), embed.HashEmbedder(64), path, shards=8)
    back = spark.read.parquet(path)
    return back.agg(F.count_distinct("shard").cast("int").alias("shards"), F.count("*").alias("n"), F.sum(F.size("vec")).alias("values"))


@register
def token_windows(spark, d):
    """The pieces of a text by tokens, put together, are the text; and none has too many tokens."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    parts = table(spark, d, "documents").select("doc_id", embed.token_windows("text", path, 256).alias("p"))
    return parts.select("doc_id", F.md5(F.array_join("p", "").cast("binary")).alias("md5"))


@register
def token_state_pooling(spark, d):
    """Vectors read as eight token states of eight values, the last two masked."""
    width = 8
    states = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(F.col("vec").cast("array<double>"), i * width + 1, F.lit(width)))
    e = _index(spark, d).select("label", states.alias("s"), F.array(*[F.lit(int(i < 6)) for i in range(8)]).alias("m"))
    out = None
    for how in ("mean", "cls", "last", "max"):
        rows = _components(e.select("label", F.lit(how).alias("how"), pool("s", "m", how).alias("vec")), "label", "how")
        out = rows if out is None else out.unionByName(rows)
    return out


# ---- small ones


@register
def size_histogram(spark, d):
    docs = table(spark, d, "documents").select((F.col("n_chars") / 500).cast("long").alias("size"), "doc_id")
    return A.size_histogram(docs, "size", "doc_id").select("size", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "n")


@register
def quant_kinds(spark, d):
    specs = [Q.FLOAT, Q.HALF, *(Q.QuantSpec.from_range(f"qint{b}", -1.0, 2.0) for b in (8, 4, 2, 1)), Q.SIGN]
    rows = [(i, s.kind, s.bits, s.quantized, None if s.scale is None else round(s.scale, 9), None if s.zero_point is None else round(s.zero_point, 9)) for i, s in enumerate(specs)]
    return spark.createDataFrame(rows, "n int, kind string, bits int, quantized boolean, scale double, zero_point double")


@register
def sign_vectors(spark, d):
    """The preset of one bit: every component becomes 1 or -1."""
    e = _index(spark, d).select("label", Q.dequantize(Q.quantize("vec", Q.SIGN), Q.SIGN).alias("vec"))
    return _components(e, "label")


@register
def demean_squared(spark, d):
    return _components(A.demean(_index(spark, d).select("label", "vec"), norm="squared"), "label")


@register
def metadata_from_csv(spark, d):
    """Metadata from a CSV file with dates that are none and labels given twice; the index keeps its order."""
    path = _fresh(spark, "meta")
    li = table(spark, d, "lineitem")
    day = F.when(F.col("l_orderkey") % 7 == 0, F.lit("no date")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    files.write_csv(li.select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"), day.alias("date")), path)
    meta = files.read_csv(spark, path, "key long, line int, date string").withColumn("date", analytics.parse_date("date"))
    out = analytics.metadata_merge(_index(spark, d).select("label", "grp", "pos"), meta, "key", ["line", "date"])
    return out.select("label", "grp", "pos", F.col("date").cast("string").alias("date"))


@register
def token_texts(spark, d):
    """The first five tokens of a turn, continuations without their prefix."""
    words = F.transform(F.split("text", " ", -1), lambda w: F.when(F.length(w) > 4, F.concat(F.lit("##"), w)).otherwise(w))
    c = table(spark, d, "conversations").select("conv_id", "turn", F.transform(X.truncate(words, 5), lambda w: X.strip_prefix(w)).alias("t"))
    return c.select("conv_id", "turn", F.md5(F.array_join("t", " ").cast("binary")).alias("md5"))


@register
def usage_windows(spark, d):
    """Requests and characters in sliding windows, by the operator that also runs on streams."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.length("props").alias("tokens"))
    out = upserts.usage_stream(e, "ts", "user_id", "tokens", "1 day", "6 hours")
    return out.select(F.unix_timestamp("start").alias("start"), "user_id", "requests", "tokens")


@register
def document_centroid_search(spark, d):
    """Documents by the similarity of their centroids, through the index that a document database keeps."""
    docs = _docs(spark, d).withColumn("grp", F.lit(0))
    return knn.similarity(_queries(spark, d), docs).groupBy("label").agg(F.round(F.max("sim"), 6).alias("best"), F.round(F.avg("sim"), 6).alias("mean"))


@register
def packed_totals(spark, d):
    """What batches hold, by source: every character once, no batch above its limit."""
    docs = table(spark, d, "documents").select("source", "doc_id", F.coalesce("n_chars", F.length("text"), F.lit(0)).alias("size"))
    packed = embed.pack_batches(embed.split_sizes(docs, "size", 8192), "source", ["doc_id", "piece"], "size", 8192)
    by_batch = packed.groupBy("source", "batch_no").agg(F.sum("size").alias("size"), F.count("*").alias("pieces"))
    return by_batch.groupBy("source").agg(F.sum("size").alias("chars"), F.sum("pieces").alias("pieces"), (F.max("size") <= 8192).alias("fits"))


@register
def edit_script_lengths(spark, d):
    """Length of the edit script between the letters of a turn's first 40 characters and the next turn's: the edit distance."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.substring(F.regexp_replace("text", r"[^\x00-\x7F]", ""), 1, 40).alias("t"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("u"))
    pairs = c.groupBy("conv_id", "turn").agg(F.min("t").alias("t")).join(nxt.groupBy("conv_id", "turn").agg(F.min("u").alias("u")), ["conv_id", "turn"])
    ops = report.edit_operations(pairs.select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.split("t", "").alias("a"), F.split("u", "").alias("b")))
    return ops.groupBy("id").agg(F.count("*").alias("n"))
