"""Vector, text, database, source and streaming operators on small fixtures."""

import datetime as dt
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecloom.functions import quant as Q
from vecloom.functions import text as X
from vecloom.functions import vec as V
from vecloom.operators import aggregates as A
from vecloom.operators import analytics, db, embed, knn, limits, report
from vecloom.operators import index as I
from vecloom.plans.queries import queries


def one(df):
    return df.first()[0]


def index_of(spark, vectors, groups=None):
    rows = [(i, (groups or [0] * len(vectors))[i], i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "label long, grp int, pos long, vec array<double>")


def test_kernel_smoke(spark):
    spec = Q.QuantSpec("qint8", 1.0, 127.5)
    df = spark.createDataFrame([([0.1] * 16, [1.0] * 16)], "a array<float>, b array<double>").withColumn("q", Q.quantize("a", spec))
    r = df.select("q", Q.dequantize("q", spec).alias("d"), Q.quantized_dot("q", "b", spec).alias("dot")).first()
    assert r.q == [128] * 16 and r.d == [0.5] * 16 and r.dot == 8.0


def test_pack_order_ties_and_clamp(spark):
    df = spark.createDataFrame([([3, 9],)], "c array<int>")
    assert one(df.select(Q.pack("c", 4))) == [147] and one(df.select(Q.unpack(Q.pack("c", 4), 4))) == [3, 9]
    x = spark.createDataFrame([([0.5, 1.5, 2.5, -900.0, 900.0, 0.0, 0.0, 0.0],)], "v array<double>")
    for bits in (8, 4, 2, 1):
        got = one(x.select(Q.codes("v", Q.QuantSpec(f"qint{bits}", 1.0, 0.0))))
        top = 2**bits - 1
        assert got == [0, min(2, top), min(2, top), 0, top, 0, 0, 0]
    with pytest.raises(Exception, match="whole bytes"):
        spark.createDataFrame([([1, 2, 3],)], "c array<int>").select(Q.pack("c", 4)).collect()


@settings(max_examples=80, deadline=None)
@given(st.sampled_from([8, 4, 2, 1]), st.lists(st.floats(-0.5, 0.5), min_size=8, max_size=8))
def test_numpy_twin_round_trip(bits, xs):
    spec = Q.QuantSpec.from_width(f"qint{bits}", 0.0, 0.5)
    x = np.array(xs)
    c = Q.np_codes(x, spec)
    assert (Q.np_unpack(Q.np_pack(c, bits), bits) == c).all()
    assert np.abs(Q.np_dequantize(Q.np_pack(c, bits), spec) - x).max() <= spec.scale / 2 + 1e-9


def test_specs(spark):
    s = Q.QuantSpec.from_range("qint4", -1.0, 2.0)
    assert s.scale == pytest.approx(0.2) and s.zero_point == pytest.approx(5.0) and Q.QuantSpec.from_json(s.to_json()) == s
    assert one(spark.createDataFrame([([-3.0, 0.2] * 4,)], "v array<double>").select(Q.dequantize(Q.quantize("v", Q.SIGN), Q.SIGN))) == [-1.0, 1.0] * 4
    with pytest.raises(ValueError):
        Q.QuantSpec("qint8")
    h = spark.createDataFrame([([0.1, 1000.3, 1e-7, -2.5],)], "v array<double>").select(Q.quantize("v", Q.HALF)).first()[0]
    assert h == pytest.approx(np.array([0.1, 1000.3, 1e-7, -2.5]).astype(np.float16).astype(float).tolist())
    e = index_of(spark, [[0.0, 1.0], [-2.0, 0.5]])
    assert Q.QuantSpec.from_data("qint8", e, "vec") == Q.QuantSpec.from_range("qint8", -2.0, 1.0)


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    r = df.select(V.normalize("a"), V.normalize("z"), V.rescale("a", "squared"), V.norm("a")).first()
    assert list(r) == [[0.6, 0.8], [0.0, 0.0], [3 / 25, 4 / 25], 5.0]
    assert [x[0] for x in spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 5, 1024, 1025)], "x long").select(V.next_power_of_two("x")).collect()] == [1, 1, 2, 4, 8, 1024, 2048]
    s = spark.createDataFrame([([[1.0, 2.0], [3.0, -4.0], [9.0, 9.0]], [1, 1, 0])], "s array<array<double>>, m array<int>")
    assert list(s.select(V.pool("s", "m"), V.pool("s", "m", "cls"), V.pool("s", "m", "last"), V.pool("s", "m", "max")).first()) == [[2.0, -1.0], [1.0, 2.0], [3.0, -4.0], [3.0, 2.0]]


def test_engines_agree_and_ties_go_to_position(spark):
    rng = np.random.default_rng(4)
    vectors = np.round(rng.normal(size=(300, 8)), 1)
    vectors[100:140] = vectors[7]
    idx = index_of(spark, vectors, [i % 5 for i in range(300)]).repartition(4)
    q = spark.createDataFrame([(i, [float(x) for x in vectors[i]]) for i in range(0, 300, 20)] + [(7, [float(x) for x in vectors[7]])], "qid long, vec array<double>")
    key = lambda d: sorted((r.qid, r.rank, r.label, round(r.sim, 9)) for r in d.collect())
    a, b = knn.topk(q, idx, 10), knn.topk(q, idx, 10, engine="sql")
    assert key(a) == key(b)
    brute = [(i, k + 1, int(j)) for i in (7,) for k, j in enumerate(sorted(range(300), key=lambda j: (-round(float(vectors[i] @ vectors[j]), 9), j))[:10])]
    assert [x[:3] for x in key(a) if x[0] == 7] == brute
    assert key(knn.topk(q, idx, 10, groups=[2])) == key(knn.topk(q, idx, 10, groups=[2], engine="sql"))
    assert knn.topk(q, idx, 100, groups=[2]).groupBy("qid").count().filter("count <> 60").count() == 0
    with pytest.raises(Exception, match="unknown group"):
        knn.topk(q, idx, groups=[77]).collect()
    spec = Q.QuantSpec.from_width("qint8", 0.0, 4.0)
    packed = I.quantized(idx, spec)
    assert key(knn.topk(q, packed, 5, spec=spec)) == key(knn.topk(q, packed, 5, spec=spec, engine="sql"))


def test_sql_engine_makes_no_pairs_of_many_queries(spark):
    rng = np.random.default_rng(8)
    idx = index_of(spark, rng.normal(size=(200, 8)))
    q = idx.select(F.col("label").alias("qid"), "vec")
    key = lambda d: sorted((r.qid, r.rank, r.label, round(r.sim, 9)) for r in d.collect())
    joins = lambda d: "NestedLoopJoin" in d._jdf.queryExecution().executedPlan().toString()
    few, many = (knn.topk(q.filter(c), idx, 3, engine="sql") for c in ("qid < 10", "qid < 150"))
    assert joins(few) and not joins(many)
    assert key(many) == key(knn.topk(q.filter("qid < 150"), idx, 3))


def test_approximate_search_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 16))
    v = centres[rng.integers(0, 8, 400)] + 0.2 * rng.normal(size=(400, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    idx = index_of(spark, v)
    q = idx.filter("label % 20 = 0").select(F.col("label").alias("qid"), "vec")
    exact = knn.topk(q, idx, 10)
    for other in (knn.lsh_topk(q, idx, 10), knn.ivf_topk(q, idx, 10, cells=8, nprobe=4)):
        assert one(report.recall(exact, other).agg(F.avg("recall"))) >= 0.9


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01", "sf0.1"])
def test_registered_lsh_recall(spark, scale):
    """The registered query, with its own parameters, over the whole table."""
    d = f"/root/testdata/{scale}"
    if not os.path.isdir(d):
        pytest.skip("needs the test tables")
    found = queries()
    assert one(report.recall(found["knn_top10"](spark, d), found["lsh_neighbors"](spark, d)).agg(F.avg("recall"))) >= 0.9


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01", "sf0.1"])
def test_registered_ivf_recall(spark, scale):
    """The registered query, with its own parameters, over the whole table."""
    d = f"/root/testdata/{scale}"
    if not os.path.isdir(d):
        pytest.skip("needs the test tables")
    found = queries()
    assert one(report.recall(found["knn_top10"](spark, d), found["ivf_neighbors"](spark, d)).agg(F.avg("recall"))) >= 0.9


def test_upsert_and_delete(spark):
    idx = index_of(spark, [[1.0], [2.0], [3.0]])
    new = spark.createDataFrame([(9, 5, 0, [9.0]), (1, 7, 1, [20.0]), (8, 5, 2, [8.0])], "label long, grp int, ord long, vec array<double>")
    got = sorted((r.pos, r.label, r.grp, r.vec[0]) for r in I.upsert(idx, new).collect())
    assert got == [(0, 0, 0, 1.0), (1, 1, 7, 20.0), (2, 2, 0, 3.0), (3, 9, 5, 9.0), (4, 8, 5, 8.0)]
    again = I.upsert(I.upsert(idx, new), new)
    assert sorted((r.pos, r.label) for r in again.collect()) == [(p, x) for p, x, *_ in got]
    with pytest.raises(Exception, match="label given twice"):
        I.upsert(idx, new.unionByName(new)).collect()
    with pytest.raises(Exception, match="label is known"):
        I.insert_only(idx, new).collect()
    gone = I.delete(idx, spark.createDataFrame([(0,), (55,)], "label long"))
    assert [r.label for r in gone.orderBy("pos").collect()] == [1, 2] and I.clear(idx).count() == 0
    assert I.delete(idx, where=F.col("vec")[0] > 1.5).count() == 1


def test_lookup(spark):
    idx = index_of(spark, [[1.0], [2.0], [3.0]])
    assert [r.label for r in I.get_positions(idx, spark.createDataFrame([(0, -1), (1, 0)], "ord int, at int")).orderBy("ord").collect()] == [2, 0]
    with pytest.raises(Exception, match="out of bounds"):
        I.get_positions(idx, spark.createDataFrame([(0, 3)], "ord int, at int")).collect()
    with pytest.raises(Exception, match="no such label"):
        I.get(idx, spark.createDataFrame([(0, 44)], "ord int, label long")).collect()
    assert not I.disjoint(idx, idx) and I.is_unique(idx)


def test_splitter(spark):
    cases = [("  a \n\n b\t\xa0\nccc ", 1, None, ["a", "b", "ccc"]), ("a\nbbb", 2, None, ["bbb"]), ("abcdefg\nx", 2, 3, ["abc", "def", "g"]), ("", 1, None, []), (None, 1, None, [])]
    for t, least, most, want in cases:
        assert one(spark.createDataFrame([(t,)], "t string").select(X.split_text("t", "\n", least, most))) == want
    assert one(spark.createDataFrame([(" whole ",)], "t string").select(X.split_text("t", None))) == [" whole "]
    names = spark.createDataFrame([("org/some-model-256-qint8",)], "t string").select(*X.run_name("t")).first()
    assert list(names) == ["org", "some-model", "256", "qint8"]
    assert [r[0] for r in spark.createDataFrame([("##ing",), ("run",)], "t string").select(X.strip_prefix("t")).collect()] == ["ing", "run"]


def test_aggregates(spark):
    df = spark.createDataFrame([(1, [1.0, -2.0]), (1, [-1.0, -4.0]), (2, [3.0, 4.0]), (3, [1.0, 0.0]), (3, [-1.0, 0.0])], "g int, vec array<double>")
    c = {r.g: r.vec for r in A.centroids(df, ["g"]).collect()}
    assert c[1] == [0.0, -1.0] and c[2] == [0.6, 0.8] and c[3] == [0.0, 0.0]
    s = {r.g: r.vec for r in A.signed_square_mean(df, ["g"]).collect()}
    assert s[2] == pytest.approx([3.0, 4.0]) and s[1] == pytest.approx([0.0, -(10**0.5)])
    assert A.exceeds(df.select("g"), {"g": 9}).first()["any_over"]


def test_analytics(spark):
    d = lambda s: None if s is None else dt.date.fromisoformat(s)
    rows = [(0, d("2000-01-01"), [1.0]), (1, d("1999-01-01"), [2.0]), (2, d("1999-01-02"), [3.0]), (3, d("2000-12-31"), [4.0]), (4, d("2001-01-01"), [5.0]), (5, None, [6.0])]
    df = spark.createDataFrame(rows, "label int, date date, vec array<double>")
    got = {r.label: r for r in analytics.windowed_topk(df, df, years=1, ks=(1, 2)).collect()}
    # 2000-01-01: back to less than 365 days, so 1999-01-02 but not 1999-01-01; on to 365 days, so 2000-12-31 but not 2001-01-01
    assert (got[0].pre_1, got[0].pre_2, got[0].pos_2) == (3.0, 2.0, 4.0)
    assert got[5].pre_2 == 36.0 and got[5].pos_1 is None
    sims, counts = analytics.yearly_means(df, df, 1999)
    assert {(r.year, r.n) for r in counts.collect()} == {(1999, 3), (2000, 2), (2001, 1)}
    nov = {r.label: r for r in analytics.novelty(df, sims, counts, 1999, delta=1, year_cut=2000).collect()}
    assert nov[1].pre == pytest.approx(2 * 11 / 3) and nov[1].pos == pytest.approx(2 * 2.5) and nov[4].pre is None


def test_rate_limits(spark):
    t0 = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([(i, 1, t0 + dt.timedelta(seconds=s), 1, 10) for i, s in enumerate([0, 10, 20, 100])], "event_id int, u int, ts timestamp_ntz, req int, tok int")
    assert [r.n for r in limits.usage(log, "70 SECONDS", "u", "ts", {"n": "req"}).orderBy("event_id").collect()] == [1, 2, 3, 1]
    w = {r.event_id: r.wait_s for r in limits.wait(log, 70, "u", "ts", {"req": 1, "tok": 25}).collect()}
    assert w == {0: 0.0, 1: 60.0, 2: 60.0, 3: 0.0}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 8), max_size=30))
def test_greedy_batches(sizes):
    got = embed.greedy_batches(sizes, 8)
    assert sorted(i for b in got for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 8 for b in got)


def test_greedy_batches_order():
    assert embed.greedy_batches([5, 5, 3, 2], 8) == [[0, 2], [1, 3]]
    with pytest.raises(ValueError):
        embed.greedy_batches([9], 8)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_registered_packing_holds_all_text(spark):
    """Documents beyond the limit of a batch are packed whole, in pieces."""
    docs = {r.doc_id: r.n_chars for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "n_chars").collect()}
    got, load = {}, {}
    for r in queries()["pack_token_batches"](spark, "/root/testdata/sf0.01").collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r["size"]
        load[r.source, r.batch_no] = load.get((r.source, r.batch_no), 0) + r["size"]
    assert max(docs.values()) > 8192 and got == docs and max(load.values()) <= 8192


def test_packing_of_a_hot_key_in_shards(spark):
    rows = [("hot", i, 1 + i % 8) for i in range(200)] + [("cold", 900, 8), (None, 901, 3), (None, 902, 5)]
    df = spark.createDataFrame(rows, "k string, i long, n int")
    out = embed.pack_batches(df, "k", "i", "n", 8, shard_rows=20).collect()
    assert sorted((r.k or "", r.i, r.n) for r in out) == sorted((k or "", i, n) for k, i, n in rows)
    load = {}
    for r in out:
        load[r.k, r.batch_no] = load.get((r.k, r.batch_no), 0) + r.n
    assert max(load.values()) <= 8 and {b for k, b in load if k == "hot"} == set(range(len(load) - 2)) and load[None, 0] == load["cold", 0] == 8


def test_embedders(spark):
    e = embed.PandasEmbedder("len", 2, lambda: lambda ts: [[len(t), 1.0] for t in ts], batch_size=2)
    got = [r[0] for r in spark.createDataFrame([("aaa",), ("",), (None,), ("b",)], "t string").coalesce(1).select(e.column("t")).collect()]
    assert got[0] == pytest.approx([3 / 10**0.5, 1 / 10**0.5]) and got[1] == [0.0, 0.0] and got[2] == [0.0, 0.0]
    h = one(spark.createDataFrame([("A b, a",)], "t string").select(embed.HashEmbedder(64).column("t")))
    want = np.zeros(64)
    for w in ("a", "b", "a"):
        want[embed.md5_bucket(w, 64)] += 1
    assert h == pytest.approx((want / np.linalg.norm(want)).tolist())
    both = spark.createDataFrame([("A b, a É2x",), ("",), (None,)], "t string").select(embed.HashEmbedder(64).column("t").alias("p"), X.hash_embedding("t", 64).alias("j"))
    assert all(r.p == pytest.approx(r.j) for r in both.collect())
    with pytest.raises(ImportError, match="not installed"):
        embed.lazy("no_such_package_here")
    long = embed.embed_long(spark.createDataFrame([(1, "one two three four")], "k int, t string"), "k", "t", embed.HashEmbedder(8), 9)
    assert len(long.first().vec) == 8


def test_text_and_document_databases(spark, tmp_path):
    rows = spark.createDataFrame([("a", "red apple", None, 0), ("b", "green pear", None, 1), ("a", "red cherry", None, 2)], "label string, text string, grp string, ord long")
    t = db.TextDB.create(spark).add(rows)
    assert {r.label: (r.pos, r.text) for r in t.rows.collect()} == {"a": (0, "red cherry"), "b": (1, "green pear")}
    assert t.search("cherry", top_k=1).first()["label"] == "a"
    assert one(t.context("green pear").select("context")).startswith("b: green pear\n\na: ")
    assert t.remove(["a", "zz"]).count() == 1 and t.clear().count() == 0
    with pytest.raises(Exception, match="no such label"):
        t.remove(["zz"], strict=True).rows.collect()
    t.save(str(tmp_path / "t"))
    with pytest.warns(UserWarning):
        db.TextDB.load(spark, str(tmp_path / "t"), embed.HashEmbedder(32))
    docs = spark.createDataFrame([("d1", "one fish\n\ntwo fish", 0), ("d2", "blue whale", 1), ("d3", " \n ", 2)], "doc string, text string, ord long")
    d = db.DocumentDB.create(spark, min_len=2).add(docs)
    assert d.chunks.count() == 3 and d.docs.count() == 2
    assert [tuple(r) for r in d.get(["d2", "d1"]).orderBy("ord").collect()] == [(0, "d2", "blue whale"), (1, "d1", "one fish\n\ntwo fish")]
    best = d.search_chunks("two fish", top_d=1, top_k=5)
    assert [tuple(r.label) for r in best.orderBy("rank").collect()] == [("d1", 1), ("d1", 0)]
    shorter = d.add(spark.createDataFrame([("d1", "only line", 0)], "doc string, text string, ord long"))
    assert shorter.chunks.filter("doc = 'd1'").count() == 1 and d.remove(["d1"]).chunks.count() == 1
    d.save(str(tmp_path / "d"))
    assert db.DocumentDB.load(spark, str(tmp_path / "d")).chunks.count() == 3
    (tmp_path / "x.jsonl").write_text('{"title": "p", "text": "hello world"}\n{"title": "q", "text": "bye"}\n')
    assert db.TextDB.from_jsonl(spark, str(tmp_path / "x.jsonl")).count() == 2
    (tmp_path / "x.csv").write_text("title,text\np,hello\nq,bye\n")
    assert db.DocumentDB.from_csv(spark, str(tmp_path / "x.csv")).docs.count() == 2


def test_files_database(spark, tmp_path):
    root = tmp_path / "files"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_bytes(b"first \xff file")
    (root / "sub" / "b.md").write_text("second file")
    (root / "c.json").write_text("{}")
    (root / "noext").write_text("unknown kind")
    f = db.FilesDB.create(spark, str(root))
    assert sorted(r.doc for r in f.db.docs.collect()) == ["a.txt", "noext", "sub/b.md"] and f.times.count() == 4
    f.save(str(tmp_path / "saved"))
    f = db.FilesDB.load(spark, str(tmp_path / "saved"))
    assert f.changed().count() == 0
    import os

    (root / "a.txt").write_text("changed now")
    os.utime(root / "a.txt", (4_000_000_000, 4_000_000_000))
    (root / "noext").unlink()
    assert [r.name for r in f.changed().collect()] == ["a.txt"]
    g = f.refresh(drop_missing=True)
    assert sorted(r.text for r in g.db.chunks.collect()) == ["changed now", "second file"] and g.times.count() == 3


def test_gguf(spark, tmp_path):
    from vecloom.sources import gguf

    path = str(tmp_path / "m.gguf")
    fields = [("a.u8", 0, 7), ("a.i64", 11, -5), ("a.f", 6, 0.5), ("a.bool", 7, True), ("a.s", 8, "héllo"), ("a.arr", 9, (5, [1, -2])), ("a.strs", 9, (8, ["x", "y"]))]
    x = np.arange(6, dtype=np.float32).reshape(2, 3)
    gguf.write_gguf(path, fields, [("w", x), ("h", x.astype(np.float16)), ("i", x.astype(np.int8))])
    got = {r.key: r for r in gguf.read_gguf(spark, path).collect()}
    assert got["a.u8"].num == 7 and got["a.i64"].num == -5 and got["a.f"].num == 0.5 and got["a.bool"].num == 1 and got["a.s"].str == "héllo"
    assert got["a.arr"].nums == [1.0, -2.0] and got["a.arr"].array_type == "INT32" and got["a.strs"].strs == ["x", "y"]
    t = {r.name: r for r in gguf.read_gguf(spark, path, "tensors").collect()}
    assert t["w"].shape == [2, 3] and all(t[k].data == x.ravel().tolist() for k in "whi") and t["h"].type == "F16"
    lines = {r.line for r in gguf.describe(gguf.read_gguf(spark, path)).collect()}
    assert "a.u8   = 7" in lines and "a.strs = 2 x <STRING>" in lines


def test_streams(spark, tmp_path):
    from vecloom.streaming import upserts

    src = str(tmp_path / "in")
    spark.createDataFrame([(i % 3, i) for i in range(10)], "k int, o int").repartition(3).write.parquet(src)
    q = upserts.upsert_stream(upserts.read_stream(spark, src, "k int, o int"), str(tmp_path / "state"), "k", "o", str(tmp_path / "cp"))
    q.awaitTermination()
    assert sorted(tuple(r) for r in upserts.current(spark, str(tmp_path / "state")).collect()) == [(0, 9), (1, 7), (2, 8)]
    logs = str(tmp_path / "logs")
    spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, s), 1, 5) for s in (0, 5, 30)], "ts timestamp, u int, tok int").write.parquet(logs)
    out = upserts.usage_stream(upserts.read_stream(spark, logs, "ts timestamp, u int, tok int"), "ts", "u", "tok")
    w = out.writeStream.format("memory").queryName("usage").outputMode("complete").trigger(availableNow=True).start()
    w.awaitTermination()
    assert spark.table("usage").agg(F.max("requests")).first()[0] == 3


def test_reports(spark):
    rows = [("m", "A", 0.5), ("m", "g1", 0.2), ("m", "g2", 0.4)]
    r = report.benchmark_report(spark.createDataFrame(rows, "model string, bench string, metric double"), ["model"], ["A", "g1", "g2"], ["g1", "g2"], "G").first()
    assert r.asDict() == {"model": "m", "Average": pytest.approx(40.0), "A": 50.0, "G": pytest.approx(30.0)}
    e = report.edit_operations(spark.createDataFrame([(1, ["a", "b"], ["a", "c", "d"]), (2, ["x"], ["x"])], "id int, a array<string>, b array<string>")).collect()
    assert [tuple(x) for x in e] == [(1, "insert", 1, 1), (1, "replace", 1, 2)]


def test_registry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def apply_script(a, b, ops):
    out, at = [], 0
    for op, i, j in ops:
        out += a[at:i]
        at = i
        if op != "delete":
            out.append(b[j])
        if op != "insert":
            at += 1
    return out + a[at:]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=9), st.lists(st.integers(0, 3), max_size=9))
def test_edit_scripts_are_shortest(a, b):
    cost = {(0, j): j for j in range(len(b) + 1)} | {(i, 0): i for i in range(len(a) + 1)}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            cost[i + 1, j + 1] = min(cost[i, j] + (x != y), cost[i, j + 1] + 1, cost[i + 1, j] + 1)
    ops = report.edit_script(a, b)
    assert len(ops) == cost[len(a), len(b)] and apply_script(a, b, ops) == b


def test_edit_scripts_of_long_texts_hold_few_rows(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 50, 3_000).tolist(), rng.integers(0, 50, 3_000).tolist()
    tracemalloc.start()
    ops = report.edit_script(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert apply_script(a, b, ops) == b and peak < 12 << 20  # the whole table is 36 MB
    short = [(rng.integers(0, 4, rng.integers(0, 30)).tolist(), rng.integers(0, 4, rng.integers(0, 30)).tolist()) for _ in range(100)]
    whole = [report.edit_script(x, y) for x, y in short]
    monkeypatch.setattr(report, "SCRIPT_CELLS", 0)
    assert [report.edit_script(x, y) for x, y in short] == whole


def test_tokenizer_parity_holds_few_tokens(spark):
    """Tokenizers are given some texts of a batch at a time, in windows and in comparisons."""
    import public_tokenizers

    one, other = (public_tokenizers.path(f"{x}.json") for x in ("word_bpe_49k", "byte_bpe_50k"))
    texts = ["word " * 40_000, "x", None, "", *["some text of words " * 200] * 300]
    blocks = list(embed.in_blocks([t or "" for t in texts]))
    assert [t for b in blocks for t in b] == [t or "" for t in texts]
    assert max(sum(map(len, b)) for b in blocks) <= embed.TOKENIZED_CHARS
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:40])], "id int, text string")
    pairs = report.edit_operations(df.select("id", report.tokens_of(F.substring("text", 1, 50), one).alias("a"), report.tokens_of(F.substring("text", 1, 50), other).alias("b")))
    assert sorted(map(tuple, report.tokenizer_parity(df, one, other, 50).collect())) == sorted(map(tuple, pairs.collect()))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(4 << 20)


@pytest.mark.parametrize(("index_bytes", "kept_bytes"), [(1 << 30, 1 << 30), (600, 1 << 30), (600, 0)])
def test_running_top_k(tmp_path, monkeypatch, index_bytes, kept_bytes):
    """In one chunk, in many chunks, and without room to keep results, a task gives all that the merged top k needs; ties go to position."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    monkeypatch.setattr(knn, "INDEX_BYTES", index_bytes)
    monkeypatch.setattr(knn, "KEPT_BYTES", kept_bytes)
    monkeypatch.setattr(knn, "QUERY_ROWS", 4)
    rng = np.random.default_rng(3)
    q, x = rng.integers(-2, 3, (9, 3)).astype(float), rng.integers(-2, 3, (60, 3)).astype(float)
    pq.write_table(pa.table({"qid": range(9), "vec": q.tolist(), "day": [10 * i for i in range(9)]}), tmp_path / "q.parquet", row_group_size=3)
    t = pa.table({"label": [f"l{i}" for i in range(60)], "pos": list(range(60)), "vec": x.tolist(), "day": [(i * 7) % 90 for i in range(60)]})
    sims = q @ x.T
    for sides, window in (({0: None}, None), ({0: lambda a, b: (b["day"][None, :] - a["day"][:, None] <= 0) & (b["day"][None, :] - a["day"][:, None] > -25), 1: lambda a, b: b["day"][None, :] > a["day"][:, None] + 60}, 91)):
        run = knn._partial(f"file://{tmp_path}", 5, Q.FLOAT, sides, ["day"], 9, window)
        found = [r for b in run(iter(t.to_batches(max_chunksize=7))) for r in b.to_pylist()]
        for k in range(9):
            for side, marks in sides.items():
                ok = np.ones(60, bool) if marks is None else marks({"day": np.array([10 * k])}, {"day": np.array(t.column("day"))})[0]
                want = sorted((-sims[k, i], i) for i in range(60) if ok[i])[:5]
                got = sorted((-r["sim"], r["pos"]) for r in found if r["qid"] == k and r["side"] == side)[:5]
                assert got == want
        if kept_bytes and index_bytes > 1 << 20:
            assert len(found) <= 9 * 5 * len(sides)


@pytest.mark.parametrize("marked", [False, True])
def test_running_top_k_holds_few_pairs(tmp_path, marked):
    """A chunk of many rows against a whole block of queries: similarities are never all there at once."""
    import tracemalloc

    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(6)
    q, x = rng.normal(size=(1_000, 8)), rng.normal(size=(30_000, 8))
    pq.write_table(pa.table({"qid": range(1_000), "vec": q.tolist()}), tmp_path / "q.parquet")
    t = pa.table({"label": list(range(30_000)), "pos": list(range(30_000)), "vec": x.tolist()})
    near = (lambda a, b: np.ones((len(a["vec"]), len(b["vec"])), bool)) if marked else None
    run = knn._partial(f"file://{tmp_path}", 10, Q.FLOAT, {0: near}, [], 9, None)
    batches = t.to_batches(max_chunksize=5_000)
    tracemalloc.start()
    found = [b for b in run(iter(batches))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in found) == 10_000 and peak < 100 << 20  # all pairs are 240 MB
    got = {(r["qid"], r["label"]) for b in found for r in b.to_pylist()}
    assert {(i, int(j)) for i in range(0, 1_000, 100) for j in np.argsort(-(x @ q[i]))[:10]} <= got


@pytest.mark.parametrize("names", [False, True])
def test_two_stage_search_of_many_queries_makes_no_pairs(spark, monkeypatch, names):
    rng = np.random.default_rng(12)
    v, d = np.round(rng.normal(size=(400, 4)), 1), rng.normal(size=(9, 4))
    chunks = index_of(spark, v, [i % 9 for i in range(400)])
    docs = index_of(spark, d).drop("grp")
    if names:
        chunks, docs = chunks.withColumn("grp", F.concat(F.lit("d"), "grp")), docs.withColumn("label", F.concat(F.lit("d"), "label"))
    q = index_of(spark, v[:150]).select(F.col("label").alias("qid"), "vec")
    key = lambda x: sorted((r.qid, r.rank, r.label, round(r.sim, 9)) for r in x.collect())
    many = db.two_stage(q, docs, chunks, 3, 7)
    plan = many._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(knn, "SQL_QUERIES", 1_000)
    joined = db.two_stage(q, docs, chunks, 3, 7)
    assert key(many) == key(joined) and len(key(many)) == 150 * 7
    assert "zip_with" not in plan and "zip_with" in joined._jdf.queryExecution().executedPlan().toString()


def test_windowed_topk_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    day0 = dt.date(2000, 1, 1)
    rows = [(i, None if i % 9 == 0 else day0 + dt.timedelta(days=int(rng.integers(0, 1500))), rng.normal(size=4).tolist()) for i in range(70)]
    df = spark.createDataFrame(rows, "label int, date date, vec array<double>").repartition(5)
    got = {r.label: r for r in analytics.windowed_topk(df, df, years=1, ks=(1, 3), exclude_self=True).collect()}
    number = lambda d: 0 if d is None else (d - dt.date(1970, 1, 1)).days
    for i, d, v in rows:
        for side in ("pre", "pos"):
            gaps = [(float(np.dot(v, w)), number(e) - number(d)) for j, e, w in rows if j != i]
            sims = sorted((s for s, g in gaps if (-365 < g <= 0 if side == "pre" else 0 < g <= 365)), reverse=True)
            for k in (1, 3):
                assert getattr(got[i], f"{side}_{k}") == (pytest.approx(np.mean(sims[:k])) if sims else None)


@pytest.mark.parametrize(("pairs", "kept"), [(1 << 20, 64 << 20), (64, 1)])
def test_windowed_topk_leaves_tasks_final(spark, monkeypatch, pairs, kept):
    """Each focal row has at most k results a side, however many tasks there are, and they are the best."""
    monkeypatch.setattr(knn, "PAIRS", pairs)
    monkeypatch.setattr(knn, "KEPT_BYTES", kept)
    rng = np.random.default_rng(7)
    days, v = rng.integers(0, 300, 600), rng.integers(-3, 4, (600, 4)).astype(float)
    df = spark.createDataFrame([(i, int(days[i]), v[i].tolist()) for i in range(600)], "label int, day int, vec array<double>").repartition(3)
    out = knn.window_topk(df, df, 100, 5)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in out.collect():
        got.setdefault((r.qid, r.side), []).append((r.rank, r.sim))
    gap, sims = days[None, :] - days[:, None], v @ v.T
    for i in range(600):
        for side, ok in enumerate(((gap[i] <= 0) & (gap[i] > -100), (gap[i] > 0) & (gap[i] <= 100))):
            want = sorted(sims[i][ok], reverse=True)[:5]
            assert [s for _, s in sorted(got.get((i, side), []))] == want and len(got.get((i, side), [])) == len(want)


def test_running_sums_of_a_hot_group(spark):
    rows = [(None if i % 11 == 0 else "hot" if i % 3 else "cold", i, i % 5) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, id int, n int")
    got = {r.id: (r.start, r.end) for r in A.bounds(df, "n", ["id"], ["g"]).collect()}
    at = {}
    for g, i, n in rows:
        assert got[i] == (at.get(g, 0), at.get(g, 0) + n)
        at[g] = at.get(g, 0) + n
    batches = A.batch_ids(df, 16, ["id"], ["g"]).filter("g = 'cold'").orderBy("id").collect()
    assert [r.batch for r in batches] == [k // 16 for k in range(len(batches))] and batches[-1].batch_end == len(batches)


def test_rate_limiter_keeps_its_limits():
    now, log = [0.0], []

    def sleep(s):
        now[0] += s

    limiter = embed.RateLimiter({"requests": 3, "tokens": 100}, 10.0, lambda: now[0], sleep)
    rng = np.random.default_rng(2)
    for _ in range(200):
        now[0] += float(rng.exponential(1.0))
        n = int(rng.integers(1, 60))
        limiter.take(requests=1, tokens=n)
        log.append((now[0], n))
        recent = [x for t, x in log if t > now[0] - 10.0 + 1e-9]
        assert len(recent) <= 3 and sum(recent) <= 100
    assert embed.RateLimiter({"tokens": 5}, 10.0, lambda: 0.0, sleep).wait_for(0.0, tokens=50) == 0


def test_http_embedder_cuts_and_counts_tokens(spark, monkeypatch):
    import io
    import json
    import urllib.request

    import public_tokenizers

    sent = []

    def urlopen(request, timeout):
        texts = json.loads(request.data)["input"]
        sent.append(texts)
        return io.BytesIO(json.dumps({"data": [{"index": i, "embedding": [float(len(t)), 0.0]} for i, t in reversed(list(enumerate(texts)))]}).encode())

    monkeypatch.setattr(urllib.request, "urlopen", urlopen)
    e = embed.http_embedder("http://localhost/v1", "m", 2, tokenizer=public_tokenizers.path("word_bpe_49k.json"), max_len=3, limits={"requests": 10, "tokens": 100})
    out = e.load()(["one two three four five", "six"])
    assert sent == [["one two three", "six"]] and out.tolist() == [[13.0, 0.0], [3.0, 0.0]]


def test_token_windows_and_user_splitter(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    t = "  one two  three four five six seven \n"
    df = spark.createDataFrame([(1, t), (2, ""), (3, None)], "doc int, text string")
    whole = {r.doc: r.p for r in df.select("doc", embed.token_windows("text", path, 3).alias("p")).collect()}
    assert "".join(whole[1]) == t and len(whole[1]) == 3 and whole[2] == [""] and whole[3] == [""]
    lapped = one(df.filter("doc = 1").select(embed.token_windows("text", path, 3, 1)))
    assert len(lapped) == 3 and lapped[1].startswith("three") and lapped[2].startswith("five")
    assert [r.text for r in db.chunk(df.filter("doc = 1"), lambda c: F.split(F.trim(c), "  ")).orderBy("chunk_no").collect()] == ["one two", "three four five six seven \n".rstrip(" ")]


def test_pooling_configuration_and_padding(tmp_path):
    import json

    assert embed.pooling_type(str(tmp_path)) is None
    (tmp_path / "1_Pooling").mkdir()
    (tmp_path / "modules.json").write_text(json.dumps([{"path": "", "type": "x.Transformer"}, {"path": "1_Pooling", "type": "x.Pooling"}]))
    for flag, want in (("mean_tokens", "mean"), ("cls_token", "cls"), ("lasttoken", "last"), ("max_tokens", "max")):
        (tmp_path / "1_Pooling/config.json").write_text(json.dumps({f"pooling_mode_{flag}": True}))
        assert embed.pooling_type(str(tmp_path)) == want
    (tmp_path / "1_Pooling/config.json").write_text(json.dumps({"pooling_mode_mean_sqrt_len_tokens": True}))
    with pytest.raises(ValueError, match="not supported"):
        embed.pooling_type(str(tmp_path))
    states = embed.np_pool(np.ones((1, 3, 2)), np.array([[1, 1, 0]]), "none")
    assert np.isnan(states[0, 2]).all() and (states[0, :2] == 1).all()


def test_gguf_keeps_whole_numbers(spark, tmp_path):
    from vecloom.sources.gguf import read_gguf, write_gguf

    path = f"file://{tmp_path}/models/a.gguf"
    ids = np.array([(1 << 62) + 1, -(1 << 62) - 1], np.int64)
    write_gguf(path, [("a", 11, (1 << 63) - 1), ("b", 10, (1 << 64) - 1), ("c", 9, (11, [-(1 << 63), 5]))], [("t", ids)])
    fields = {r.key: r for r in read_gguf(spark, f"file://{tmp_path}/models").collect()}
    assert int(fields["a"].whole) == (1 << 63) - 1 and int(fields["b"].whole) == (1 << 64) - 1 and [int(x) for x in fields["c"].wholes] == [-(1 << 63), 5]
    assert read_gguf(spark, path, "tensors").first().whole == ids.tolist()
    assert read_gguf(spark, f"{tmp_path}/models/*.gguf").count() == 3 and read_gguf(spark, str(tmp_path)).count() == 0


def test_stream_state_in_buckets(spark, tmp_path):
    """Later batches rewrite only the buckets that they touch, and replaced parts go; running a batch again changes nothing."""
    from vecloom.streaming import upserts

    schema = "k int, n int, v string"
    for i, rows in enumerate([[(k, 0, "a") for k in range(40)], [(3, 1, "b"), (50, 1, "b")], [(3, 0, "old"), (4, 2, "c")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = upserts.read_stream(spark, f"{tmp_path}/in/*", schema)
        upserts.upsert_stream(stream, f"{tmp_path}/state", "k", "n", f"{tmp_path}/checkpoint", buckets=8).awaitTermination()
    state = {r.k: (r.n, r.v) for r in upserts.current(spark, f"{tmp_path}/state").select("k", "n", "v").collect()}
    assert state == {k: (0, "a") for k in range(40)} | {3: (1, "b"), 50: (1, "b"), 4: (2, "c")}
    parts = upserts._parts(spark, f"{tmp_path}/state")
    assert max(len(v) for v in parts.values()) <= 3 and upserts.latest_version(spark, f"{tmp_path}/state") == 2


def test_pdf_pages(spark, tmp_path, monkeypatch):
    """PDFs go through the optional package: here a stand-in for it on the workers' path."""
    from vecloom.sources import files

    (tmp_path / "pypdf.py").write_text("class _P:\n    def __init__(self, t): self.t = t\n    def extract_text(self): return self.t\nclass PdfReader:\n    def __init__(self, f): self.pages = [_P(x) for x in f.read().decode().split('|')]\n")
    spark.sparkContext.addPyFile(str(tmp_path / "pypdf.py"))
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.pdf").write_bytes(b"one|two")
    (tmp_path / "d/b.txt").write_bytes(b"plain \xff")
    (tmp_path / "d/c.png").write_bytes(b"x")
    assert {r.name: r.text for r in files.read_documents(spark, f"{tmp_path}/d").collect()} == {"a.pdf": "one\n\ntwo", "b.txt": "plain ", "c.png": None}


def test_first_rows_of_files(spark, tmp_path):
    from vecloom.sources import files

    for i in range(3):
        (tmp_path / f"{i}.jsonl").write_text("".join(f'{{"title": "{i}-{k}", "text": "t"}}\n' for k in range(4)))
    got = files.read_jsonl(spark, f"{tmp_path}/*.jsonl", "title string", 6)
    assert [r.title for r in got.collect()] == [f"0-{k}" for k in range(4)] + ["1-0", "1-1"]


def test_jsonl_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    """The registered query's files, in order of their paths, hold the documents in order."""
    import json

    from vecloom.plans import stored

    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("needs the test tables")
    monkeypatch.setattr(stored, "_fresh", lambda spark, name: f"{tmp_path}/{name}")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = [r.label for r in queries()["jsonl_database"](spark, d).orderBy("pos").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    written = sorted((tmp_path / "jsonl").glob("*.json"))
    titles = [int(json.loads(line)["title"]) for f in written for line in f.read_text().splitlines()]
    assert len(written) > 1 and titles == sorted(titles) and got == [str(x) for x in titles[:100]]


def test_many_small_files_take_few_tasks(spark, tmp_path):
    """Files are listed and read in tasks, as Spark's own source finds them, and dealt out by number, not four megabytes a file."""
    from vecloom.sources import files

    for k in range(400):
        at = tmp_path / f"d{k % 7}" / f"e={k % 3}"
        at.mkdir(parents=True, exist_ok=True)
        (at / f"f{k}.txt").write_text(f"text {k}")
        (at / f"f{k}.md").write_text("other")
    for name in (".hidden.txt", "_temporary.txt", "_a=1.txt", "[x] y%20z.txt"):
        (tmp_path / "d0" / name).write_text(name)
    (tmp_path / "_gone").mkdir()
    (tmp_path / "_gone" / "f.txt").write_text("gone")
    for pattern in ("*.txt", "f{1,2}?.*", "[!f]*"):
        own = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(str(tmp_path))
        got = files._binary(spark, str(tmp_path), pattern)
        assert sorted(map(tuple, got.select(own.columns).collect())) == sorted(map(tuple, own.collect())) and got.count() > 0
    assert files.read_documents(spark, str(tmp_path), "*.txt").rdd.getNumPartitions() <= 8
    assert files.list_files(spark, f"{tmp_path}/d*", "*.txt").count() == 402
    with pytest.raises(FileNotFoundError):
        files.list_files(spark, f"{tmp_path}/none")


def test_similarity_matrix_is_for_bounded_queries(spark, monkeypatch):
    monkeypatch.setattr(knn, "VECTOR_BYTES", 200)
    index = index_of(spark, np.eye(3).tolist())
    with pytest.raises(ValueError, match="at most"):
        knn.similarity(index.select(F.col("label").alias("qid"), "vec"), index)
    assert knn.topk(index.select(F.col("label").alias("qid"), "vec"), index, 1).count() == 3


def test_similarity_matrix_of_many_queries_is_no_join(spark, monkeypatch):
    """The rows of a join, by blocks: also where a vector, or a number in one, is missing, and with rounding."""
    rng = np.random.default_rng(3)
    vecs = [*rng.normal(size=(9, 4)).tolist(), None, [1.0, None, 0.0, 0.0], [0.5, 0.0, 0.0, 0.0], [-0.015625] * 4]
    index = spark.createDataFrame([(i, i % 2, i, v) for i, v in enumerate(vecs)], "label long, grp int, pos long, vec array<double>")
    asked = index.select(F.col("label").cast("string").alias("qid"), "vec")
    codes = I.quantized(index.filter("label < 9"), Q.QuantSpec.from_width("qint4", -2.0, 2.0))
    for groups in (None, [1]):
        for digits in (None, 3):
            for rows, spec in ((index, Q.FLOAT), (codes, Q.QuantSpec.from_width("qint4", -2.0, 2.0))):
                got = []
                for most in (64, 2):
                    monkeypatch.setattr(knn, "SQL_QUERIES", most)
                    df = knn.similarity(asked, rows, groups, spec, digits)
                    got.append({(r.qid, r.label, r.pos): r.sim for r in df.collect()})
                assert got[0].keys() == got[1].keys() and len(got[0]) > 0
                assert all(b is None if a is None else a == pytest.approx(b, abs=1e-12) for a, b in ((got[0][k], got[1][k]) for k in got[0]))
                plan = df._jdf.queryExecution().executedPlan().toString()
                assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_parts_are_brought_together_in_their_tasks(spark):
    """A long text's parts leave their task as one vector, without a shuffle, whatever batches they come in; keys given twice are brought together after."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["ab", "c", "def", "g h", "ij"], n)) for n in (1, 400, 3, 90, 7)] + ["", None, "..."]
    e = embed.HashEmbedder(16)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for keys in (range(8), [0, 1, 1, 2, 0, None, None, 5]):
            df = spark.createDataFrame(list(zip(keys, texts)), "k int, t string").coalesce(2)
            parts = df.select("k", F.explode_outer(X.slices(F.coalesce("t", F.lit("")), 10)).alias("p")).select("k", e.column("p").alias("vec"))
            want = {r.k: r.vec for r in A.signed_square_mean(parts, ["k"]).collect()}
            out = embed.embed_long(df, "k", "t", e, 10)
            got = {r.k: r.vec for r in out.collect()}
            assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
            assert ("Exchange" in out._jdf.queryExecution().executedPlan().toString()) == (None in keys)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_labels_given_once_are_added_without_gathering_texts(spark):
    """Rows as the general way gives them: places by ord, a later add overwrites, a label given twice or without an ord goes the general way."""
    rows = [(7, "a b", "x", 3), (2, None, None, 1), (5, "", "y", 9), (1, "c d e", "x", 2)]
    make = lambda r: spark.createDataFrame(r, "label long, text string, grp string, ord long")
    one = db.TextDB.create(spark, label="long").add(make(rows))
    general = db.replace(db.TextDB.create(spark, label="long"), empty=False).add(make(rows))
    got = [tuple(r) for r in one.rows.orderBy("pos").collect()]
    assert got == [tuple(r) for r in general.rows.orderBy("pos").collect()] and [r[0] for r in got] == [2, 1, 7, 5]
    assert one.rows.dtypes == general.rows.dtypes
    assert "max_by" not in one.rows._jdf.queryExecution().executedPlan().toString()
    twice = one.add(make([(2, "new", "z", 0), (9, "f", "z", 1)]))
    assert [(r.label, r.pos, r.text) for r in twice.rows.orderBy("pos").collect()] == [(2, 0, "new"), (1, 1, "c d e"), (7, 2, "a b"), (5, 3, ""), (9, 4, "f")]
    for odd in (rows + [(7, "last", "x", 10)], rows + [(8, "t", "x", None)], rows + [(None, "t", "x", 4)]):
        db_ = db.TextDB.create(spark, label="long").add(make(odd))
        want = db.replace(db.TextDB.create(spark, label="long"), empty=False).add(make(odd))
        assert sorted(map(str, db_.rows.collect())) == sorted(map(str, want.rows.collect()))
    merged = db.TextDB.merge([db.TextDB.create(spark, label="long"), one])
    assert not merged.empty and merged.clear().empty and merged.add(make([(7, "n", "x", 0)])).count() == 4


def test_documents_given_once_are_chunked_where_they_are_read(spark):
    docs = [(3, "one two\nthree\n\nfour", 0), (1, "five", 0), (2, None, 0), (4, "\n", 0), (5, "one\nsix six", 0)]
    make = lambda r: spark.createDataFrame(r, "doc long, text string, ord int")
    one = db.DocumentDB.create(spark, doc="long").add(make(docs))
    general = db.replace(db.DocumentDB.create(spark, doc="long"), empty=False).add(make(docs + [(1, "old", -1)]))
    by = lambda df, *k: [tuple(r) for r in df.orderBy(*k).collect()]
    assert by(one.chunks, "doc", "chunk_no") == by(general.chunks, "doc", "chunk_no") and len(by(one.chunks, "doc")) == 6
    parts = one.chunks.select("doc", one.embedder.column("text").alias("vec"))
    want = dict(by(A.centroids(parts, ["doc"]), "doc"))
    for some in (one, general):
        got = dict(by(some.docs, "doc"))
        assert got.keys() == want.keys() == {1, 3, 5} and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    for df in (one.chunks, one.docs):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "max_by" not in plan
    again = one.add(make([(1, "seven\neight", 0)]))
    assert again.chunks.filter("doc = 1").count() == 2 and again.docs.count() == 3 and not one.remove([1]).empty
    other = db.replace(one, embedder=type("Plain", (), {"name": "hash-64", "dims": 64, "column": staticmethod(one.embedder.column)})())
    assert dict(by(other.clear().add(make(docs)).docs, "doc")).keys() == want.keys()


def test_changed_stream(spark, tmp_path):
    """A name's row comes when it is new or newer than in all batches before, within a run and after a restart."""
    from vecloom.streaming import upserts

    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
        seen = []
        for i, rows in enumerate([[("a", at(1)), ("b", at(5)), ("a", at(3))], [("a", at(2)), ("b", at(6)), ("c", at(1))]]):
            spark.createDataFrame(rows, "name string, mtime timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
            changed = upserts.changed_stream(upserts.read_stream(spark, f"{tmp_path}/in/*", "name string, mtime timestamp"))
            q = changed.writeStream.foreachBatch(lambda b, _: seen.append(sorted((r.name, r.mtime.second) for r in b.collect()))).outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
            q.awaitTermination()
        assert [x for x in seen if x] == [[("a", 3), ("b", 5)], [("b", 6), ("c", 1)]]
    finally:
        spark.conf.unset(key)
