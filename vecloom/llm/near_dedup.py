"""MinHash near-duplicate detection with tensored banding.

Two small collections of half keys, each the hash of ``rows`` minhash values, give ``halves`` x ``halves`` tables: a table's key pairs half
key i of the left collection with half key j of the right one. So 2 * halves * rows minhash values do the work of 2 * rows * halves**2.
Two sets of similarity s share a table with probability (1 - (1 - s**rows)**halves)**2; at s = 0.8 the defaults miss 2 in 100,000.

Candidates are confirmed on full sets of 64-bit shingle hashes. Texts whose sets have equal sizes and equal 128-bit sums of hashes are one vertex. In each
table bucket every member is compared with the bucket's smallest member; then members that still lie in different components are compared with each other, so that no candidate link
that could join two components is left out, and no pair within a component is expanded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._cluster import components, discard, join_groups, materialize, maybe_broadcast, one_row, seen, ship

ROWS, HALVES = 3, 16
_U = np.uint64
_rng = np.random.default_rng(4_2024)
_SCHEMA = "doc_id long, n_shingles long, k1 long, k2 long, keys array<long>"


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct 2-word shingle hashes, bounds by document): words lower-cased in A-Z; a single word is its own shingle."""
    start, end, first = T.words(data, offsets)
    h = T.Prefix(data, fold=True).of(start, end)
    n = np.diff(first)
    pair = T.mix(h[:-1] * _U(0x9E3779B97F4A7C15) + (h[1:] ^ _U(0x5851F42D4C957F2D)) * _U(0xBF58476D1CE4E5B9)) if len(h) > 1 else np.zeros(0, _U)
    out, sizes = [], np.zeros(len(n), np.int64)
    for i in range(len(n)):
        if n[i] > 1:
            a = np.sort(pair[first[i] : first[i + 1] - 1])
            if len(a) > 1:
                keep = np.empty(len(a), bool)
                keep[0] = True
                np.not_equal(a[1:], a[:-1], out=keep[1:])
                a = a[keep]
            out.append(a)
            sizes[i] = len(a)
        elif n[i] == 1:
            out.append(T.mix(h[first[i] : first[i] + 1] + _U(0x1234567)))
            sizes[i] = 1
    bounds = np.zeros(len(n) + 1, np.int64)
    np.cumsum(sizes, out=bounds[1:])
    return (np.concatenate(out) if out else np.zeros(0, _U)), bounds


def signatures(sets: np.ndarray, bounds: np.ndarray, rows: int, halves: int) -> np.ndarray:
    """Half keys [documents, 2 * halves]; rows of empty sets are 0."""
    rng = np.random.default_rng(77)
    full = np.flatnonzero(np.diff(bounds))
    keys = np.zeros((len(bounds) - 1, 2 * halves), _U)
    if not len(full):
        return keys
    at = bounds[:-1][full]
    v = np.empty_like(sets)
    for t in range(2 * halves):
        key = np.full(len(full), t + 1, _U)
        for _ in range(rows):
            flip, by = rng.integers(0, 1 << 63, 2, dtype=np.uint64)
            np.bitwise_xor(sets, flip, out=v)
            np.multiply(v, by * _U(2) + _U(1), out=v)
            key = T.mix(key * _U(0xC2B2AE3D27D4EB4F) + np.minimum.reduceat(v, at))
        keys[full, t] = key
    return keys


def _sign(rows: int, halves: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.blocks(batches):
            data, offsets = T.buffers(b.column("text"))
            sets, bounds = shingle_sets(data, offsets)
            n = np.diff(bounds)
            keys = signatures(sets, bounds, rows, halves)
            total = np.zeros((2, len(sets) + 1), _U)
            np.cumsum(T.mix(sets), out=total[0, 1:])
            np.cumsum(T.mix(sets ^ _U(0xA5A5A5A5A5A5A5A5)), out=total[1, 1:])
            k1, k2 = total[:, bounds[1:]] - total[:, bounds[:-1]]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * (2 * halves)), pa.array(T.signed(keys.ravel())))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(T.signed(k1)), pa.array(T.signed(k2)), lists], ["doc_id", "n_shingles", "k1", "k2", "keys"])

    return run


def _common(sets: list[np.ndarray], others: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each run of ``others`` within ``bounds`` the most hashes that it shares with one of ``sets``; all are sorted and distinct."""
    best = np.zeros(len(bounds) - 1, np.int64)
    for s in sets:
        at = np.searchsorted(s, others)
        at[at == len(s)] = 0
        best = np.maximum(best, T.sums(s[at] == others, bounds))
    return best


def _compare(percent: int):
    """(a, b) links of the cells' rows (cell, half, id, partners, text), which come sorted by cell: a is compared with its partners in the cell."""

    def links(texts: dict[int, list[np.ndarray]], partners: dict[int, list[int]]) -> Iterator[tuple[int, int]]:
        for a, bs in partners.items():
            own = texts.get(a, [])
            bs = [(b, s) for b in bs for s in texts.get(b, [])]
            if not own or not bs:
                continue
            size = np.array([len(s) for _, s in bs], np.int64)
            bounds = np.r_[0, np.cumsum(size)]
            for s in own:
                shared = _common([s], np.concatenate([x for _, x in bs]), bounds)
                for k in np.flatnonzero(100 * shared >= percent * (len(s) + size - shared)).tolist():
                    yield a, bs[k][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, texts, partners = None, {}, {}
        for b in T.blocks(batches):
            sets, bounds = shingle_sets(*T.buffers(b.column("text")))
            found: list[tuple[int, int]] = []
            for i, (c, v, p) in enumerate(zip(b.column("cell").to_pylist(), b.column("id").to_pylist(), b.column("partners").to_pylist())):
                if c != cell:
                    found += links(texts, partners)
                    cell, texts, partners = c, {}, {}
                if bounds[i + 1] > bounds[i]:
                    texts.setdefault(v, []).append(sets[bounds[i] : bounds[i + 1]].copy())
                if p:
                    partners[v] = p
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])
        found = list(links(texts, partners))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _verify(pairs: DataFrame, docs: DataFrame, homes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    ``homes(id, home)`` puts each vertex in one of many small groups, near copies in the same ones where they fit. A pair is compared in the cell of its two
    homes, so a text is sent once for each cell in which it has partners, however many these are, and a cell holds two groups' texts at most.
    """
    placed = pairs.join(homes.selectExpr("id as a", "home as ha"), "a").join(homes.selectExpr("id as b", "home as hb"), "b")
    placed = placed.select("a", "b", F.xxhash64(F.least("ha", "hb"), F.greatest("ha", "hb")).alias("cell"))
    asks = placed.select(F.col("a").alias("id"), "cell", F.col("b").alias("p")).unionByName(placed.select(F.col("b").alias("id"), "cell", F.lit(None).cast("long").alias("p")))
    # a list has the partners in one cell, so it is as long as a group at most
    asks = materialize(asks.groupBy("id", "cell").agg(F.collect_set("p").alias("partners")), "asks")
    sent = docs.join(maybe_broadcast(asks.withColumnRenamed("id", "doc_id"), seen(asks)), "doc_id")
    sent = sent.select("cell", F.col("doc_id").alias("id"), "partners", "text").repartition("cell").sortWithinPartitions("cell")
    out = materialize(sent.mapInArrow(_compare(percent), "a long, b long").distinct(), "links")
    discard(asks)
    return out


#: Shingles in a group of texts that are compared in one place, about; and members of a table bucket that meet in one task.
GROUP_SHINGLES, BUCKET_BLOCK = 400_000, 500


def near_duplicates(docs: DataFrame, percent: int = 80, rows: int = ROWS, halves: int = HALVES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs(doc_id, text)``.

    Null or blank texts have an empty set and link with nothing. Rows with the same doc_id are one vertex, which has the links of all its texts. A row
    without doc_id is not linked: its component_id is null and it is kept. An empty table gives no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialize(docs.mapInArrow(_sign(rows, halves), _SCHEMA), "signed")
    named = signed.filter("doc_id is not null and n_shingles > 0")
    groups = materialize(named.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("keys").alias("keys")), "groups")
    total = seen(groups)

    # a half key that one vertex has alone can't be part of a shared table key
    halves_of = groups.select("rep", F.posexplode("keys").alias("pos", "key")).select("rep", "key", (F.col("pos") < halves).alias("left_side"))
    common = materialize(halves_of.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1"), "common")
    sided = join_groups(halves_of, common, ["key"], "members", total * halves, "rep")
    tables = (
        sided.groupBy("rep")
        .agg(F.collect_set(F.when(F.col("left_side"), F.col("key"))).alias("l"), F.collect_set(F.when(~F.col("left_side"), F.col("key"))).alias("r"))
        .filter(F.size("l") * F.size("r") > 0)
        .select("rep", F.explode("l").alias("lk"), "r")
        .select("rep", "lk", F.explode("r").alias("rk"))
        .select("rep", F.xxhash64("lk", "rk").alias("table_key"))
    )
    tables = materialize(tables, "tables")
    hubs = materialize(tables.groupBy("table_key").agg(F.min("rep").alias("hub"), F.count("*").alias("members")).filter("members > 1"), "hubs")
    bucket = materialize(join_groups(tables, hubs, ["table_key"], "members", max(1, total), "rep"), "buckets")
    discard(common, tables, hubs)
    size_of = groups.groupBy("rep").agg(F.min("n_shingles").alias("lo"), F.max("n_shingles").alias("hi"))
    fits = f"100 * least(ha, hb) >= {percent} * greatest(la, lb)"
    met = materialize(bucket.select("hub", "rep").distinct(), "met")  # every vertex of a bucket with its hub, the hub itself too
    # a vertex's home: the smallest hub that it meets, cut into parts of about GROUP_SHINGLES
    vertex = met.groupBy(F.col("rep").alias("id")).agg(F.min("hub").alias("family")).join(size_of.withColumnRenamed("rep", "id"), "id")
    vertex = materialize(vertex, "vertices")
    n_vertices = seen(vertex)
    weights = vertex.groupBy("family").agg(F.ceil(F.sum("hi") / GROUP_SHINGLES).alias("parts"))
    weights = materialize(weights, "families")
    homes = vertex.join(maybe_broadcast(weights), "family").select("id", F.xxhash64("family", F.pmod(F.xxhash64("id"), "parts")).alias("home"), "lo", "hi")
    homes = materialize(homes, "homes")
    discard(vertex, weights)
    found = maybe_broadcast(homes, n_vertices)

    def sized(pairs: DataFrame) -> DataFrame:
        return pairs.join(found.selectExpr("id as b", "lo as lb", "hi as hb"), "b").join(found.selectExpr("id as a", "lo as la", "hi as ha"), "a").filter(fits).select("a", "b")

    star = materialize(sized(met.filter("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b"))), "star")
    links = _verify(star, docs, found, percent)
    same = _same_id(named, groups)
    if same is not None:
        links = materialize(links.unionByName(same), "links")
    comps = components(links)

    # buckets whose members are still in several components: compare across these, a hot bucket in blocks of its members
    where = bucket.join(maybe_broadcast(comps.withColumnRenamed("id", "rep"), seen(comps)), "rep", "left").select("table_key", "rep", "members", F.coalesce("comp", "rep").alias("comp"))
    split = where.groupBy("table_key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("table_key")
    split = materialize(split, "split")
    if seen(split):
        blocks = F.ceil(F.col("members") / BUCKET_BLOCK)
        mixed = materialize(where.join(maybe_broadcast(split), "table_key", "left_semi").select("table_key", "rep", "comp", blocks.alias("blocks")), "mixed")
        one = mixed.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))).alias("x")
        other = mixed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).alias("y")
        across = one.join(other, F.expr("x.table_key = y.table_key and x.block = y.block and x.comp < y.comp")).select(F.expr("least(x.rep, y.rep) a"), F.expr("greatest(x.rep, y.rep) b")).distinct()
        rest = materialize(sized(across).join(star, ["a", "b"], "left_anti"), "across")
        if seen(rest):
            more = _verify(rest, docs, found, percent)
            discard(comps)
            comps = components(links.unionByName(more))
            discard(more)
        discard(mixed, rest)
    discard(met, star, links, split, bucket, homes)

    final = groups.select("k1", "k2", "n_shingles", "rep", "copies").join(maybe_broadcast(comps.withColumnRenamed("id", "rep"), seen(comps)), "rep", "left").select("k1", "k2", "n_shingles", "copies", F.coalesce("comp", "rep").alias("comp"))
    n_docs = seen(signed)
    out = join_groups(signed.drop("keys"), final, ["k1", "k2", "n_shingles"], "copies", n_docs, "doc_id", "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("comp", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _same_id(named: DataFrame, groups: DataFrame) -> DataFrame | None:
    """Links (a, b) between the vertices of different texts that share a doc_id, or None where there are no such texts."""
    text = F.struct("k1", "k2", "n_shingles")
    twice = materialize(named.groupBy("doc_id").agg(F.min(text).alias("lo"), F.max(text).alias("hi")).filter("lo <> hi").select("doc_id"), "twice")
    if not seen(twice):
        return None
    rows = named.join(maybe_broadcast(twice), "doc_id", "left_semi").select("doc_id", "k1", "k2", "n_shingles")
    reps = rows.join(groups.select("k1", "k2", "n_shingles", "rep"), ["k1", "k2", "n_shingles"]).select("doc_id", "rep")
    # the least of a doc_id's vertices is linked with each
    return reps.join(reps.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").filter("rep <> a").select("a", F.col("rep").alias("b")).distinct()


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that are not their component's smallest; columns as given.

    Rows without doc_id stay; of rows that repeat a doc_id one stays, that with the least text, null first. An empty table stays empty.
    """
    verdict = near_duplicates(docs, percent)
    lost = materialize(verdict.filter("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("not kept").select("doc_id"), "lost")
    stay = docs.join(maybe_broadcast(lost), "doc_id", "left_anti")
    again = materialize(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    n = seen(again)
    if not n:
        return stay.select(docs.columns)
    again = maybe_broadcast(again, n)
    one = one_row(stay.join(again, "doc_id", "left_semi").select(docs.columns), "doc_id", [F.col("text")])
    return stay.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(one.select(docs.columns))
