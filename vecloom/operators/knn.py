"""Exact and approximate nearest neighbours by inner product.

The ``sql`` engine is one join and one ranked window, in which every pair is a row; it is for SQL_QUERIES queries, and more of them take the other engine.
The ``arrow`` engine writes the queries to the shared folder; each task then multiplies
its rows of the index with them block by block, keeps a running top k for every query, and a window merges these. No side has to fit into
memory or a broadcast, and no pair is ever a row.

Results are (qid, rank, label, sim): higher similarity first, compared at nine decimals, then smaller position.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quant as Q
from ..functions.vec import dot, doubles
from ..plans.shared import ship, small, written

#: Bytes of vectors that a broadcast may hold.
VECTOR_BYTES = 128 << 20
#: Queries that the ``sql`` engine takes at most: its pairs then grow with the index alone.
SQL_QUERIES = 64
#: Bytes of the index's rows that a task holds at once; queries multiplied at once; similarities held at once; bytes of running results that a task keeps.
INDEX_BYTES, QUERY_ROWS, PAIRS, KEPT_BYTES = 32 << 20, 1_024, 1 << 20, 64 << 20


def few_vectors(df: DataFrame, vec: str = "vec") -> DataFrame:
    """With a broadcast hint if the rows' vectors take at most VECTOR_BYTES; else as it is."""
    first = df.select(F.size(vec).alias("n")).first()
    return small(df, VECTOR_BYTES // (8 * max(1, first["n"] or 1) + 64)) if first else df


def prefilter(index: DataFrame, groups: list | None, strict: bool = True) -> DataFrame:
    """Rows of ``groups`` (all for None); with ``strict`` an unknown group raises, by one look at the groups that exist."""
    if groups is None:
        return index
    kept = index.filter(F.col("grp").isin(list(groups)))
    if strict:
        asked = index.sparkSession.createDataFrame([(g,) for g in groups], f"grp {dict(index.dtypes)['grp']}")
        unknown = asked.join(kept.select("grp").distinct(), "grp", "left_anti").first()
        if unknown is not None:
            raise ValueError(f"unknown group: {unknown['grp']}")
    return kept


def _pairs(path: str, spec: Q.QuantSpec, digits: int | None):
    """Every query at ``path`` with every row of the task; at most PAIRS / 4 pairs are held at once."""

    def vectors(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray | None]:
        """A matrix, and which rows lack a whole vector of ``dims`` numbers, if any does."""
        flat, sizes = column.flatten(), pc.list_value_length(column)
        if not column.null_count and not flat.null_count and (not len(column) or pc.min_max(sizes).as_py() == {"min": dims, "max": dims}):
            return _matrix(column, len(column)), None
        rows = column.to_pylist()
        lacks = np.array([v is None or len(v) != dims or None in v for v in rows])
        return np.array([[0.0] * dims if no else v for v, no in zip(rows, lacks)], np.float64), lacks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, where = fs.FileSystem.from_uri(path)
        asked = ds.dataset(where, filesystem=system, format="parquet").to_table(columns=["qid", "vec"]).combine_chunks()
        qids, dims = asked.column("qid").chunk(0), max(pc.max(pc.list_value_length(asked.column("vec"))).as_py() or 1, 1)
        q, unasked = vectors(asked.column("vec").chunk(0), dims)
        del asked
        most = max(1, PAIRS // 4)
        for b in batches:
            x, lacks = vectors(b.column("vec"), dims // (8 // spec.bits) if spec.quantized else dims)
            if spec.quantized:
                x = Q.np_dequantize(x.astype(np.uint8), spec)
            for first in range(0, len(q), most):
                part, ids = q[first : first + most], qids.slice(first, most)
                step = max(1, most // len(part))
                for lo in range(0, len(x), step):
                    sims = x[lo : lo + step] @ part.T
                    if digits is not None:  # half away from zero, as SQL rounds
                        sims = np.copysign(np.floor(np.abs(sims) * 10.0**digits + 0.5) / 10.0**digits, sims) + 0.0
                    missing = None
                    if lacks is not None or unasked is not None:
                        missing = np.zeros(sims.shape, bool)
                        if lacks is not None:
                            missing |= lacks[lo : lo + step, None]
                        if unasked is not None:
                            missing |= unasked[None, first : first + most]
                    at = pa.array(np.repeat(np.arange(lo, lo + len(sims)), len(part)))
                    columns = [pa.concat_arrays([ids] * len(sims)), b.column("label").take(at), b.column("pos").take(at), pa.array(sims.ravel(), mask=None if missing is None else missing.ravel())]
                    yield pa.RecordBatch.from_arrays(columns, ["qid", "label", "pos", "sim"])

    return run


def similarity(queries: DataFrame, index: DataFrame, groups: list | None = None, spec: Q.QuantSpec = Q.FLOAT, digits: int | None = None) -> DataFrame:
    """(qid, label, pos, sim) of every query with every row: the similarity matrix in long form, for queries that fit in VECTOR_BYTES; others raise.

    SQL_QUERIES are joined by SQL; of more, the rows of the index are dealt out evenly and multiplied with the queries block by block. ``digits`` rounds.
    """
    q = queries.select("qid", doubles("vec").alias("qvec"))
    first = q.select(F.size("qvec").alias("n")).first()
    most = VECTOR_BYTES // (8 * max(1, first["n"] or 1) + 64) if first else 1
    n = q.limit(most + 1).count()
    if n > most:
        raise ValueError(f"a similarity matrix is for {most} queries at most; topk takes any number")
    if n <= SQL_QUERIES:
        score = Q.quantized_dot("vec", "qvec", spec)
        return prefilter(index, groups).crossJoin(F.broadcast(q)).select("qid", "label", "pos", (score if digits is None else F.round(score, digits)).alias("sim"))
    spark = queries.sparkSession
    ship(spark)
    _, path = written(q.select("qid", F.col("qvec").alias("vec")), "queries")
    rows = prefilter(index, groups).select("label", F.col("pos").cast("long").alias("pos"), F.col("vec").cast("array<int>" if spec.quantized else "array<double>").alias("vec"))
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.mapInArrow(_pairs(path, spec, digits), f"qid {dict(q.dtypes)['qid']}, label {dict(index.dtypes)['label']}, pos long, sim double")


def ranked(scored: DataFrame, k: int, cutoff: float | None = None, by: str = "qid") -> DataFrame:
    """The k best rows for each ``by``, then those strictly above ``cutoff``."""
    order = Window.partitionBy(by).orderBy(F.round("sim", 9).desc(), F.col("pos"))
    out = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return out if cutoff is None else out.filter(F.col("sim") > cutoff)


Marks = Callable[[dict, dict], np.ndarray]
Adds = Callable[[np.ndarray], dict[str, np.ndarray]]


def _best(row: np.ndarray, rounded: np.ndarray, pos: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row, by higher similarity, then smaller position; in order of rows."""
    order = np.lexsort((pos, -rounded, row))
    ordered = row[order]
    return order[np.arange(len(order)) - np.searchsorted(ordered, ordered) < k]


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1)


def _chunked(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Batches put together up to about ``most`` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _partial(path: str, k: int, spec: Q.QuantSpec, sides: dict[int, Marks | None], extra: list[str], digits: int, window: int | None, adds: tuple[Adds, Adds] | None = None):
    """The task's top k for every query and side; a side's function marks the pairs that count, from the columns of queries and rows.

    ``adds`` make further columns of the vectors of queries and of rows. At most PAIRS similarities are held at once; beyond a query's first rows only
    those that reach its k-th best so far are looked at.
    """

    def out(qids: pa.Array, side: int, row: np.ndarray, labels: pa.Array, pos: np.ndarray, sims: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([qids.take(pa.array(row)), pa.array(np.full(len(row), side, np.int32)), labels, pa.array(pos), pa.array(sims)], ["qid", "side", "label", "pos", "sim"])

    def least(row: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
        """The k-th best score of each query, in order of rows and scores, or -inf where it has fewer."""
        found = np.full(n, -np.inf)
        last = np.searchsorted(row, np.arange(n), "right") - 1
        full = np.bincount(row, minlength=n) >= k
        found[full] = score[last[full]]
        return found

    def better(q: np.ndarray, theirs: dict, mine: dict, marks: Marks | None, old: tuple | None) -> tuple:
        """(query, score, sim, pos, place) of the best of ``old`` and the chunk's rows; places of the chunk's rows follow those of ``old``."""
        n, pos = len(mine["pos"]), mine["pos"]
        if old is None:
            row, score, sim, place, at = np.zeros(0, np.int64), np.zeros(0), np.zeros(0), pos[:0], np.zeros(0, np.int64)
        else:
            row, score, _, place, sim = old
            at = np.arange(len(row))
        first, floor = len(row), least(row, score, len(q))
        step = max(1, PAIRS // len(q))
        for lo in range(0, n, step):
            part = {c: v[lo : lo + step] for c, v in mine.items()}
            if window is not None and (part["day"].min() >= theirs["day"].max() + window or part["day"].max() <= theirs["day"].min() - window):
                continue
            sims = q @ part["vec"].T
            some = sims >= (floor - 2 * 10.0**-digits)[:, None]
            if marks is not None and some.any():
                some &= marks(theirs, part)
            if k < sims.shape[1] and np.count_nonzero(some) > 4 * k * len(q):
                # all rows as good as the k-th, at most; ties are settled by position below
                scores = np.where(some, np.round(sims, digits), -np.inf)
                some &= scores >= np.partition(scores, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k][:, None]
            r, c = np.nonzero(some)
            if not len(r):
                continue
            exact = sims[r, c]
            rounded = np.round(exact, digits)
            ok = rounded > -np.inf
            row, score, place, at = (np.concatenate(x) for x in ((row, r[ok]), (score, rounded[ok]), (place, part["pos"][c[ok]]), (at, first + lo + c[ok])))
            sim = np.concatenate([sim, (rounded if digits > 9 else exact)[ok]])
            best = _best(row, score, place, k)
            row, score, sim, place, at = row[best], score[best], sim[best], place[best], at[best]
            floor = least(row, score, len(q))
        return row, score, sim, place, at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, where = fs.FileSystem.from_uri(path)
        queries = ds.dataset(where, filesystem=system, format="parquet")
        kept: dict[tuple, tuple] = {}
        size = 0
        for t in _chunked(batches, INDEX_BYTES):
            if not t.num_rows:
                continue
            x = _matrix(t.column("vec").chunk(0), t.num_rows)
            if spec.quantized:
                x = Q.np_dequantize(x.astype(np.uint8), spec)
            labels = t.column("label").chunk(0)
            mine = {c: t.column(c).to_numpy() for c in [*extra, "pos"]} | {"vec": x, "id": labels} | (adds[1](x) if adds else {})
            near = None if window is None else (ds.field("day") > int(mine["day"].min()) - window) & (ds.field("day") < int(mine["day"].max()) + window)
            for fragment in queries.get_fragments() if near is None else (part for whole in queries.get_fragments() for part in whole.split_by_row_group(near)):
                group = () if near is None else tuple(r.id for r in fragment.row_groups)
                for number, b in enumerate(fragment.to_batches(batch_size=QUERY_ROWS, columns=["qid", "vec", *extra], batch_readahead=0)):
                    if not b.num_rows:
                        continue
                    q = _matrix(b.column("vec"), b.num_rows)
                    qids = b.column("qid")
                    theirs = {c: b.column(c).to_numpy(zero_copy_only=False) for c in extra} | {"vec": q, "id": qids} | (adds[0](q) if adds else {})
                    for side, marks in sides.items():
                        key = (fragment.path, group, number, side)
                        old = kept.pop(key, (None, None))[1]
                        row, score, sim, place, at = better(q, theirs, mine, marks, old)
                        before = 0 if old is None else len(old[0])
                        size -= 32 * before
                        fresh = at >= before
                        label = labels.take(pa.array(at[fresh] - before))
                        if old is not None:
                            index = at.copy()
                            index[fresh] = before + np.arange(len(label))
                            label = pa.concat_arrays([old[2], label]).take(pa.array(index))
                        if size + 32 * len(row) <= KEPT_BYTES:
                            kept[key] = (qids, (row, score, label, place, sim))
                            size += 32 * len(row)
                        elif len(row):  # more queries than a task keeps results for: these go out now
                            yield out(qids, side, row, label, place, sim)
        for (*_, side), (qids, (row, _, label, place, sim)) in kept.items():
            if len(row):
                yield out(qids, side, row, label, place, sim)

    return run


def _scored(queries: DataFrame, index: DataFrame, k: int, spec: Q.QuantSpec = Q.FLOAT, sides: dict[int, Marks | None] | None = None, extra: list[str] = [], digits: int = 9, window: int | None = None, adds: tuple[Adds, Adds] | None = None) -> DataFrame:
    """(qid, side, label, pos, sim): each task's best, for ``sides`` that mark the pairs that count from columns ``extra`` of both tables.

    With ``window`` a chunk of the index meets only the query files whose ``day`` lies nearer than that to one of its own.
    """
    ship(queries.sparkSession)
    _, path = written(queries.select("qid", F.col("vec").cast("array<double>").alias("vec"), *extra), "queries")
    rows = index.select("label", "pos", F.col("vec").cast("array<int>" if spec.quantized else "array<double>").alias("vec"), *extra)
    kinds = dict(queries.dtypes) | {"label": dict(index.dtypes)["label"]}
    return rows.mapInArrow(_partial(path, k, spec, sides or {0: None}, extra, digits, window, adds), f"qid {kinds['qid']}, side int, label {kinds['label']}, pos long, sim double")


def topk(queries: DataFrame, index: DataFrame, k: int = 10, groups: list | None = None, cutoff: float | None = None, engine: str = "arrow", spec: Q.QuantSpec = Q.FLOAT) -> DataFrame:
    """(qid, rank, label, sim): for each of ``queries(qid, vec)`` the k most similar rows of ``index(label, grp, pos, vec)``.

    ``vec`` of the index holds packed codes if ``spec`` is quantised. Groups with fewer than k rows give what they have.
    """
    if engine == "sql" and queries.limit(SQL_QUERIES + 1).count() > SQL_QUERIES:
        engine = "arrow"
    if engine == "sql":
        scored = similarity(queries, index, groups, spec)
    elif engine == "arrow":
        scored = _scored(queries, prefilter(index, groups), k, spec)
    else:
        raise ValueError(f"unknown engine: {engine}")
    return ranked(scored, k, cutoff).select("qid", "rank", "label", "sim")


def top_single(vec: Column, index: DataFrame, k: int = 10) -> DataFrame:
    """(label, sim) of the k rows most similar to one vector, in order: a bounded sort in each partition and on the driver."""
    return index.select("label", "pos", dot(vec, "vec").alias("sim")).orderBy(F.round("sim", 9).desc(), "pos").limit(k).select("label", "sim")


def pair_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Inner product of the rows of (id, vec) that share an id."""
    return a.select("id", F.col("vec").alias("va")).join(b.select("id", F.col("vec").alias("vb")), "id").select("id", dot("va", "vb").alias("sim"))


def lsh_topk(queries: DataFrame, index: DataFrame, k: int = 10, width: float = 2.0, tables: int = 32, seed: int = 1, planes: int = 4) -> DataFrame:
    """Approximate top k: rows that share a bucket with the query in any table of ``planes`` random projections, compared exactly.

    Buckets are looked up block by block in the tasks of the exact search, so a pair that meets in several tables is compared once and is never a row.
    """
    first = index.select("vec").first()
    dims = len(first["vec"]) if first else 1
    rng = np.random.default_rng(seed)
    drawn, odd = rng.normal(size=(tables, planes, dims)), rng.integers(1 << 62, size=planes) * 2 + 1

    def buckets(vec: np.ndarray) -> dict[str, np.ndarray]:
        return {"bucket": np.stack([np.floor(vec @ p.T / width).astype(np.int64) @ odd for p in drawn], axis=1)}

    def near(theirs: dict, mine: dict) -> np.ndarray:
        marked = np.zeros((len(theirs["vec"]), len(mine["vec"])), bool)
        for asked, key in zip(theirs["bucket"].T, mine["bucket"].T):
            order = np.argsort(key, kind="stable")
            lo, hi = np.searchsorted(key[order], asked), np.searchsorted(key[order], asked, "right")
            row = np.repeat(np.arange(len(asked)), hi - lo)
            at = np.arange(len(row)) - np.repeat(np.cumsum(hi - lo) - hi, hi - lo)
            marked[row, order[at]] = True
        return marked

    return ranked(_scored(queries, index, k, sides={0: near}, adds=(buckets, buckets)), k).select("qid", "rank", "label", "sim")


def ivf_topk(queries: DataFrame, index: DataFrame, k: int = 10, cells: int = 16, nprobe: int = 12, sample: int = 100_000, seed: int = 1) -> DataFrame:
    """Approximate top k in the ``nprobe`` cells nearest to the query; the cells are fitted on at most about ``sample`` rows, all rows are assigned.

    Rows are assigned and compared in the tasks of the exact search, so no pair is a row.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = index.withColumn("features", array_to_vector(doubles("vec")))
    share = min(1.0, sample / max(1, index.count()))
    fitted = KMeans(k=cells, seed=seed, featuresCol="features", predictionCol="cell").fit(rows if share == 1 else rows.sample(share, seed))
    centres = np.array(fitted.clusterCenters())

    def cell(vec: np.ndarray) -> dict[str, np.ndarray]:
        return {"cell": np.argmin((centres**2).sum(axis=1) - 2 * (vec @ centres.T), axis=1)}

    def probes(vec: np.ndarray) -> dict[str, np.ndarray]:
        asked = np.zeros((len(vec), len(centres)), bool)
        np.put_along_axis(asked, np.argsort(-np.round(vec @ centres.T, 9), axis=1, kind="stable")[:, :nprobe], True, axis=1)
        return {"asked": asked}

    def near(theirs: dict, mine: dict) -> np.ndarray:
        return theirs["asked"][:, mine["cell"]]

    return ranked(_scored(queries, index, k, sides={0: near}, adds=(probes, cell)), k).select("qid", "rank", "label", "sim")


def _window_partial(path: str, span: int, k: int, exclude_self: bool):
    """The k best similarities of the task's rows with the comparison rows at ``path``, for both sides of a row's day."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, where = fs.FileSystem.from_uri(path)
        others = ds.dataset(where, filesystem=system, format="parquet")
        room = 2 * k  # slots for what has come since a row's k best were last found
        for t in _chunked(batches, min(INDEX_BYTES, max(1, KEPT_BYTES // (2 * (k + room) * 8)) * 512)):
            n = t.num_rows
            if not n:
                continue
            mine, days, ids = _matrix(t.column("vec").chunk(0), n), t.column("day").to_numpy().astype(np.int64), t.column("qid").chunk(0)
            held = np.full((2, n, k + room), -np.inf)
            filled, floor = np.zeros((2, n), np.int64), np.full((2, n), -np.inf)

            def settle(side: int, at: np.ndarray) -> None:
                """The k best of these rows' slots come first, the others are free."""
                some = -np.partition(-held[side, at], k - 1, axis=1)
                some[:, k:] = -np.inf
                held[side, at], floor[side, at], filled[side, at] = some, some[:, k - 1], 0

            near = (ds.field("day") > int(days.min()) - span - 1) & (ds.field("day") < int(days.max()) + span + 1)
            for fragment in (part for whole in others.get_fragments() for part in whole.split_by_row_group(near)):
                for b in fragment.to_batches(batch_size=QUERY_ROWS, columns=["id", "vec", "day"], batch_readahead=0):
                    if not b.num_rows:
                        continue
                    x, theirs = _matrix(b.column("vec"), b.num_rows), b.column("day").to_numpy().astype(np.int64)
                    step = max(1, PAIRS // len(x))
                    for lo in range(0, n, step):
                        own = days[lo : lo + step]
                        least, most = theirs.min() - own.max(), theirs.max() - own.min()
                        if most <= -span or least > span:
                            continue
                        sims = mine[lo : lo + step] @ x.T
                        gap = None
                        for side, (above, upto) in enumerate(((-span, 0), (0, span))):  # above < gap <= upto
                            if most <= above or least > upto:
                                continue
                            some = sims > floor[side, lo : lo + step, None]
                            if least <= above or most > upto:
                                gap = theirs[None, :] - own[:, None] if gap is None else gap
                                some &= (gap > above) & (gap <= upto)
                            if exclude_self:
                                some &= np.asarray(ids[lo : lo + step])[:, None] != np.asarray(b.column("id"))[None, :]
                            count = some.sum(axis=1)
                            if not count.any():
                                continue
                            many = np.nonzero(count > room)[0]
                            if len(many):
                                best = -np.partition(-np.where(some[many], sims[many], -np.inf), k - 1, axis=1)[:, :k] if k < len(x) else np.where(some[many], sims[many], -np.inf)
                                settle(side, lo + many)
                                held[side, lo + many, k : k + best.shape[1]] = best
                                filled[side, lo + many] = best.shape[1]
                                some[many] = False
                                count[many] = 0
                            full = np.nonzero(filled[side, lo : lo + step] + count > room)[0]
                            if len(full):
                                settle(side, lo + full)
                            row, at = np.nonzero(some)
                            place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                            held[side, lo + row, k + filled[side, lo + row] + place] = sims[row, at]
                            filled[side, lo : lo + step] += count
            for side in (0, 1):
                settle(side, np.arange(n))
                for lo in range(0, n, QUERY_ROWS):
                    best = -np.sort(-held[side, lo : lo + QUERY_ROWS, :k], axis=1)
                    row, rank = np.nonzero(best > -np.inf)
                    if len(row):
                        columns = [ids.slice(lo, QUERY_ROWS).take(pa.array(row)), pa.array(np.full(len(row), side, np.int32)), pa.array((rank + 1).astype(np.int32)), pa.array(np.round(best[row, rank], 12))]
                        yield pa.RecordBatch.from_arrays(columns, ["qid", "side", "rank", "sim"])

    return run


def group_topk(asked: DataFrame, index: DataFrame, k: int, spec: Q.QuantSpec = Q.FLOAT) -> DataFrame:
    """(qid, side, label, pos, sim): each task's best of ``index(label, grp, pos, vec)`` for the queries that ask for a row's group, a row of ``asked(qid, grp, vec)`` each.

    The index is put in order of groups, so that a task meets only the row groups of queries that ask for its own; no pair is a row.
    """
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["grp", "qid"]
    # groups by a number, as row groups are looked up by ranges of one; the hash decides nothing else
    kind = dict(asked.select("grp").union(index.select("grp")).dtypes)["grp"]  # the one in which a join compares them
    asked, index = (x.withColumn("grp", F.col("grp").cast(kind)) for x in (asked, index))
    number = F.shiftright(F.xxhash64("grp"), 1).alias("day")
    q = asked.filter("grp is not null").select("qid", "vec", number, "grp").repartitionByRange(parts, "day", "qid").sortWithinPartitions("day", *order)
    rows = index.filter("grp is not null").select("label", "pos", "vec", number, "grp").repartitionByRange(parts, "day", "pos").sortWithinPartitions("day", "grp", "pos")

    def same(theirs: dict, mine: dict) -> np.ndarray:
        known = {g: i for i, g in enumerate(dict.fromkeys(mine["grp"].tolist()))}
        asks, has = (np.array([known.get(g, -1) for g in x["grp"].tolist()]) for x in (theirs, mine))
        return asks[:, None] == has[None, :]

    return _scored(q, rows, k, spec, sides={0: same}, extra=["day", "grp"], window=1)


def window_topk(focal: DataFrame, comparison: DataFrame, span: int, k: int, exclude_self: bool = False) -> DataFrame:
    """(qid, side, rank, sim): for each row of ``focal(label, day, vec)`` the k best of ``comparison(label, day, vec)`` dated in (day - span, day], side 0, and in (day, day + span], side 1.

    Both are put in order of days. A task keeps its focal rows' best and reads only the row groups of comparison rows that their windows reach, so its
    results are final: nothing of them is shuffled.
    """
    ship(focal.sparkSession)
    vec = F.col("vec").cast("array<double>").alias("vec")
    parts = int(focal.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = comparison.select(F.col("label").alias("id"), vec, "day").repartitionByRange(parts, "day", "id").sortWithinPartitions("day", "id")
    _, path = written(rows, "comparison")
    q = focal.select(F.col("label").alias("qid"), vec, "day").repartitionByRange(parts, "day", "qid").sortWithinPartitions("day", "qid")
    return q.mapInArrow(_window_partial(path, span, k, exclude_self), f"qid {dict(q.dtypes)['qid']}, side int, rank int, sim double")
