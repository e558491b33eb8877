"""Helpers that the operators share: written intermediate tables, code shipping, size-checked joins, components."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow table (a few numbers a row) may be broadcast; beyond it a shuffle join is planned.
BROADCAST_ROWS = 1_000_000
#: A join key is hot when it holds more than this share of all rows, so there are fewer than 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 2000

#: Bytes of an Arrow batch sent to Python: texts are handled in blocks of a quarter of a megabyte, so larger batches would only hold memory.
ARROW_BYTES = 4 << 20
_ARROW_SETTING, _ARROW_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"

_own_dir: str | None = None
_paths: list[str] = []
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; where that is unset one of our own, if all runs on this machine."""
    global _own_dir
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if _own_dir is None:
            _own_dir = tempfile.mkdtemp(prefix="vecloom-")
            atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
        root = f"file://{_own_dir}"
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/vecloom/{name}-{uuid.uuid4().hex[:12]}"
    _paths.append(path)
    return path


def materialize(df: DataFrame, name: str, **observed: Column) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and no executor's loss undoes it.

    Its number of rows, and the aggregates ``observed``, are taken as it is written: see :func:`seen`.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    seen_here = Observation()
    df.observe(seen_here, F.count(F.lit(1)).alias("_rows"), *[c.alias(k) for k, c in observed.items()]).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._vecloom_path, out._vecloom_seen = path, {"_rows": None} | dict.fromkeys(observed) | seen_here.get
    out._vecloom_asked = observed
    return out


def seen(df: DataFrame, what: str = "_rows") -> int:
    """What :func:`materialize` counted while it wrote ``df``; of other tables the rows are counted now."""
    found = getattr(df, "_vecloom_seen", {}).get(what)
    if found is None:  # not written here, or a plan that was found to be empty, or a sum of no rows
        return df.count() if what == "_rows" else int(df.agg(df._vecloom_asked[what]).first()[0] or 0)
    return int(found)


def discard(*dfs: DataFrame) -> None:
    """Delete tables written by :func:`materialize` that no later plan reads."""
    for df in dfs:
        path = getattr(df, "_vecloom_path", None)
        if path:
            delete(df.sparkSession, path)


def settle(df: DataFrame, name: str, before: DataFrame | None = None) -> DataFrame:
    """``df`` written as by :func:`materialize`, after which all that this process wrote to make it is deleted, and ``before``, a table of the step before."""
    out = materialize(df, name)
    keep = {out._vecloom_path}
    for path in [p for p in _paths if p not in keep]:
        delete(df.sparkSession, path)
    _paths[:] = [out._vecloom_path]
    if before is not None:
        discard(before)
    return out


def give_back(spark: SparkSession) -> None:
    """Have the executors' JVMs collect their garbage and give the heap that it filled back to the system, one task a core.

    A heap that one stage has grown doesn't shrink by itself, and would stand beside the Python workers of the next.
    """
    cores = max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, cores, 1, cores).selectExpr("java_method('java.lang.System', 'gc')").write.format("noop").mode("overwrite").save()


def clear_shared(spark: SparkSession) -> None:
    """Delete all that this package has written to the shared folder; results not yet written elsewhere can't be read after it."""
    delete(spark, f"{shared_dir(spark)}/vecloom")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, whatever the driver's working folder is; and keep Arrow batches small unless the session says otherwise."""
    if spark.conf.get(_ARROW_SETTING, None) == _ARROW_DEFAULT:
        spark.conf.set(_ARROW_SETTING, str(ARROW_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="vecloom-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "vecloom_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def maybe_broadcast(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it has at most BROADCAST_ROWS rows (counted unless given), else ``df`` itself."""
    return F.broadcast(df) if (seen(df) if rows is None else rows) <= BROADCAST_ROWS else df


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, spread: str, how: str = "inner", salts: int = 64) -> DataFrame:
    """Join ``rows`` to their one line in ``groups`` without sending a hot key's rows to one task.

    ``groups`` has ``keys``, ``size`` (rows of that key) and payload. Small ``groups`` are broadcast. Otherwise the keys that hold more
    than HOT_SHARE of ``total`` rows, fewer than 1 / HOT_SHARE of them, are replicated under ``salts`` salts and their rows spread over these,
    by a hash of the rows' id ``spread``, so that a task that runs again gives the same.
    """
    if seen(groups) <= BROADCAST_ROWS // 4:
        return rows.join(F.broadcast(groups), keys, how)
    hot = F.broadcast(groups.filter(F.col(size) > max(1000.0, total * HOT_SHARE)).select(*keys, F.lit(True).alias("_hot")))
    left = rows.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(F.lit(0))).drop("_hot")
    right = groups.join(hot, keys, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def attach_marks(rows: DataFrame, marks: DataFrame, spread: str) -> DataFrame:
    """``rows`` with ``_bad``, the list of the marks (name, mark) of their ``_name``, or null: by join, for marks that are too many to send to all tasks.

    Rows of a hot name, copies of one text, are spread by ``spread``. Names may collide: a row then also gets marks of another text, which it doesn't hold.
    """
    copies = rows.groupBy("_name").agg(F.count("*").alias("_copies"))
    bad = marks.groupBy(F.col("name").alias("_name")).agg(F.collect_set("mark").alias("_bad")).join(copies, "_name")
    bad = materialize(bad, "marks", members=F.sum("_copies"))
    return join_groups(rows, bad, ["_name"], "_copies", seen(bad, "members"), spread, "left").drop("_copies")


#: Edges, both ways, up to which components are made on the driver: 3 MB at most. The result is the same either way.
LOCAL_EDGES = 200_000


def _local_components(edges: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id of its component): each root points to the least root that an edge joins it with, until none moves."""
    a, b = (edges.column(k).to_numpy() for k in ("a", "b"))
    ids = np.unique(a)
    a, b = np.searchsorted(ids, a), np.searchsorted(ids, b)
    label = np.arange(len(ids))
    while True:
        new = label.copy()
        np.minimum.at(new, label[a], label[b])
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return ids, ids[label]
        label = new


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` as (id, comp), comp the smallest id: contraction until no edge is left; of a few edges on the driver.

    In a round every vertex points to its smallest neighbour; one that is smaller than all its neighbours points to the smallest
    neighbour of that neighbour, which may be itself. Pointers never go up, and each root has at least one vertex below it, so the
    vertices of the next round, the roots that still have edges, are at most half as many: log2(n) rounds, whatever the order of ids is.
    A round follows its pointers to the roots by pointer jumping. Each step is written to the shared folder. Vertices without an edge are not in the result.
    """
    both = edges.select("a", "b").filter("a <> b")
    sym = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    spark = edges.sparkSession
    if seen(sym) <= LOCAL_EDGES:
        ids, comps = _local_components(sym.toArrow())
        discard(sym)
        out = spark.createDataFrame(pa.table({"id": pa.array(ids, pa.int64()), "comp": pa.array(comps, pa.int64())}), "id long, comp long")
        out._vecloom_seen = {"_rows": len(ids)}
        return out
    rounds: list[tuple[DataFrame, int]] = []
    while True:
        near = materialize(sym.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("comp")), "near")
        n = seen(near)
        if rounds and n == 0:
            discard(sym, near)
            break
        up = maybe_broadcast(near.select(F.col("id").alias("comp"), F.col("comp").alias("next")), n)
        step = materialize(near.filter("comp < id").unionByName(near.filter("comp > id").join(up, "comp").select("id", F.col("next").alias("comp"))), "step")
        discard(near)
        while True:
            up = maybe_broadcast(step.select(F.col("id").alias("comp"), F.col("comp").alias("next")), n)
            new = materialize(step.join(up, "comp").select("id", F.col("comp").alias("old"), F.col("next").alias("comp")), "step", moved=F.count_if(F.col("comp") != F.col("old")))
            changed = seen(new, "moved")
            discard(step)
            step = new.select("id", "comp")
            step._vecloom_path = new._vecloom_path
            if not changed:
                break
        rounds.append((step, n))
        ends = [maybe_broadcast(step.select(F.col("id").alias(e), F.col("comp").alias(f"{e}_comp")), n) for e in ("a", "b")]
        new = materialize(sym.join(ends[0], "a").join(ends[1], "b").filter("a_comp <> b_comp").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b")).distinct(), "edges")
        discard(sym)
        sym = new
    labels, n = rounds.pop()
    while rounds:
        last, (step, more) = labels, rounds.pop()
        roots = maybe_broadcast(last.select(F.col("id").alias("comp"), F.col("comp").alias("root")), n)
        labels, n = materialize(step.join(roots, "comp", "left").select("id", F.coalesce("root", "comp").alias("comp")), "labels"), more
        discard(last, step)
    return labels


def crc_mod(column: str, by: int) -> Column:
    """crc32 of an id as text, modulo ``by``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """Without columns that an operator adds itself, so that clashing extra columns of the input don't matter."""
    return df.drop(*[n for n in names if n in df.columns])


def one_row(df: DataFrame, key: str, tie: list[Column]) -> DataFrame:
    """One row of ``df`` for each value of ``key``: that with the least ``tie``, then the least hash of its other columns."""
    others = [F.to_json(F.struct(F.col(c))) for c in df.columns if c != key]
    least = F.min_by(F.struct(*df.columns), F.struct(*tie, F.xxhash64(*others)))
    return df.groupBy(key).agg(least.alias("_row")).select("_row.*")
