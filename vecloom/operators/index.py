"""The vector index as a table: index(label, grp, pos, vec). Mutations give a new table; positions keep insertion order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import small, written

COLUMNS = ["label", "grp", "pos", "vec"]


def _require(df: DataFrame, bad: DataFrame, message: str) -> DataFrame:
    """``df``, failing when the plan runs if ``bad`` (one column) has a row."""
    name = bad.columns[0]
    check = bad.agg(F.first(name).alias("b")).select(F.when(F.col("b").isNull(), True).otherwise(F.raise_error(F.concat(F.lit(message + ": "), F.col("b").cast("string"))).cast("boolean")).alias("_ok"))
    return df.crossJoin(F.broadcast(check)).filter("_ok").drop("_ok")


def with_positions(df: DataFrame, order: list[str], column: str = "pos", start: Column | int = 0) -> DataFrame:
    """Dense positions in the order given, without one task that holds all rows.

    Rows are range-partitioned by ``order`` and numbered within their partition; the partitions' counts, a row each, give each its start.
    """
    ranged, _ = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_start"))
    return ranged.join(F.broadcast(starts), "_part").withColumn(column, (local + F.col("_start") + start).cast("long")).drop("_part", "_start")


def duplicates(df: DataFrame, key: str = "label") -> DataFrame:
    return df.groupBy(key).count().filter("count > 1").select(key)


def upsert(index: DataFrame, rows: DataFrame, strict: bool = False) -> DataFrame:
    """``rows(label, grp, ord, vec)`` into the index: known labels are overwritten in place, new ones appended by ``ord``.

    A label twice in ``rows`` raises; with ``strict`` so does a known one.
    """
    rows = rows.select("label", "grp", "ord", "vec")
    rows = _require(rows, duplicates(rows), "label given twice")
    known = index.select("label", "pos")
    if strict:
        rows = _require(rows, rows.join(known, "label", "left_semi").select("label"), "label is known")
    updated = rows.join(known, "label").select(COLUMNS)
    fresh = with_positions(rows.join(known, "label", "left_anti"), ["ord"])
    end = index.agg((F.coalesce(F.max("pos"), F.lit(-1)) + 1).alias("_end"))
    appended = fresh.crossJoin(F.broadcast(end)).withColumn("pos", F.col("pos") + F.col("_end")).select(COLUMNS)
    return index.join(rows.select("label"), "label", "left_anti").select(COLUMNS).unionByName(updated).unionByName(appended)


def insert_only(index: DataFrame, rows: DataFrame) -> DataFrame:
    """As :func:`upsert`, where any known label raises."""
    return upsert(index, rows, strict=True)


def delete(index: DataFrame, labels: DataFrame | None = None, where: Column | None = None) -> DataFrame:
    """Without the rows whose label is in ``labels(label)`` or that satisfy ``where``; unknown labels don't matter. Order is kept."""
    if labels is not None:
        index = index.join(labels.select("label"), "label", "left_anti").select(index.columns)
    return index if where is None else index.filter(~F.coalesce(where, F.lit(False)))


def clear(index: DataFrame) -> DataFrame:
    return index.filter(F.lit(False))


def get(index: DataFrame, requested: DataFrame) -> DataFrame:
    """(ord, label, vec) for ``requested(ord, label)``; a missing label raises."""
    found = requested.join(index.select("label", "vec"), "label", "left")
    missing = F.when(F.col("vec").isNull(), F.raise_error(F.concat(F.lit("no such label: "), F.col("label").cast("string"))).cast("boolean")).otherwise(True)
    return found.filter(missing).select("ord", "label", "vec")


def get_positions(index: DataFrame, requested: DataFrame) -> DataFrame:
    """(ord, label, vec) for ``requested(ord, at)`` by position; negative ones count from the end; out of bounds raises."""
    dense = with_positions(index.select("label", "pos", "vec").withColumnRenamed("pos", "_old"), ["_old"], "at_pos")
    n = index.agg(F.count("*").alias("_n"))
    asked = requested.crossJoin(F.broadcast(n)).withColumn("at_pos", F.when(F.col("at") < 0, F.col("at") + F.col("_n")).otherwise(F.col("at")))
    inside = F.when((F.col("at_pos") < 0) | (F.col("at_pos") >= F.col("_n")), F.raise_error(F.concat(F.lit("position out of bounds: "), F.col("at").cast("string"))).cast("boolean")).otherwise(True)
    return asked.filter(inside).join(dense, "at_pos").select("ord", "label", "vec")


def group_labels(index: DataFrame, groups: list) -> DataFrame:
    """(label, pos) of the groups' rows."""
    from .knn import prefilter

    return prefilter(index, groups).select("label", "pos")


def group_ids(index: DataFrame) -> DataFrame:
    """(grp, gid): dense numbers for the groups, by value; see :func:`with_positions` for how they are dealt out."""
    return with_positions(index.select("grp").distinct(), ["grp"], "gid").select("grp", F.col("gid").cast("int").alias("gid"))


def register_groups(known: DataFrame, index: DataFrame) -> DataFrame:
    """``known(grp, gid)`` with the groups of ``index`` that it lacks, numbered from its end on by value; numbers once given stay."""
    fresh = index.select("grp").distinct().join(known.withColumnRenamed("grp", "_k"), F.col("grp").eqNullSafe(F.col("_k")), "left_anti")
    end = known.agg((F.coalesce(F.max("gid"), F.lit(-1)) + 1).alias("_end"))
    numbered = with_positions(fresh, ["grp"], "gid").crossJoin(F.broadcast(end))
    return known.select("grp", "gid").unionByName(numbered.select("grp", (F.col("gid") + F.col("_end")).cast("int").alias("gid")))


def all_groups(index: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(label, pos, grp, gid) of all rows: each row's group and its number, which decodes back to the group."""
    ids = group_ids(index) if ids is None else ids
    return index.select("label", "pos", F.col("grp").alias("_g")).join(small(ids), F.col("_g").eqNullSafe(F.col("grp"))).select("label", "pos", "grp", "gid")


def set_rows(index: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows(pos, vec)`` written over the vectors at these positions, as they are stored; a position that the index lacks raises."""
    rows = _require(rows, rows.join(index.select("pos"), "pos", "left_anti").select("pos"), "no such position")
    new = rows.select(F.col("pos").alias("_p"), F.col("vec").alias("_v"))
    return index.join(new, index["pos"] == new["_p"], "left").select("label", "grp", "pos", F.coalesce("_v", "vec").alias("vec"))


def merge(shards: list[DataFrame]) -> DataFrame:
    """Shards (label, grp, pos, vec) in order: the last one that has a label wins; its place is the first one's."""
    every = None
    for i, s in enumerate(shards):
        part = s.select(*COLUMNS, F.lit(i).alias("shard"))
        every = part if every is None else every.unionByName(part)
    one = every.groupBy("label").agg(F.max_by(F.struct("grp", "vec"), F.struct("shard", "pos")).alias("v"), F.min(F.struct("shard", "pos")).alias("o"))
    return with_positions(one.select("label", "v.grp", "v.vec", F.col("o.shard").alias("s"), F.col("o.pos").alias("p")), ["s", "p", "label"]).select(COLUMNS)


def keep_last(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One row a key: its last value, at its first place."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value), F.min(order).alias(order))


def keep_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("label").intersect(b.select("label"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("label").subtract(b.select("label"))


def disjoint(a: DataFrame, b: DataFrame) -> bool:
    return intersection(a, b).isEmpty()


def is_unique(df: DataFrame, key: str = "label") -> bool:
    return duplicates(df, key).isEmpty()


def quantized(index: DataFrame, spec) -> DataFrame:
    """The index with ``vec`` stored by ``spec``."""
    from ..functions.quant import quantize

    return index.withColumn("vec", quantize("vec", spec))
