"""Similarity analytics over dated vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vec import dot
from .aggregates import mean_vectors
from .index import keep_first
from .knn import window_topk


def parse_date(c: str | Column) -> Column:
    """A date, or null where the text is none."""
    return F.to_date(F.try_to_timestamp(F.col(c) if isinstance(c, str) else c))


def metadata_merge(index: DataFrame, meta: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The index in its order with its first metadata row; rows without metadata have nulls."""
    return index.join(keep_first(meta, key, order), index["label"] == F.col(key), "left").drop(key)


def days(c: str | Column) -> Column:
    return F.datediff(F.col(c) if isinstance(c, str) else c, F.lit("1970-01-01").cast("date"))


def windowed_topk(focal: DataFrame, comparison: DataFrame, years: int = 5, ks: tuple[int, ...] = (10, 25, 50, 100), exclude_self: bool = False) -> DataFrame:
    """(label, pre_k..., pos_k...): mean of the k highest similarities to rows dated up to ``years`` before or on, and after, a focal row.

    Both sides are (label, date, vec); a missing date is 1970-01-01; a window without rows gives null. Similarities are made in blocks within the tasks that
    hold the comparison rows, and only each task's best k leave it, so no pair is a row: see :func:`vecloom.operators.knn.window_topk`.
    """
    day = days(F.coalesce("date", F.lit("1970-01-01").cast("date"))).alias("day")
    best = window_topk(focal.select("label", day, "vec"), comparison.select("label", day, "vec"), 365 * years, max(ks), exclude_self)
    means = [F.avg(F.when((F.col("side") == i) & (F.col("rank") <= k), F.col("sim"))).alias(f"{s}_{k}") for i, s in enumerate(("pre", "pos")) for k in ks]
    found = best.groupBy("qid").agg(*means)
    return focal.select("label").join(found, F.col("label") == F.col("qid"), "left").drop("qid")


def year_of(date: str, min_year: int) -> Column:
    """The year, at least ``min_year``; a missing date counts there too."""
    return F.greatest(F.coalesce(F.year(date), F.lit(min_year)), F.lit(min_year))


def yearly_means(focal: DataFrame, comparison: DataFrame, min_year: int) -> tuple[DataFrame, DataFrame]:
    """((label, year, sim), (year, n)): mean similarity of each focal row to the rows of each year.

    As the mean of inner products is the inner product with the mean, one centroid a year replaces all pairs.
    """
    dated = comparison.withColumn("year", year_of("date", min_year))
    counts = dated.groupBy("year").agg(F.count("*").alias("n"))
    centres = mean_vectors(dated, ["year"]).withColumnRenamed("vec", "centre")
    return focal.select("label", "vec").crossJoin(F.broadcast(centres)).select("label", "year", dot("vec", "centre").alias("sim")), counts


def novelty(focal: DataFrame, sims: DataFrame, counts: DataFrame, min_year: int, delta: int = 5, year_cut: int | None = None) -> DataFrame:
    """(label, year, pre, pos): count-weighted means over [y - delta + 1, y] and [y + 1, y + delta]; null for years above ``year_cut`` or empty."""
    own = focal.select("label", year_of("date", min_year).alias("y"))
    near = sims.join(F.broadcast(counts), "year").join(own, "label").filter((F.col("year") > F.col("y") - delta) & (F.col("year") <= F.col("y") + delta))
    part = lambda after: F.try_divide(F.sum(F.when((F.col("year") > F.col("y")) == after, F.col("n") * F.col("sim"))), F.sum(F.when((F.col("year") > F.col("y")) == after, F.col("n"))))
    found = near.groupBy("label").agg(part(F.lit(False)).alias("pre"), part(F.lit(True)).alias("pos"))
    out = own.join(found, "label", "left")
    if year_cut is not None:
        out = out.select("label", "y", *[F.when(F.col("y") <= year_cut, F.col(c)).alias(c) for c in ("pre", "pos")])
    return out.withColumnRenamed("y", "year")
