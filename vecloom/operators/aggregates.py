"""Aggregations over vectors and small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vec import doubles, normalize, rescale, subtract


def per_dimension(df: DataFrame, keys: list[str], vec: str, expr) -> DataFrame:
    """(keys, vec): ``expr(x)`` aggregated for each component. Components are pre-aggregated map-side, so only sums are shuffled."""
    x = df.select(*keys, F.posexplode(doubles(vec)).alias("_i", "_x"))
    each = x.groupBy(*keys, "_i").agg(expr(F.col("_x")).alias("_v"))
    gathered = F.sort_array(F.collect_list(F.struct("_i", "_v")))
    return each.groupBy(*keys).agg(gathered.alias("_g")).select(*keys, F.transform("_g", lambda s: s["_v"]).alias(vec))


def mean_vectors(df: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    return per_dimension(df, keys, vec, F.avg)


def centroids(df: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """Means of unit length."""
    return mean_vectors(df, keys, vec).withColumn(vec, normalize(vec))


def signed_square_mean(df: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """For each component m = mean(sign(x) * x * x), then sign(m) * sqrt(|m|); one row passes through."""

    def root(x: Column) -> Column:
        m = F.avg(F.signum(x) * x * x)
        return F.signum(m) * F.sqrt(F.abs(m))

    return per_dimension(df, keys, vec, root)


def demean(df: DataFrame, vec: str = "vec", norm: str = "l2") -> DataFrame:
    """Subtract the mean of all rows, then divide by the norm (or its square)."""
    mean = mean_vectors(df.select(F.lit(0).alias("_one"), vec), ["_one"], vec).select(F.col(vec).alias("_mean"))
    return df.crossJoin(F.broadcast(mean)).withColumn(vec, rescale(subtract(vec, "_mean"), norm)).drop("_mean")


def length_stats(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    n = F.length(text)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(n).alias("mean_len"), F.stddev_samp(n).alias("std_len"))


def exceeds(df: DataFrame, limits: dict[str, float]) -> DataFrame:
    """One row: for each column whether its sum is above its limit, and whether any is."""
    over = [(F.coalesce(F.sum(c), F.lit(0)) > limit).alias(f"{c}_over") for c, limit in limits.items()]
    out = df.agg(*over)
    any_over = F.lit(False)
    for c in limits:
        any_over = any_over | F.col(f"{c}_over")
    return out.withColumn("any_over", any_over)


def group_lists(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Values of each key, in order."""
    return df.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda s: s[value]).alias(value))


def size_histogram(df: DataFrame, size: str, ident: str) -> DataFrame:
    """Ids of each size, in their order, and their number."""
    return df.groupBy(size).agg(F.sort_array(F.collect_list(ident)).alias("ids"), F.count("*").alias("n"))


def running(df: DataFrame, values: dict[str, Column], order: list[str], within: list[str], how: str = "sum") -> DataFrame:
    """``df`` with the sum (or ``max``) of each of ``values`` over its group's rows up to and with this one, and over the whole group as ``<name>_total``.

    Rows are range-partitioned by group and order, so a hot group lies in many tasks; each task sums its own rows, and the tasks' sums, a row
    for each group in each task, give what was before.
    """
    from ..plans.shared import small, written

    gather = {"sum": F.sum, "max": F.max}[how]
    join = (lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))) if how == "sum" else F.greatest

    added = df.select("*", *[c.alias(f"_v_{k}") for k, c in values.items()])
    ranged, _ = written(added.repartitionByRange(*within, *order).sortWithinPartitions(*within, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    here = Window.partitionBy("_part", *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = ranged.groupBy("_part", *within).agg(*[gather(f"_v_{k}").alias(f"_s_{k}") for k in values])
    group = Window.partitionBy(*within)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_w_{c}") for c in within], *[gather(f"_s_{k}").over(before).alias(f"_b_{k}") for k in values], *[gather(f"_s_{k}").over(group).alias(f"_t_{k}") for k in values])
    local = ranged.select("*", *[gather(f"_v_{k}").over(here).alias(f"_l_{k}") for k in values])
    match = F.col("_part") == F.col("_p")
    for c in within:
        match = match & F.col(c).eqNullSafe(F.col(f"_w_{c}"))
    out = local.join(small(base), match)
    return out.select(*df.columns, *[join(F.col(f"_b_{k}"), F.col(f"_l_{k}")).alias(k) for k in values], *[F.col(f"_t_{k}").alias(f"{k}_total") for k in values])


def bounds(df: DataFrame, length: str, order: list[str], within: list[str]) -> DataFrame:
    """start and end of each row in the running sum of ``length`` within a group."""
    return running(df, {"end": F.col(length)}, order, within).drop("end_total").withColumn("start", F.col("end") - F.col(length))


def batch_ids(df: DataFrame, size: int, order: list[str], within: list[str]) -> DataFrame:
    """Number of the batch of ``size`` rows that each row falls in, with the batch's last bound."""
    out = running(df, {"_r": F.lit(1)}, order, within).withColumn("batch", F.floor((F.col("_r") - 1) / size).cast("int"))
    return out.withColumn("batch_end", F.least((F.col("batch") + 1) * size, F.col("_r_total")).cast("long")).drop("_r", "_r_total")
