"""Trailing-window rate limits over a request log (user, ts, requests, tokens)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregates import running


def usage(log: DataFrame, span: str, by: str, ts: str, amounts: dict[str, str]) -> DataFrame:
    """Totals of each amount over [ts - span, ts] for each row.

    A row's span lies in its own and the last stretch of that length, so each row also goes to the stretch after its own: windows are by key and stretch, and a
    hot key is spread over time.
    """
    width = F.expr(f"unix_micros(timestamp_seconds(0) + INTERVAL {span})")
    stretch = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / width)
    rows = log.withColumn("_own", stretch).withColumn("_stretch", F.explode(F.array("_own", F.col("_own") + 1)))
    frame = f"OVER (PARTITION BY {by}, _stretch ORDER BY {ts} RANGE BETWEEN INTERVAL {span} PRECEDING AND CURRENT ROW)"
    return rows.selectExpr("*", *[f"sum({c}) {frame} AS {name}" for name, c in amounts.items()]).filter("_stretch = _own").drop("_own", "_stretch")


def wait(log: DataFrame, span_seconds: int, by: str, ts: str, limits: dict[str, float]) -> DataFrame:
    """For each row, the seconds to wait until its trailing totals are within ``limits``.

    Going back from the row, the first request at which a running total exceeds its limit has to leave the span: the wait is the span
    less that request's age, and 0 if no limit is exceeded. With several limits the longest wait counts. Amounts must not be negative.

    No pair of requests is made: with P the sum before a request, the one looked for is the latest whose P is below this request's sum less the limit. Requests by
    their P and rows by that bound are put in one order, where a running maximum of the requests' times has the answer, however hot a key is.
    """
    keys = [by, "event_id"]
    now = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    rows = log.select(*keys, now.alias("_now"), *limits)
    summed = running(rows, {f"_s_{c}": F.col(c) for c in limits}, ["_now", "event_id"], [by])
    cuts = []
    for c, limit in limits.items():
        total = F.col(f"_s_{c}").cast("double")
        requests = summed.select(by, F.lit(None).cast(dict(rows.dtypes)["event_id"]).alias("event_id"), (total - F.col(c)).alias("_at"), F.lit(1).alias("_kind"), F.col("_now").alias("_then"))
        bounds = summed.select(*keys, (total - limit).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("double").alias("_then"))
        found = running(requests.unionByName(bounds), {"_cut": F.col("_then")}, ["_at", "_kind", "_then"], [by], "max")
        cuts.append(found.filter("_kind = 0").select(*keys, F.col("_cut").alias(f"_cut_{c}")))
    joined = reduce(lambda a, b: a.join(b, keys), cuts, rows.select(*keys, "_now"))
    cut = F.greatest(F.lit(float("-inf")), *[F.coalesce(f"_cut_{c}", F.lit(float("-inf"))) for c in limits])
    return joined.select(*keys, F.greatest(F.lit(0.0), F.when(cut < F.col("_now") - span_seconds, 0.0).otherwise(span_seconds - (F.col("_now") - cut))).alias("wait_s"))
