"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The targets of the sources are their votes and blocks of ``block`` words the seats: each seat goes to the highest quotient
votes / (2 * seats + 1). A source's seats are apportioned likewise to its shards, by their sizes. A shard's documents are put in a seeded
order, which cuts their words into blocks; with q seats for n blocks every block is taken q // n times and the first q % n once more. So no
block is ever listed: a document's share follows from where it starts in its shard.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._cluster import BROADCAST_ROWS, discard, materialize

#: Words in a block; documents in a shard, about; most times that a source's words are taken.
BLOCK, SHARD_DOCS, CAP = 64, 20_000, 3
#: Shards that are apportioned on the driver, about, besides one a source: shards grow where the documents are too many for more.
MAX_SHARDS = 1_000_000


def n_words(text):
    """Number of runs of characters outside [\\x20\\x09-\\x0D]: counted at their first characters, without making the words."""
    t = F.concat(F.lit(" "), F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return F.regexp_count(t, F.lit(r" [^ ]")).cast("long")


def targets(sizes: list[int], weights: list[int], cap: int = CAP) -> list[float]:
    """Shares of all words by weight, none above ``cap`` times its source's size: the excess is shared again until none is."""
    total, left = Fraction(sum(sizes)), set(range(len(sizes)))
    out = [Fraction(0)] * len(sizes)
    while left:
        weight = sum(weights[i] for i in left)
        over = [i for i in left if total * weights[i] > cap * sizes[i] * weight]
        if not over:
            for i in left:
                out[i] = total * weights[i] / weight
            break
        for i in over:
            out[i] = Fraction(cap * sizes[i])
            left.discard(i)
            total -= out[i]
    return [float(x) for x in out]


def sainte_lague(votes: list, seats: int) -> list[int]:
    """Seats by highest quotients votes / (2 * s + 1), ties to the earlier entry; a start near the end is corrected seat by seat."""
    exact = [Fraction(v) for v in votes]
    total = sum(exact)
    if not total or seats <= 0:
        return [0] * len(votes)
    out = [int(v * seats / total) for v in exact]
    # rounding down never exceeds the result by more than the corrections below undo
    add = [(-v / (2 * s + 1), i) for i, (v, s) in enumerate(zip(exact, out)) if v]
    heapq.heapify(add)
    given = sum(out)
    while given < seats:
        _, i = heapq.heappop(add)
        out[i] += 1
        given += 1
        heapq.heappush(add, (-exact[i] / (2 * out[i] + 1), i))
    # a seat belongs elsewhere while someone's last quotient is below another's next
    last = [(exact[i] / (2 * s - 1), -i) for i, s in enumerate(out) if s]
    heapq.heapify(last)
    while last:
        low, j = last[0]
        j = -j
        if low != exact[j] / (2 * out[j] - 1) if out[j] else True:
            heapq.heappop(last)
            continue
        best, i = add[0]
        if -best != exact[i] / (2 * out[i] + 1):
            heapq.heapreplace(add, (-exact[i] / (2 * out[i] + 1), i))
            continue
        if i == j or (-best, -i) <= (low, -j):
            break
        heapq.heappop(last)
        heapq.heappop(add)
        out[j] -= 1
        out[i] += 1
        for k in (i, j):
            heapq.heappush(add, (-exact[k] / (2 * out[k] + 1), k))
            if out[k]:
                heapq.heappush(last, (exact[k] / (2 * out[k] - 1), -k))
    return out


def plan_mix(docs: DataFrame, block: int = BLOCK, shard_docs: int = SHARD_DOCS, cap: int = CAP, seed: int = 17, payload: list[str] | None = None) -> DataFrame:
    """Each row of ``docs(doc_id, text, source)`` with size, source_size, target, copies, extra_from, extra_to and taken.

    ``copies``: times that the whole document is taken; the words [extra_from, extra_to) of it are taken once more. Sources in code point
    order, null last, weigh 1, 2, 3, and so on again. A source's taken words differ from its target by less than a block for itself and each of its shards. A null text has size 0 and takes nothing. Where a source has no words its target is 0. The
    order within a shard is by hash of seed and doc_id, then doc_id, then text hash, so repeated rows have their places too. An empty table gives no rows;
    null and repeated doc_ids are allowed; other columns are not looked at, unless they are asked for as ``payload``. The driver gets a row a source and a row a shard.
    """
    sized = docs.select("doc_id", "source", *(payload or []), n_words(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id").alias("_order"), F.xxhash64("text").alias("_tie"))
    narrow = sized.drop(*(payload or []))
    narrow = materialize(narrow, "sizes")
    by_source = narrow.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("docs")).toPandas()  # one row a source
    found = sorted(((s is None, s or "", int(n), int(d)) for s, n, d in ((None if pd.isna(s) else s, n, d) for s, n, d in by_source.itertuples(index=False))))
    names, n = [None if null else s for null, s, _, _ in found], [x[2] for x in found]
    weights = [1 + i % 3 for i in range(len(n))]
    want = targets(n, weights, cap)
    seats = sainte_lague(want, round(sum(n) / block))
    spark = docs.sparkSession
    shard_docs = max(shard_docs, -(-sum(x[3] for x in found) // MAX_SHARDS))
    plan = [(s, size, t, max(1, -(-d // shard_docs))) for s, size, t, (*_, d) in zip(names, n, want, found)]
    sources = spark.createDataFrame(plan, "source string, source_size long, target double, shards int")
    sources = F.broadcast(sources) if len(plan) <= BROADCAST_ROWS else sources

    def placed(d: DataFrame) -> DataFrame:
        return d.join(sources, d["source"].eqNullSafe(sources["source"])).drop(sources["source"]).withColumn("shard", F.pmod(F.xxhash64("_order", F.lit(3)), F.col("shards")).cast("int"))

    # a row a shard, so one for about shard_docs documents
    shards = placed(narrow).groupBy("source", "shard").agg(F.sum("size").alias("shard_size")).toPandas()
    rows = []
    own_shards = {None if pd.isna(s) else s: g.sort_values("shard") for s, g in shards.groupby("source", dropna=False)}
    for i, s in enumerate(names):
        own = own_shards[s]
        size = [int(x) for x in own["shard_size"]]
        for shard, k, q in zip(own["shard"], size, sainte_lague(size, seats[i])):
            blocks = max(1, -(-k // block))
            q = min(q, cap * blocks)
            rows.append((s, int(shard), q // blocks, q % blocks * block))
    quotas = spark.createDataFrame(rows, "source string, shard int, copies long, extra long")
    quotas = F.broadcast(quotas) if len(rows) <= BROADCAST_ROWS else quotas
    base = placed(sized if payload else narrow)
    out = base.join(quotas, base["source"].eqNullSafe(quotas["source"]) & (base["shard"] == quotas["shard"])).drop(quotas["source"]).drop(quotas["shard"])
    end = F.sum("size").over(Window.partitionBy("source", "shard").orderBy("_order", "doc_id", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = out.withColumn("_at", end - F.col("size")).withColumn("extra_to", F.greatest(F.lit(0), F.least(F.col("extra") - F.col("_at"), F.col("size"))))
    return out.select("doc_id", *(payload or []), "source", "size", "source_size", "target", "copies", F.lit(0).cast("long").alias("extra_from"), F.col("extra_to").cast("long").alias("extra_to"), (F.col("copies") * F.col("size") + F.col("extra_to")).cast("long").alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows of ``docs``: ``copies`` whole ones of each, and one with the first words where a block boundary cuts it.

    Columns as given, whatever their names; n_chars (if there) of the row's text. A document of which nothing is taken, as of a null text, has no row.
    Repeated rows are mixed each by itself; an empty table stays empty.
    """
    inner = {c: f"_in_{c}" for c in docs.columns if c not in ("doc_id", "source", "text")}
    plan = plan_mix(docs.withColumnsRenamed(inner), payload=["text", *inner.values()], **options)
    kinds = F.concat(F.array_repeat(F.lit(True), F.col("copies").cast("int")), F.when(F.col("extra_to") > 0, F.array(F.lit(False))).otherwise(F.array().cast("array<boolean>")))
    rows = plan.withColumn("_whole", F.explode(kinds))
    partial = ~F.col("_whole") & (F.col("extra_to") < F.col("size"))
    # the prefix that ends with word number extra_to: white space and words are cut apart at their boundaries
    words = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    text = F.when(partial, F.concat_ws("", F.slice(words, F.lit(1), F.greatest(F.col("extra_to"), F.lit(1)).cast("int")))).otherwise(F.col("text"))
    out = rows.select("doc_id", "source", text.alias("text"), *[F.col(v).alias(k) for k, v in inner.items()], partial.alias("_cut"))
    if "n_chars" in inner:
        out = out.withColumn("n_chars", F.when(F.col("_cut"), F.length("text")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(docs.columns)
