"""Evaluation reports, ranking quality, and parity checks."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import run_name
from ..functions.vec import dot
from ..plans.shared import ship, small_batches
from .embed import in_blocks, lazy


def nested(json_text: str, path: list[str]):
    """A value inside a JSON text, by a list of keys."""
    return F.get_json_object(json_text, "$" + "".join(f"['{k}']" for k in path))


def benchmark_report(results: DataFrame, keys: list[str], benches: list[str], grouped: list[str], group_name: str) -> DataFrame:
    """Long results (keys, bench, metric) to one row a key: percentages by bench, members of the group replaced by their mean, ``Average`` first.

    ``Average`` is the mean of the columns, so a mean of means for the group.
    """
    pct = results.select(*keys, "bench", (100 * F.col("metric")).alias("metric"))
    alone = pct.filter(~F.col("bench").isin(grouped))
    group = pct.filter(F.col("bench").isin(grouped)).groupBy(*keys).agg(F.avg("metric").alias("metric")).select(*keys, F.lit(group_name).alias("bench"), "metric")
    every = alone.unionByName(group)
    average = every.groupBy(*keys).agg(F.avg("metric").alias("metric")).select(*keys, F.lit("Average").alias("bench"), "metric")
    names = ["Average", *sorted({b for b in benches if b not in grouped} | {group_name})]
    return every.unionByName(average).groupBy(*keys).pivot("bench", names).agg(F.first("metric"))


def parse_runs(results: DataFrame, name: str) -> DataFrame:
    """``results`` with org, model, max_len and quant of a column of run names."""
    org, model, max_len, quant = run_name(name)
    return results.select("*", org.alias("org"), model.alias("model"), max_len.cast("int").alias("max_len"), quant.alias("quant"))


def write_results(results: DataFrame, path: str) -> None:
    """Long results (run, split, bench, metric) as one JSON object a line, in a folder for each run and task; :func:`read_results` reads them."""
    body = F.to_json(F.create_map("split", F.create_map(F.lit("metric"), F.col("metric"))))
    parts = results.select(F.replace("run", F.lit("/"), F.lit("__")).alias("run"), "bench", body.alias("value"))
    parts.write.mode("overwrite").partitionBy("run", "bench").text(path)


def read_results(spark: SparkSession, path: str, split: Callable[[str], Column] | None = None) -> DataFrame:
    """(org, model, max_len, quant, bench, metric) of what :func:`write_results` wrote; ``split(bench)`` names the split to take, ``test`` by default."""
    rows = spark.read.option("basePath", path).schema("value string, run string, bench string").text(path)
    wanted = F.lit("test") if split is None else split("bench")
    by_split = F.from_json("value", "map<string,map<string,double>>")
    found = rows.select(F.replace("run", F.lit("__"), F.lit("/")).alias("run"), "bench", F.try_element_at(F.try_element_at(by_split, wanted), F.lit("metric")).alias("metric"))
    return parse_runs(found.filter("metric is not null"), "run").drop("run").select("org", "model", "max_len", "quant", "bench", "metric")


def evaluate(tasks: dict[str, tuple[DataFrame, DataFrame]], run: str, split: str = "test") -> DataFrame:
    """Long results (run, split, bench, metric) of retrieval tasks, each an exact ranking and another one: the mean nDCG over the task's queries."""
    out = None
    for bench, (exact, other) in tasks.items():
        row = ndcg(exact, other).agg(F.avg("ndcg").alias("metric")).select(F.lit(run).alias("run"), F.lit(split).alias("split"), F.lit(bench).alias("bench"), "metric")
        out = row if out is None else out.unionByName(row)
    return out


def recall(exact: DataFrame, other: DataFrame) -> DataFrame:
    """(qid, recall): share of the exact neighbours (qid, label) that the other ranking has."""
    hit = exact.join(other.select("qid", "label", F.lit(1).alias("hit")), ["qid", "label"], "left")
    return hit.groupBy("qid").agg((F.coalesce(F.sum("hit"), F.lit(0)) / F.count("*")).alias("recall"))


def ndcg(exact: DataFrame, other: DataFrame) -> DataFrame:
    """(qid, ndcg) of a ranking (qid, label, rank) where the exact neighbours are the relevant ones."""
    gain = lambda r: 1 / F.log2(F.col(r) + 1)
    ideal = exact.groupBy("qid").agg(F.sum(gain("rank")).alias("ideal"))
    got = other.join(exact.select("qid", "label"), ["qid", "label"]).groupBy("qid").agg(F.sum(gain("rank")).alias("got"))
    return ideal.join(got, "qid", "left").select("qid", (F.coalesce("got", F.lit(0.0)) / F.col("ideal")).alias("ndcg"))


def embedding_parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Inner products of two embedders' vectors for the same rows (id, vec)."""
    return a.join(b.withColumnRenamed("vec", "other"), "id").select("id", dot("vec", "other").alias("sim"))


def embedder_parity(texts: DataFrame, one, other, max_len: int | None = 512) -> DataFrame:
    """(id, sim) of ``texts(id, text)`` under two embedders, the texts cut to ``max_len`` characters."""
    text = F.col("text") if max_len is None else F.substring("text", 1, max_len)
    cut = texts.select("id", text.alias("text"))
    return embedding_parity(cut.select("id", one.column("text").alias("vec")), cut.select("id", other.column("text").alias("vec")))


def edit_script(a: list, b: list) -> list[tuple[str, int, int]]:
    """(op, place in a, place in b) of a least number of replacements, insertions and deletions that turn ``a`` into ``b``, in order.

    Where several scripts are as short, the one is taken that from the end prefers a match or replacement, then a deletion.
    """
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0  # equal ends match, as from the end a match comes first
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    names = {t: i for i, t in enumerate(dict.fromkeys([*a, *b]))}
    x, y = np.array([names[t] for t in a], np.int64), np.array([names[t] for t in b], np.int64)
    steps = np.arange(len(y) + 1)
    height = len(x) + 1 if len(x) * len(y) <= SCRIPT_CELLS else math.isqrt(len(x))

    def below(above: np.ndarray, i: int) -> np.ndarray:
        row = np.empty(len(y) + 1, np.int64)
        row[0] = i
        row[1:] = np.minimum(above[:-1] + (y != x[i - 1]), above[1:] + 1)
        return (np.minimum.accumulate(row - steps) + steps).astype(np.int32)  # insertions along the row

    # of a large table every height-th row is kept, and the rows between are made again where the script passes
    row = steps.astype(np.int32)
    kept, cost, first = [row], [row], 0
    for i in range(1, len(x) + 1):
        row = below(row, i)
        if i % height == 0:
            kept.append(row)
        if height > len(x):
            cost.append(row)
    i, j, out = len(x), len(y), []
    if height <= len(x):
        first = i + 1
    while i or j:
        if i and i - 1 < first:
            first = (i - 1) // height * height
            cost = [kept[first // height]]
            for n in range(first + 1, i + 1):
                cost.append(below(cost[-1], n))
        here = cost[i - first][j] if i else j
        if i and j and here == cost[i - 1 - first][j - 1] + (x[i - 1] != y[j - 1]):
            i, j = i - 1, j - 1
            if x[i] != y[j]:
                out.append(("replace", lo + i, lo + j))
        elif i and here == cost[i - 1 - first][j] + 1:
            i -= 1
            out.append(("delete", lo + i, lo + j))
        else:
            j -= 1
            out.append(("insert", lo + i, lo + j))
    return out[::-1]


#: Cells of a table of costs up to which it is held whole.
SCRIPT_CELLS = 1 << 20
#: Rows whose scripts, or whose tokens, are held at once.
SCRIPT_ROWS = 256


def _scripts(ids: pa.Array, pairs: Iterator[tuple[list, list]]) -> pa.RecordBatch:
    """(id, op, i, j) of pairs of token lists that differ, one for each of ``ids``."""
    at, op, i, j = [], [], [], []
    for k, (a, b) in enumerate(pairs):
        if a is None or b is None or a == b:
            continue
        for o, m, n in edit_script(a, b):
            at.append(k)
            op.append(o)
            i.append(m)
            j.append(n)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(op, pa.string()), pa.array(i, pa.int32()), pa.array(j, pa.int32())], ["id", "op", "i", "j"])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, SCRIPT_ROWS):
            part = b.slice(k, SCRIPT_ROWS)
            yield _scripts(part.column("id"), ((None if x is None else list(x), None if y is None else list(y)) for x, y in zip(part.column("a").to_pandas(), part.column("b").to_pandas())))


def edit_operations(pairs: DataFrame) -> DataFrame:
    """(id, op, i, j): a shortest edit script that turns token list a into b, for rows (id, a, b) that differ."""
    ship(pairs.sparkSession)
    kind = dict(pairs.dtypes)["id"]
    return pairs.select("id", "a", "b").filter("a <> b").mapInArrow(_edits, f"id {kind}, op string, i int, j int")


def _tokens(tok, texts: list[str], prefix: str) -> list[list[str]]:
    return [[t.removeprefix(prefix) if t.startswith(prefix) else f" {t}" for t in e.tokens] for e in tok.encode_batch(texts, add_special_tokens=False)]


def tokens_of(text: str | Column, tokenizer: str, prefix: str = "##") -> Column:
    """Tokens of a text by a vocabulary file of the tokenizers library: continuations without their prefix, other tokens after a blank."""

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tok = lazy("tokenizers").Tokenizer.from_file(tokenizer)
        for part in parts:
            out = []
            for k in range(0, len(part), SCRIPT_ROWS):
                for block in in_blocks([t or "" for t in part.slice(k, SCRIPT_ROWS).to_pylist()]):
                    out.append(pa.array(_tokens(tok, block, prefix), pa.list_(pa.string())))
            yield pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.string()))

    small_batches()
    return F.arrow_udf(run, returnType=T.ArrayType(T.StringType()))(F.col(text) if isinstance(text, str) else text)


def tokenizer_parity(texts: DataFrame, one: str, other: str, max_len: int | None = 512, prefix: str = "##") -> DataFrame:
    """Edit scripts between the tokens of two vocabulary files, for the rows of ``texts(id, text)``, cut to ``max_len`` characters, on which they differ.

    Tokens are made and compared in one pass, some texts at a time: no token is a row or leaves its task.
    """
    ship(texts.sparkSession)
    text = F.col("text") if max_len is None else F.substring("text", 1, max_len)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = (lazy("tokenizers").Tokenizer.from_file(x) for x in (one, other))
        for b in batches:
            for k in range(0, b.num_rows, SCRIPT_ROWS):
                part = b.slice(k, SCRIPT_ROWS)
                at = 0
                for block in in_blocks([t or "" for t in part.column("text").to_pylist()]):
                    yield _scripts(part.column("id").slice(at, len(block)), zip(_tokens(first, block, prefix), _tokens(second, block, prefix)))
                    at += len(block)

    kind = dict(texts.dtypes)["id"]
    return texts.select("id", text.alias("text")).mapInArrow(run, f"id {kind}, op string, i int, j int")


def throughput(rows: int, seconds: float) -> dict[str, float]:
    return {"rows": rows, "seconds": seconds, "rows_per_second": rows / seconds if seconds else float("inf")}


def profile(texts: DataFrame, work: Column) -> dict[str, float]:
    """Rows, mean and deviation of the length of ``texts(text)``, and the seconds and rows a second that computing ``work`` over them all takes."""
    about = texts.agg(F.count("*").alias("n"), F.avg(F.length("text")).alias("mean"), F.stddev_samp(F.length("text")).alias("std")).first()
    began = time.perf_counter()
    texts.select(work.alias("x")).write.format("noop").mode("overwrite").save()
    return throughput(about["n"], time.perf_counter() - began) | {"mean_len": about["mean"], "std_len": about["std"]}


def profile_kernels(rows: int = 1 << 16, dims: int = 384, bits: int = 8, seed: int = 0) -> dict[str, float]:
    """Milliseconds that one block of random vectors takes to quantise, and to be multiplied with one query: the kernels of the Arrow engine alone."""
    from ..functions import quant as Q

    rng = np.random.default_rng(seed)
    x, q = rng.normal(size=(rows, dims)), rng.normal(size=dims)
    top = (1 << bits) - 1
    spec = Q.QuantSpec(f"qint{bits}", 4 / top, top / 2)
    t0 = time.perf_counter()
    packed = Q.np_pack(Q.np_codes(x, spec), bits)
    t1 = time.perf_counter()
    Q.np_dequantize(packed, spec) @ q
    return {"quantize_ms": 1000 * (t1 - t0), "matmul_ms": 1000 * (time.perf_counter() - t1)}
