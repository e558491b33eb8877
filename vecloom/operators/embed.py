"""Embedders: a protocol, a built-in one without dependencies, adapters for optional libraries, and token batch packing."""

from __future__ import annotations

import hashlib
import importlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import slices
from ..plans.shared import ship, small, small_batches, written
from .aggregates import signed_square_mean


#: Words whose hashes a task keeps, some 15 MB of usual ones.
KNOWN_WORDS = 100_000
#: Characters of texts that a tokenizer is given at once: its tokens take some fifty times as many bytes.
TOKENIZED_CHARS = 1 << 18


def in_blocks(texts: list[str], chars: int | None = None) -> Iterator[list[str]]:
    """Texts in turn in lists of about ``chars`` characters at most, one longer text by itself."""
    chars = chars or TOKENIZED_CHARS
    block, size = [], 0
    for t in texts:
        if block and size + len(t) > chars:
            yield block
            block, size = [], 0
        block.append(t)
        size += len(t)
    if block:
        yield block


class Embedder(Protocol):
    name: str
    dims: int

    def column(self, text: str | Column) -> Column:
        """Unit vectors of a text column; empty texts give zero vectors, so rows never shift."""


class HashEmbedder:
    """Feature hashing of words by md5, as :func:`vecloom.functions.text.hash_embedding` defines it.

    That expression is interpreted for each word and dimension; here words are counted in Arrow batches, each word's hash looked up once.
    """

    def __init__(self, dims: int = 64):
        if not 1 <= dims <= 256:
            raise ValueError("dims must be from 1 to 256")
        self.name, self.dims = f"hash-{dims}", dims

    def encoder(self) -> Callable[[list[str | None]], np.ndarray]:
        """A task's function of texts that gives their vectors, a row each."""
        letters = lazy("regex").compile(r"\p{L}+")
        dims = self.dims
        others = bytes(c if chr(c).isalpha() else 32 for c in range(128)) + bytes(128)

        class Known(dict):
            """Buckets of words as bytes; each is hashed when it is first looked up."""

            def __missing__(self, w: bytes) -> int:
                if len(self) >= KNOWN_WORDS:
                    self.clear()
                self[w] = at = hashlib.md5(w).digest()[0] % dims
                return at

        known = Known()

        def encode(texts: list[str | None]) -> np.ndarray:
            out = np.zeros((len(texts), dims))
            for i, t in enumerate(texts):
                if not t:
                    continue
                if t.isascii():  # its words are what is left when all but letters is white space
                    found = t.lower().encode().translate(others).split()
                else:
                    found = [w.encode() for w in letters.findall(t.lower())]
                if found:
                    out[i] = np.bincount(np.fromiter(map(known.__getitem__, found), np.int64, len(found)), minlength=dims)
            out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
            return out

        return encode

    def column(self, text: str | Column) -> Column:
        small_batches()
        return _vector_column(self, text)


class PandasEmbedder:
    """An embedder by a function of a list of texts that gives an array [n, dims]; ``load`` makes the function once a task."""

    def __init__(self, name: str, dims: int, load, batch_size: int = 128, normalize: bool = True):
        self.name, self.dims, self.load, self.batch_size, self.normalize = name, dims, load, batch_size, normalize

    def encoder(self) -> Callable[[list[str | None]], np.ndarray]:
        """A task's function of texts that gives their vectors, a row each."""
        model = self.load()
        dims, size, normalize = self.dims, self.batch_size, self.normalize

        def encode(texts: list[str | None]) -> np.ndarray:
            texts = [t or "" for t in texts]
            out = np.zeros((len(texts), dims))
            some = sorted((i for i, t in enumerate(texts) if t), key=lambda i: len(texts[i]))  # like lengths together
            for k in range(0, len(some), size):
                at = some[k : k + size]
                out[at] = np.asarray(model([texts[i] for i in at]), float)
            if normalize:
                out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
            return out

        return encode

    def column(self, text: str | Column) -> Column:
        return _vector_column(self, text)


def _vector_column(embedder: HashEmbedder | PandasEmbedder, text: str | Column) -> Column:
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = embedder.encoder()
        for part in parts:
            yield pd.Series(list(encode([t if isinstance(t, str) else None for t in part])))

    return F.pandas_udf(run, returnType=T.ArrayType(T.DoubleType()))(F.col(text) if isinstance(text, str) else text)


def lazy(module: str):
    """A module, or one clear error where it is not installed."""
    try:
        return importlib.import_module(module)
    except ImportError as e:
        raise ImportError(f"this adapter needs the package {module!r}, which is not installed") from e


def transformer_embedder(model: str, dims: int, max_len: int = 512, pooling: str = "mean", batch_size: int = 128) -> PandasEmbedder:
    """A local transformer with mean, cls, last or max pooling."""

    def load():
        torch, transformers = lazy("torch"), lazy("transformers")
        tok, net = transformers.AutoTokenizer.from_pretrained(model), transformers.AutoModel.from_pretrained(model).eval()

        def embed(texts: list[str]) -> np.ndarray:
            enc = tok(texts, padding=True, truncation=True, max_length=max_len, return_tensors="pt")
            with torch.no_grad():
                states = net(**enc).last_hidden_state.numpy()
            return np_pool(states, enc["attention_mask"].numpy(), pooling)

        return embed

    return PandasEmbedder(model, dims, load, batch_size)


def onnx_embedder(path: str, tokenizer: str, dims: int, max_len: int = 512, pooling: str = "mean", batch_size: int = 128) -> PandasEmbedder:
    """A local ONNX model with a tokenizer file."""

    def load():
        session = lazy("onnxruntime").InferenceSession(path)
        tok = lazy("tokenizers").Tokenizer.from_file(tokenizer)
        tok.enable_truncation(max_len)
        tok.enable_padding()
        inputs = {i.name for i in session.get_inputs()}

        def embed(texts: list[str]) -> np.ndarray:
            enc = tok.encode_batch(texts)
            ids, mask = np.array([e.ids for e in enc], np.int64), np.array([e.attention_mask for e in enc], np.int64)
            feed = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
            return np_pool(session.run(None, {k: v for k, v in feed.items() if k in inputs})[0], mask, pooling)

        return embed

    return PandasEmbedder(path, dims, load, batch_size)


def llama_embedder(path: str, dims: int) -> PandasEmbedder:
    def load():
        net = lazy("llama_cpp").Llama(model_path=path, embedding=True, verbose=False)
        return lambda texts: np.array([net.embed(t) for t in texts])

    return PandasEmbedder(path, dims, load, 1)


def vllm_embedder(model: str, dims: int) -> PandasEmbedder:
    def load():
        net = lazy("vllm").LLM(model=model, task="embed")
        return lambda texts: np.array([o.outputs.embedding for o in net.embed(texts)])

    return PandasEmbedder(model, dims, load, 1024)


class RateLimiter:
    """Keeps what was asked for within ``limits`` over any ``span`` seconds: :meth:`take` waits until the amounts fit, and gives the seconds it waited.

    An amount above its limit by itself waits for an empty span. Each task has a limiter of its own, so the limits of a job are its tasks' together.
    """

    def __init__(self, limits: dict[str, float], span: float = 70.0, clock=time.monotonic, sleep=time.sleep):
        self.limits, self.span, self.clock, self.sleep = limits, span, clock, sleep
        self.log: list[tuple[float, dict[str, float]]] = []

    def wait_for(self, now: float, **amounts: float) -> float:
        """Seconds until the span holds little enough: the youngest request that has to leave it decides."""
        self.log = [x for x in self.log if x[0] > now - self.span]
        wait = 0.0
        for name, limit in self.limits.items():
            room = limit - amounts.get(name, 0)
            total = 0.0
            for then, had in reversed(self.log):
                total += had.get(name, 0)
                if total > room:
                    wait = max(wait, then + self.span - now)
                    break
        return wait

    def take(self, **amounts: float) -> float:
        wait = self.wait_for(self.clock(), **amounts)
        if wait > 0:
            self.sleep(wait)
        self.log.append((self.clock(), amounts))
        return wait


def http_embedder(url: str, model: str, dims: int, key: str | None = None, retries: int = 5, pause: float = 5.0, tokenizer: str | None = None, max_len: int | None = None, limits: dict[str, float] | None = None, span: float = 70.0, batch_size: int = 256) -> PandasEmbedder:
    """An embedding server that takes {model, input} and gives data[i].embedding; retries are bounded, then the task fails.

    With a ``tokenizer`` file texts are cut to ``max_len`` tokens. ``limits`` has the most ``requests`` and ``tokens`` (characters / 4 without a
    tokenizer) in ``span`` seconds for each task; divide a job's limits by its tasks. Empty texts are not sent.
    """

    def load():
        import json
        import urllib.request

        cut = token_cutter(tokenizer, max_len) if tokenizer else None
        limiter = RateLimiter(limits, span) if limits else None

        def embed(texts: list[str]) -> np.ndarray:
            counts = [len(t) // 4 for t in texts]
            if cut:
                pairs = [cut(t) for t in texts]
                texts, counts = [t for t, _ in pairs], [n for _, n in pairs]
            body = json.dumps({"model": model, "input": texts}).encode()
            headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
            for left in range(retries, -1, -1):
                try:
                    if limiter:
                        limiter.take(requests=1, tokens=sum(counts))
                    with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=60) as r:
                        rows = sorted(json.load(r)["data"], key=lambda x: x["index"])
                    return np.array([x["embedding"] for x in rows])
                except OSError:
                    if not left:
                        raise
                    time.sleep(pause)

        return embed

    return PandasEmbedder(model, dims, load, batch_size)


def token_cutter(tokenizer: str, max_len: int | None):
    """A function of a text that gives its first ``max_len`` tokens' text, cut where they end in it, and their number."""
    tok = lazy("tokenizers").Tokenizer.from_file(tokenizer)

    def cut(text: str) -> tuple[str, int]:
        e = tok.encode(text, add_special_tokens=False)
        if max_len is None or len(e.ids) <= max_len:
            return text, len(e.ids)
        return text[: e.offsets[max_len - 1][1]], max_len

    return cut


def token_windows(text: str | Column, tokenizer: str, max_len: int, overlap: int = 0) -> Column:
    """A text's pieces of at most ``max_len`` tokens, each with the last ``overlap`` tokens of the one before: the whole text is in them. An empty text is one empty piece."""
    if not 0 <= overlap < max_len:
        raise ValueError("overlap must be less than max_len")

    def pieces(t: str, e) -> list[str]:
        # a piece goes from where its first token begins to where the next piece's first new token begins, so nothing between tokens is lost
        n, step = len(e.ids), max_len - overlap
        if not n:
            return [t]
        offsets = e.offsets
        firsts = [0] if n <= max_len else [0, *range(step, n - overlap, step)]
        starts = [0, *[offsets[k][0] for k in firsts[1:]]]
        ends = [offsets[k + max_len][0] if k + max_len < n else len(t) for k in firsts]
        return [t[a:b] for a, b in zip(starts, ends)]

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tok = lazy("tokenizers").Tokenizer.from_file(tokenizer)
        for part in parts:
            out = []
            for k in range(0, len(part), 256):
                texts = [t or "" for t in part.slice(k, 256).to_pylist()]
                for block in in_blocks(texts):
                    out.append(pa.array([pieces(t, e) for t, e in zip(block, tok.encode_batch(block, add_special_tokens=False))], pa.list_(pa.string())))
            yield pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.string()))

    small_batches()
    return F.arrow_udf(run, returnType=T.ArrayType(T.StringType()))(F.col(text) if isinstance(text, str) else text)


def pooling_type(folder: str) -> str | None:
    """The pooling that a local model folder's own configuration names (mean, cls, last or max), or None where it has none.

    ``modules.json`` lists the model's modules, one of which is the pooling with its folder; a folder that is not there is an error of the caller's.
    """
    import json
    import os

    listing = os.path.join(folder, "modules.json")
    if not os.path.exists(listing):
        return None
    with open(listing) as f:
        paths = [m["path"] for m in json.load(f) if str(m.get("type", "")).endswith("Pooling")]
    if not paths:
        return None
    with open(os.path.join(folder, paths[0], "config.json")) as f:
        about = json.load(f)
    for flag, name in (("mean_tokens", "mean"), ("cls_token", "cls"), ("lasttoken", "last"), ("max_tokens", "max")):
        if about.get(f"pooling_mode_{flag}"):
            return name
    raise ValueError(f"pooling of {folder} is not supported")


def np_pool(states: np.ndarray, mask: np.ndarray, how: str) -> np.ndarray:
    """Pool [n, tokens, dims] by a 0/1 mask."""
    m = mask[..., None].astype(float)
    if how == "mean":
        return (states * m).sum(1) / np.maximum(m.sum(1), 1)
    if how == "cls":
        return states[:, 0]
    if how == "last":
        return states[np.arange(len(states)), mask.sum(1) - 1]
    if how == "max":
        return np.where(m > 0, states, -np.inf).max(1)
    if how == "none":
        return np.where(m > 0, states, np.nan)
    raise ValueError(f"unknown pooling: {how}")


def pooled(parts: DataFrame, embedder: Embedder, once: bool, squared: bool = False) -> DataFrame:
    """(key, vec): the mean, or with ``squared`` the signed-square mean, of the vectors of ``parts(key, row, part)`` of each key.

    Parts of the same ``row`` have to follow one another, as an explode gives them: tasks embed them and keep a row's sum alone, so no part's vector
    leaves Python. With ``once`` a key has one row, and nothing is shuffled.
    """
    ship(parts.sparkSession)
    dims = embedder.dims

    def out(keys: list[pa.Array], n: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        vec = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * dims), pa.array(total.ravel()))
        return pa.RecordBatch.from_arrays([pa.concat_arrays(keys), pa.array(n), vec], ["key", "n", "vec"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = embedder.encoder()
        held = None  # the last row so far, whose parts may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            vecs = encode(b.column("part").to_pylist())
            if squared:
                vecs *= np.abs(vecs)
            rows = b.column("row").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            keys, n, total = b.column("key").take(pa.array(starts)), np.diff(np.append(starts, len(rows))), np.add.reduceat(vecs, starts, axis=0)
            if held is not None and held[0] == rows[0]:
                n[0] += held[2][0]
                total[0] += held[3][0]
            elif held is not None:
                yield out([held[1]], held[2], held[3])
            if len(n) > 1:
                yield out([keys.slice(0, len(n) - 1)], n[:-1], total[:-1])
            held = (rows[-1], pa.concat_arrays([keys.slice(len(n) - 1)]), n[-1:].copy(), total[-1:].copy())
        if held is not None:
            yield out([held[1]], held[2], held[3])

    sums = parts.select("key", "row", "part").mapInArrow(run, f"key {dict(parts.dtypes)['key']}, n long, vec array<double>")
    if not once:
        x = sums.select("key", "n", F.posexplode("vec").alias("i", "x"))
        each = x.groupBy("key", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        sums = each.groupBy("key").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vec"))
    mean = lambda x: x / F.col("n")
    return sums.select("key", F.transform("vec", (lambda x: F.signum(x) * F.sqrt(F.abs(mean(x)))) if squared else mean).alias("vec"))


def given_once(df: DataFrame, key: str, order: str | None = None) -> bool:
    """Whether no key is null or in two rows, and no row lacks its ``order``: looked up without the other columns."""
    rows = F.count("*") if order is None else F.count(order)
    return df.groupBy(key).agg(F.count("*").alias("_n"), rows.alias("_m")).filter(F.col(key).isNull() | (F.col("_n") > 1) | (F.col("_m") < 1)).isEmpty()


def embed_long(df: DataFrame, key: str, text: str, embedder: Embedder, width: int, tokenizer: str | None = None) -> DataFrame:
    """(key, vec): texts cut to ``width`` characters, or with a ``tokenizer`` file to ``width`` tokens, embedded, and brought back together by the signed-square mean.

    An embedder with an ``encoder`` brings them back in its tasks: see :func:`pooled`.
    """
    whole = F.coalesce(text, F.lit(""))
    cut = slices(whole, width) if tokenizer is None else token_windows(whole, tokenizer, width)
    if not hasattr(embedder, "encoder"):
        parts = df.select(key, F.explode_outer(cut).alias("_part"))
        return signed_square_mean(parts.select(key, embedder.column("_part").alias("vec")), [key])
    parts = df.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), cut.alias("_cut")).select("key", "row", F.explode_outer("_cut").alias("part"))
    return pooled(parts, embedder, given_once(df, key), squared=True).withColumnRenamed("key", key)


def greedy_batches(sizes: list[int], limit: int) -> list[list[int]]:
    """Rows packed into batches of at most ``limit``: always the largest size that still fits, first come first among equals."""
    if any(s > limit for s in sizes):
        raise ValueError("a size is above the limit")
    waiting: dict[int, list[int]] = {}
    for i, s in enumerate(sizes):
        waiting.setdefault(s, []).append(i)
    for q in waiting.values():
        q.reverse()
    order = sorted(waiting)
    out, batch, room = [], [], limit
    while order:
        at = int(np.searchsorted(order, room, "right")) - 1
        if at < 0:
            out.append(batch)
            batch, room = [], limit
            continue
        s = order[at]
        batch.append(waiting[s].pop())
        room -= s
        if not waiting[s]:
            order.pop(at)
    if batch:
        out.append(batch)
    return out


def split_sizes(df: DataFrame, size: str, limit: int) -> DataFrame:
    """Each row once for every piece of at most ``limit`` of its ``size``, numbered in ``piece``; a row of size 0 is one piece."""
    whole = df.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col(size) / limit), F.lit(1)).cast("int") - 1)))
    return whole.withColumn(size, F.least(F.lit(limit), F.col(size) - F.col("piece") * limit).cast(dict(df.dtypes)[size]))


def pack_batches(df: DataFrame, key: str, ident: str | list[str], size: str, limit: int, shard_rows: int = 50_000) -> DataFrame:
    """(key, batch_no, ident, size): :func:`greedy_batches` within each key, in order of ``ident``.

    A key of more than ``shard_rows`` rows is divided by a hash of ``ident`` into shards of about that many, each packed by itself and numbered
    after the one before, so no task has to hold a hot key.
    """
    ship(df.sparkSession)
    ids = [ident] if isinstance(ident, str) else list(ident)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ids])
        batches = greedy_batches(t.column(size).to_pylist(), limit)
        at = np.array([i for batch in batches for i in batch], np.int64)
        no = np.repeat(np.arange(len(batches), dtype=np.int64), [len(batch) for batch in batches])
        return t.take(pa.array(at)).append_column("batch_no", pa.array(no))

    shards = df.groupBy(F.col(key).alias("_key")).agg(F.ceil(F.count("*") / shard_rows).alias("_shards"))
    rows = df.join(small(shards), F.col(key).eqNullSafe(F.col("_key"))).select(key, F.pmod(F.xxhash64(*ids), "_shards").alias("_shard"), *ids, size)
    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    packed, _ = written(rows.groupBy(key, "_shard").applyInArrow(run, f"{fields}, batch_no long"), "packed")
    before = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    first = packed.groupBy(F.col(key).alias("_key"), F.col("_shard").alias("_of")).agg((F.max("batch_no") + 1).alias("n"))
    first = first.select("_key", "_of", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    out = packed.join(small(first), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_shard") == F.col("_of")))
    return out.select(key, (F.col("batch_no") + F.col("_first")).cast("int").alias("batch_no"), *ids, size)


def cached_embedding(df: DataFrame, text: str, embedder: Embedder) -> DataFrame:
    """Embeds each distinct text once, by its hash, then joins the vectors back."""
    keyed = df.withColumn("_h", F.sha2(F.coalesce(text, F.lit("")), 256))
    once = keyed.groupBy("_h").agg(F.first(F.coalesce(text, F.lit(""))).alias("_t")).select("_h", embedder.column("_t").alias("vec"))
    return keyed.join(once, "_h").drop("_h")


def embedding_job(texts: DataFrame, embedder: Embedder, path: str, shards: int) -> None:
    """Vectors of ``texts(id, text)`` written at ``path`` in ``shards`` folders (shard=k), by hash of the id: one job, whose tasks are the shards' workers."""
    shard = F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(shards)).cast("int")
    texts.select("id", embedder.column("text").alias("vec"), shard.alias("shard")).write.mode("overwrite").partitionBy("shard").parquet(path)


def md5_bucket(word: str, dims: int) -> int:
    """The bucket that the hashing embedder gives a word."""
    return hashlib.md5(word.encode()).digest()[0] % dims
