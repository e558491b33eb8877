"""Language identification: averaged embeddings of hashed subwords under a linear softmax, trained by stochastic gradient descent in numpy.

Subwords are runs of 2 to 4 bytes of the lower-cased text, with everything but letters read as a space. As the model is linear up to
the softmax, embeddings times output weights are multiplied out once after training, and a text costs one table lookup a subword.
Probabilities are calibrated by a temperature on rows kept out of the descent, and a text is rejected when its probability lies below the
threshold that keeps the accepted ones of these rows right.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._cluster import ship
from ._sampling import training_texts

BITS, DIMS, TRAIN_ROWS = 14, 16, 3_000
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


@dataclass
class Model:
    languages: list[str]
    embedding: np.ndarray
    output: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.9

    def table(self) -> np.ndarray:
        return (self.embedding @ self.output).astype(np.float32)


def subwords(data: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of the runs of 2, 3 and 4 bytes that begin at each byte."""
    b = _FOLD[data].astype(np.uint32)
    padded = np.r_[b, np.full(3, 32, np.uint32)]
    code, n = b, len(b)
    for k in range(1, 4):
        code = (code << np.uint32(8)) | padded[k : k + n]
        h = (code * np.uint32(2654435761 + 2 * k)) >> np.uint32(32 - BITS)
        yield h.astype(np.int32)


def _average(column: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """([texts, width] mean of the table's rows over a text's subwords, number of subwords). A run that crosses texts is left out."""
    data, offsets = T.buffers(pc.utf8_lower(pc.fill_null(column, "")))
    n = len(offsets) - 1
    total, count = np.zeros((n, table.shape[1])), np.zeros(n)
    if not len(data):
        return total, count
    size = np.diff(offsets)
    some = np.flatnonzero(size)
    letter = _FOLD[data] != 32
    near = letter.copy()
    near[:-1] |= letter[1:]
    for k, h in enumerate(subwords(data), 1):
        ok = near.copy()
        for back in range(1, k + 1):  # the last bytes of a text begin no run
            at = offsets[1:] - back
            ok[at[at >= offsets[:-1]]] = False
        v = table[h]
        v[~ok] = 0
        total[some] += np.add.reduceat(v, offsets[:-1][some], axis=0)
        count[some] += np.add.reduceat(ok, offsets[:-1][some], dtype=np.int64)
    return total / np.maximum(count, 1)[:, None], count


def histograms(texts: list[str]) -> np.ndarray:
    """[texts, buckets] shares of the subwords."""
    out = np.zeros((len(texts), 1 << BITS), np.float32)
    for i, t in enumerate(texts):
        data = np.frombuffer(t.lower().encode(), np.uint8)
        letter = _FOLD[data] != 32
        near = letter.copy()
        near[:-1] |= letter[1:]
        for k, h in enumerate(subwords(data), 1):
            h = h[:-k][near[:-k]] if len(h) > k else h[:0]
            out[i] += np.bincount(h, minlength=1 << BITS)
        out[i] /= max(1.0, float(out[i].sum()))
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(rows: list[tuple[str, str]], epochs: int = 12, batch: int = 32, rate: float = 40.0, accepted_right: float = 0.99, seed: int = 5) -> Model:
    """Train on (text, language); a fifth of each language's rows, rounded down, is kept for calibration. Needs at least one row with a letter.

    Where no language has five rows nothing is kept: the temperature stays 1 and the threshold is 0.9.
    """
    rows = [(t, y) for t, y in rows if _LETTER.search(t)]
    languages = sorted({y for _, y in rows})
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    y = np.array([languages.index(q) for _, q in rows], int)
    own = [order[y[order] == k] for k in range(len(languages))]
    kept = np.concatenate([x[: len(x) // 5] for x in own])
    used = np.setdiff1d(order, kept)
    share = np.bincount(y[used], minlength=len(languages)) / max(1, len(used))
    model = Model(languages, rng.normal(0, 0.1, (1 << BITS, DIMS)).astype(np.float32), rng.normal(0, 0.3, (DIMS, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    for epoch in range(epochs):
        rng.shuffle(used)
        step = rate * (1 - epoch / epochs)
        for i in range(0, len(used), batch):
            at = used[i : i + batch]
            x = histograms([rows[k][0] for k in at])
            hidden = x @ model.embedding
            d = _softmax(hidden @ model.output + model.bias)
            d[np.arange(len(at)), y[at]] -= 1
            d *= (1 / np.maximum(share[y[at]] * len(languages), 0.2))[:, None] / len(at)
            back = d @ model.output.T
            model.output -= np.float32(step / 40) * (hidden.T @ d).astype(np.float32)
            model.bias -= np.float32(step / 400) * d.sum(0).astype(np.float32)
            model.embedding -= np.float32(step) * (x.T @ back).astype(np.float32)
    if len(kept):
        z = np.concatenate([histograms([rows[k][0] for k in kept[i : i + batch]]) @ model.table() for i in range(0, len(kept), batch)]) + model.bias
        loss = lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(kept)), y[kept]], 1e-12)).mean()
        model.temperature = float(min(np.geomspace(0.2, 5, 60), key=loss))
        p = _softmax(z / model.temperature)
        right, top = p.argmax(1) == y[kept], p.max(1)
        by = np.argsort(-top)
        good = np.flatnonzero(np.cumsum(right[by]) / np.arange(1, len(by) + 1) >= accepted_right)
        model.threshold = float(min(top[by[good[-1]]], 0.9)) if len(good) else 0.9
    return model


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, names = model.table(), np.array(model.languages, object)
        for b in T.blocks(batches):
            texts = b.column("text")
            mean, _ = _average(texts, table)
            p = _softmax((mean + model.bias) / model.temperature)
            best = p.argmax(1)
            score = p[np.arange(len(p)), best]
            data, offsets = T.buffers(texts)
            some = T.sums(((data | 32) >= 97) & ((data | 32) <= 122), offsets) > 0
            for i in np.flatnonzero(~some):
                some[i] = _LETTER.search(texts[int(i)].as_py() or "") is not None
            lang = np.where(some, names[best], "und")
            score = np.where(some, score, 0.0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(~some | (score < model.threshold))], ["doc_id", "lang_pred", "score", "rejected"])

    return run


def fit_language_id(docs: DataFrame, by: int = 4, held_out: int = 2, rows: int = TRAIN_ROWS) -> Model:
    """Fit on about ``rows`` rows of ``docs(doc_id, text, lang)`` at most that have a language and are not held out."""
    found = training_texts(docs, docs.select("doc_id", "lang"), "lang", by, held_out, rows)
    return fit(found) if any(_LETTER.search(t) for t, _ in found) else Model(["und"], np.zeros((1 << BITS, DIMS), np.float32), np.zeros((DIMS, 1), np.float32), np.zeros(1, np.float32))


def predict_language(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of each whole text of ``docs(doc_id, text)``.

    Null texts and texts without a letter are ``und`` with score 0, and rejected. lang_pred is the likeliest language even where rejected.
    Repeated rows are predicted alike; a null doc_id stays null; other columns are not looked at; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_predict(model), "doc_id long, lang_pred string, score double, rejected boolean")
