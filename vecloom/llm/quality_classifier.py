"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded by what its characters and words look like; a hidden layer
turns that into a vector, a gated unit (tanh times sigmoid) into an attention weight, and the document's score is a logistic function of
the weighted mean of its passages' vectors. Labels are of documents only, so the attention learns which passages decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._cluster import ship
from ._sampling import training_texts

PASSAGE, HASHED, HIDDEN, GATE, TRAIN_ROWS = 64, 64, 24, 12, 6_000
_U = np.uint64
_CLASSES = np.full(256, 7, np.int64)
_CLASSES[97:123], _CLASSES[65:91], _CLASSES[48:58], _CLASSES[T.SPACE] = 0, 1, 2, 3
_CLASSES[list(b".,")], _CLASSES[list(b";:'\"!?-()")], _CLASSES[list(b"#*$%&|<>=_{}[]\\/^~`@+")], _CLASSES[33] = 4, 5, 6, 8
_N_CLASSES = 9
_EXTRA = 10
FEATURES = _N_CLASSES + _EXTRA + HASHED


def encode(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """([passages, FEATURES], first passage of each text with the number of passages last). A text without words is one empty passage."""
    data, offsets = T.buffers(column)
    start, end, first = T.words(data, offsets)
    n = np.diff(first)
    count = np.maximum(1, -(-n // PASSAGE))
    bag = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=bag[1:])
    total = int(bag[-1])
    doc = np.repeat(np.arange(len(n)), n)
    passage = bag[doc] + (np.arange(len(start)) - first[doc]) // PASSAGE  # of each word
    x = np.zeros((total, FEATURES))
    if not len(start):
        return x, bag
    words = np.bincount(passage, minlength=total).astype(float)
    # bytes go with the word that they follow; white space before a text's first word goes with none
    begins = np.zeros(len(data), np.int32)
    begins[start] = 1
    owner = np.maximum(np.cumsum(begins, dtype=np.int32) - 1, 0)
    own = (doc[owner] == np.repeat(np.arange(len(n)), np.diff(offsets))) & (start[owner] <= np.arange(len(data)))
    place, kind = passage[owner[own]], _CLASSES[data[own]]
    chars = np.bincount(place * _N_CLASSES + kind, minlength=total * _N_CLASSES).reshape(total, _N_CLASSES)
    size = np.maximum(chars.sum(1, keepdims=True), 1)
    x[:, :_N_CLASSES] = np.sqrt(chars / size)
    w = np.maximum(words, 1)
    h = T.Prefix(data, fold=True).of(start, end)
    length = end - start
    mean = np.bincount(passage, length, total) / w
    spread = np.sqrt(np.maximum(np.bincount(passage, length.astype(float) ** 2, total) / w - mean**2, 0))
    key = T.mix(h + T.mix(passage.astype(_U) + _U(1)))
    _, at = np.unique(key, return_index=True)
    different = np.bincount(passage[at], minlength=total)
    same = np.r_[False, (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])]
    last, head = data[end - 1], data[start]
    breaks = np.bincount(passage[owner[own & (data == 10)]], minlength=total)
    b = _N_CLASSES
    x[:, b] = mean / 10
    x[:, b + 1] = spread / 10
    x[:, b + 2] = different / w
    x[:, b + 3] = np.bincount(passage, same, total) / w
    x[:, b + 4] = np.bincount(passage, _CLASSES[last] >= 5, total) / w
    x[:, b + 5] = np.bincount(passage, _CLASSES[head] == 1, total) / w
    x[:, b + 6] = breaks / w
    x[:, b + 7] = np.bincount(passage, length == 1, total) / w
    x[:, b + 8] = np.log1p(words) / 5
    x[:, b + 9] = np.log1p(n[np.repeat(np.arange(len(n)), count)]) / 8
    # hashed pairs of bytes at the words' ends and starts
    bucket = ((head.astype(np.int64) * 31 + last) * 40503 >> 4) % HASHED
    x[:, b + _EXTRA :] = np.sqrt(np.bincount(passage * HASHED + bucket, minlength=total * HASHED).reshape(total, HASHED) / w[:, None])
    return x, bag


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bag: np.ndarray) -> tuple:
        p = self.w
        z = (x - self.mean) / self.scale
        hidden = np.tanh(z @ p["H"] + p["h"])
        t, s = np.tanh(hidden @ p["V"]), 1 / (1 + np.exp(-(hidden @ p["U"])))
        e = (t * s) @ p["a"]
        at, n = bag[:-1], np.diff(bag)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), n))
        weight = e / np.repeat(np.add.reduceat(e, at), n)
        pooled = np.add.reduceat(hidden * weight[:, None], at)
        return z, hidden, t, s, weight, pooled, 1 / (1 + np.exp(-np.clip(pooled @ p["o"] + p["c"], -30, 30)))

    def gradient(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray, importance: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean weighted logistic loss over the bags, by each of the weights."""
        w = self.w
        n = np.diff(bag)
        z, hidden, t, s, weight, pooled, p = self.forward(x, bag)
        d = (p - y) * importance / len(y)
        g = {"o": pooled.T @ d, "c": d.sum()}
        dp = np.repeat(d[:, None] * w["o"], n, axis=0)
        inner = (dp * hidden).sum(1)
        de = weight * (inner - np.repeat(np.add.reduceat(weight * inner, bag[:-1]), n))
        g["a"] = (t * s).T @ de
        dt, ds = de[:, None] * w["a"] * s * (1 - t**2), de[:, None] * w["a"] * t * s * (1 - s)
        g["V"], g["U"] = hidden.T @ dt, hidden.T @ ds
        dh = (dp * weight[:, None] + dt @ w["V"].T + ds @ w["U"].T) * (1 - hidden**2)
        g["H"], g["h"] = z.T @ dh, dh.sum(0)
        return g

    def score(self, x: np.ndarray, bag: np.ndarray) -> np.ndarray:
        return self.forward(x, bag)[-1] if len(bag) > 1 else np.zeros(0)


def fit(bags: list[np.ndarray], labels: list[int], epochs: int = 30, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 3) -> Model:
    """Adam on the logistic loss, classes weighed evenly on the way and the bias set back to their shares after. Bags are [passages, FEATURES]."""
    rng = np.random.default_rng(seed)
    shapes = {"H": (FEATURES, HIDDEN), "h": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "a": (GATE,), "o": (HIDDEN,), "c": ()}
    w = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) else np.zeros(s) for k, s in shapes.items()}
    w["h"] = np.zeros(HIDDEN)
    if not bags:
        return Model(np.zeros(FEATURES), np.ones(FEATURES), w | {"o": np.zeros(HIDDEN)})
    every = np.concatenate(bags)
    model = Model(every.mean(0), every.std(0) + 0.05, w)
    y = np.array(labels, float)
    share = min(max(y.mean(), 0.01), 0.99)
    importance = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    m, v, step = {k: np.zeros(s) for k, s in shapes.items()}, {k: np.zeros(s) for k, s in shapes.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), batch):
            at = order[i : i + batch]
            x = np.concatenate([bags[k] for k in at])
            bag = np.r_[0, np.cumsum([len(bags[k]) for k in at])]
            g = model.gradient(x, bag, y[at], importance[at])
            step += 1
            now = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            for k in w:
                grad = g[k] + decay * w[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad**2
                w[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    w["c"] = w["c"] + np.log(share / (1 - share)) * 0.5
    return model


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.blocks(batches):
            x, bag = encode(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x, bag)), pa.array(np.diff(bag))], ["doc_id", "score", "n_passages"])

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, by: int = 4, held_out: int = 2, rows: int = TRAIN_ROWS) -> Model:
    """Fit on about ``rows`` labelled texts at most, none of them held out."""
    found = training_texts(docs, labels, "quality", by, held_out, rows)
    bags = []
    for i in range(0, len(found), 100):
        x, bag = encode(pa.array([t for t, _ in found[i : i + 100]]))
        bags += np.split(x, bag[1:-1])
    return fit(bags, [int(y) for _, y in found])


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_passages) of each whole text of ``docs(doc_id, text)``.

    Null and empty texts are one empty passage. Repeated rows are scored alike; a null doc_id stays null; other columns are not looked
    at; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(model), "doc_id long, score double, n_passages long")
