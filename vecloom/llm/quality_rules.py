"""Quality rules: per-text measures, and cross-document line frequency.

Lines are normalised (lower case in A-Z, white space collapsed) and hashed; for each host the distinct documents that hold a line are
counted; lines above the limits are removed and documents that lose too much are rejected. Copies of a document would make all its lines
frequent, so a document is named by its set of lines: a hash of all of them. Texts with equal sets of lines then count as one document,
and are left to the operators that remove copies; texts that share only some of their lines, however many, count as several.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._cluster import attach_marks, join_groups, materialize, seen, ship

_U = np.uint64
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rules:
    """A line is too frequent in a host from ``min_docs`` distinct documents on, whatever the host's size."""

    min_docs: int = 20
    #: A document is rejected if fewer than this share of its words, or fewer than ``min_left`` words, are left once lines were removed.
    min_left_share: float = 0.25
    min_left: int = 30
    min_words: int = 50
    max_repeat_percent: int = 50
    #: Frequent lines handled in one pass over the texts; more take further passes, up to ``passes``. Beyond that texts and lines are joined.
    lines_a_pass: int = 1_000_000
    passes: int = 4


_HOST = "_host"


def _line_keys(data: np.ndarray, offsets: np.ndarray):
    """Lines with their first word, number of words and hash; and the words."""
    start, end, first = T.words(data, offsets)
    h = T.Prefix(data, fold=True).of(start, end)
    ls, le, lf = T.lines(data, offsets)
    w0 = np.searchsorted(start, ls)
    w1 = np.maximum(np.searchsorted(start, le), w0)
    return start, end, first, ls, le, lf, w1 - w0, T.sequence_hash(h, w0, w1)


def _host_hash(column: pa.Array) -> np.ndarray:
    data, offsets = T.buffers(column)
    h = T.Prefix(data).of(offsets[:-1], offsets[1:])
    return np.where(np.asarray(pc.is_null(column)), _U(0x51ED270B), h)


def _count_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key of host and line, document's name) once for each distinct line of a text."""
    for b in T.blocks(batches):
        data, offsets = T.buffers(b.column("text"))
        *_, lf, n, h = _line_keys(data, offsets)
        doc = np.repeat(np.arange(len(lf) - 1), np.diff(lf))[n > 0]
        h = h[n > 0]
        if not len(doc):
            continue
        key = T.mix(h + T.mix(doc.astype(_U) + _U(99)))
        _, at = np.unique(key, return_index=True)
        doc, h = doc[at], h[at]
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
        edge = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        name = T.mix(np.add.reduceat(T.mix(h ^ _U(0x77)), edge))
        names = np.repeat(name, np.diff(np.r_[edge, len(doc)]))
        where = T.mix(_host_hash(b.column(_HOST))[doc] * _U(3) + h)
        yield pa.RecordBatch.from_arrays([pa.array(T.signed(where)), pa.array(T.signed(names))], ["line", "name"])


def frequent_lines(docs: DataFrame, host: str, rules: Rules) -> DataFrame:
    """(line, docs): keys of host and line that are above the limit, with their numbers of distinct documents."""
    pairs = docs.select("text", F.col(host).cast("string").alias(_HOST)).mapInArrow(_count_lines, "line long, name long")
    # the first grouping takes a line's rows by document too, so a line that all documents share is spread over all tasks
    counts = pairs.groupBy("line", "name").agg(F.lit(1).alias("one")).groupBy("line").agg(F.count("*").alias("docs"))
    return materialize(counts.filter(f"docs >= {rules.min_docs}"), "frequent")


def _lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, line) of the lines of the texts, by their ``_name``."""
    for b in T.blocks(batches):
        data, offsets = T.buffers(b.column("text"))
        *_, lf, n, h = _line_keys(data, offsets)
        doc = np.repeat(np.arange(len(lf) - 1), np.diff(lf))[n > 0]
        where = T.mix(_host_hash(b.column(_HOST))[doc] * _U(3) + h[n > 0])
        yield pa.RecordBatch.from_arrays([b.column("_name").take(pa.array(doc)), pa.array(T.signed(where))], ["name", "line"])


def _with_frequent(rows: DataFrame, lines: DataFrame, spread: str) -> DataFrame:
    """``rows`` with ``_bad``, the keys of their frequent lines."""
    rows = rows.withColumn("_name", F.xxhash64(_HOST, "text"))
    pairs = materialize(rows.select("text", _HOST, "_name").mapInArrow(_lines_of, "name long, line long").distinct(), "pairs")
    marks = join_groups(pairs, lines, ["line"], "docs", seen(pairs), "name").select("name", F.col("line").alias("mark"))
    return attach_marks(rows, marks, spread).drop("_name")


_MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _measure(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    start, end, first = T.words(data, offsets)
    n_docs = len(offsets) - 1
    prefix = T.Prefix(data)
    h = prefix.of(start, end)
    lead = (data & 0xC0) != 0x80
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    repeat = np.zeros(len(h), bool)
    if len(h) > 2:
        ok = doc[2:] == doc[:-2]
        at = np.flatnonzero(ok)
        key = T.mix(h[at] * _U(0x9E3779B97F4A7C15) + T.mix(h[at + 1] * _U(0xD6E8FEB86659FD93) + h[at + 2]) + T.mix(doc[at].astype(_U) + _U(1)))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = at[twice]
        repeat[hit] = repeat[hit + 1] = repeat[hit + 2] = True
    ls, le, lf = T.lines(data, offsets)
    n = np.searchsorted(start, le) - np.searchsorted(start, ls)
    ldoc = np.repeat(np.arange(n_docs), np.diff(lf))[n > 0]
    key = T.mix(prefix.of(ls, le)[n > 0] + T.mix(ldoc.astype(_U) + _U(2)))
    _, once = np.unique(key, return_index=True)
    dup = np.bincount(ldoc, minlength=n_docs) - np.bincount(ldoc[once], minlength=n_docs)
    return [np.diff(first), T.sums(lead & ~T.SPACE[data], offsets), T.sums(_SYMBOL[data], offsets), dup, T.sums(repeat, first)]


def _pass(keys: np.ndarray, first_pass: bool, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = T.HashSet(keys)
        for b in T.blocks(batches):
            data, offsets = T.buffers(b.column("text"))
            *_, ls, le, lf, n, h = _line_keys(data, offsets)
            doc = np.repeat(np.arange(len(lf) - 1), np.diff(lf))
            listed = "_bad" in b.schema.names
            bad = np.zeros(len(n), bool)
            if listed or len(known):
                where = T.mix(_host_hash(b.column(_HOST))[doc] * _U(3) + h)
                bad = (n > 0) & (T.in_lists(where, doc, b.column("_bad")) if listed else known.find(where) >= 0)
            lost = np.bincount(doc[bad], weights=n[bad], minlength=len(lf) - 1).astype(np.int64)
            columns = {name: b.column(name) for name in b.schema.names if name != "_bad"}
            if first_pass:
                columns |= {f"_{k}": pa.array(np.asarray(v, np.int64)) for k, v in zip(_MEASURES, _measure(data, offsets))}
                columns["_lost"] = pa.array(lost)
            else:
                columns["_lost"] = pc.add(columns["_lost"], pa.array(lost))
            if with_text and bad.any():
                texts = columns["text"].to_pylist()
                raw = data.tobytes()
                for d in np.unique(doc[bad]):
                    texts[d] = b"\n".join(raw[ls[i] : le[i]] for i in range(lf[d], lf[d + 1]) if not bad[i]).decode()
                columns["text"] = pa.array(texts, columns["text"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _no_text(inner):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in inner(batches):
            keep = [n for n in b.schema.names if n not in ("text", _HOST)]
            yield b.select(keep)

    return run


def apply_rules(docs: DataFrame, host: str = "source", rules: Rules = Rules(), with_text: bool = True, payload: list[str] | None = None) -> DataFrame:
    """Each row's ``payload`` columns (doc_id unless given) with its measures, removed_words, base_failed and kept; with the text without its frequent lines if asked.

    Measures are of the original text: n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words. base_failed: fewer than
    ``min_words`` words, or more than ``max_repeat_percent`` of them in repeated 3-word windows. kept: not base_failed, and no line was
    removed or enough is left. A null text counts as empty, so it fails; a null host is a host of its own; repeated rows are judged alike; an empty table
    gives no rows; other columns are not looked at, unless they are asked for as ``payload``.
    """
    spark = docs.sparkSession
    ship(spark)
    payload = ["doc_id"] if payload is None else payload
    lines = frequent_lines(docs, host, rules)
    n = seen(lines)
    rounds = max(1, -(-n // rules.lines_a_pass))
    out = docs.select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(payload)], "text", F.col(host).cast("string").alias(_HOST))
    if rounds > rules.passes:
        out, n, rounds = _with_frequent(out, lines, "_p0" if payload else _HOST), 0, 1
    for k in range(rounds):
        chunk = lines if rounds == 1 else lines.filter(F.pmod(F.xxhash64("line"), F.lit(rounds)) == k)
        keys = chunk.toArrow().column("line").to_numpy().view(np.uint64) if n else np.zeros(0, np.uint64)
        f = _pass(keys, k == 0, with_text)
        fields = [f"`{c}` {t}" for c, t in out.dtypes if c != "_bad"]
        if k == 0:
            fields += [f"_{m} long" for m in _MEASURES] + ["_lost long"]
        if k == rounds - 1 and not with_text:
            f = _no_text(f)
            fields = [x for x in fields if not x.startswith(("`text`", f"`{_HOST}`"))]
        out = out.mapInArrow(f, ", ".join(fields))
    left = F.col("_n_words") - F.col("_lost")
    failed = (F.col("_n_words") < rules.min_words) | (100 * F.col("_n_repeat_words") > rules.max_repeat_percent * F.col("_n_words"))
    enough = (F.col("_lost") == 0) | ((left >= rules.min_left) & (left >= rules.min_left_share * F.col("_n_words")))
    cols = [F.col(f"_p{i}").alias(c) for i, c in enumerate(payload)] + [F.col(f"_{m}").alias(m if m not in payload else f"rule_{m}") for m in _MEASURES]
    cols += [F.col("_lost").alias("removed_words"), failed.alias("base_failed"), (~failed & enough).alias("kept")]
    return out.select(*cols, *([F.col("text").alias("clean_text")] if with_text else []))


def filter_by_rules(docs: DataFrame, host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """``docs`` without the rejected rows and without frequent lines; columns as given, n_chars (if there) of the new text.

    Nulls, repeated rows and empty tables as in :func:`apply_rules`; extra columns go along, whatever their names.
    """
    others = [c for c in docs.columns if c != "text"]
    out = apply_rules(docs.withColumnsRenamed({c: f"_in_{c}" for c in others if c != host}), host, rules, True, [c if c == host else f"_in_{c}" for c in others])
    out = out.filter("kept").select(*[F.col(c if c == host else f"_in_{c}").alias(c) for c in others], F.col("clean_text").alias("text"), F.col("removed_words").alias("_removed"))
    if "n_chars" in others:
        out = out.withColumn("n_chars", F.when(F.col("_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(docs.columns)
