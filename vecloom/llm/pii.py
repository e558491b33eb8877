"""Personal data: patterns, and information-theoretic sanitisation of the terms that give protected entities away.

Patterns find e-mail and IP addresses, card and phone numbers. A term that stands near one of these, a protected entity, discloses it as far
as the corpus lets one guess the entity from the term: with n(t, e) the distinct texts where t stands near e, n(t) those that hold t, n(e)
those that hold e and N all texts, the disclosure is the pointwise mutual information log2(n(t, e) * N / (n(t) * n(e))) and the guess is right
in n(t, e) / n(t) of the cases. Terms above both thresholds are personal data wherever they stand. Counts are of distinct texts, so that a copied text
counts once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._cluster import attach_marks, discard, materialize, maybe_broadcast, seen, ship

KINDS = ("email", "ip", "card", "phone", "term")
_U = np.uint64
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a digit before would only start the same run of digits later, where it fails alike
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")


@dataclass(frozen=True)
class Rules:
    """A term discloses from ``min_texts`` distinct texts with the entity on, at ``min_bits`` and ``min_share`` at least."""

    reach: int = 6
    min_texts: int = 5
    min_bits: float = 6.0
    min_share: float = 0.8
    #: Terms handled in one pass over the texts; more take further passes, up to ``passes``. Beyond that texts and terms are joined.
    terms_a_pass: int = 1_000_000
    passes: int = 4


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Each match's local part is the run before its @, back to the last match; so every @ is looked at once, however long the run."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at)
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans (code points, end exclusive) of e-mail addresses, IP addresses, card and phone numbers."""
    out: list[list[tuple[int, int]]] = [_emails(text), [], [], []]
    for m in _IP.finditer(text):
        if all(len(g) <= 3 and int(g or "0") <= 255 for g in (x.lstrip("0") for x in m.groups())):
            out[1].append(m.span())
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m.group())
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out[2].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m.group())) <= 15:
                out[3].append(m.span())
    return out


_PERSONAL = re.compile(r"[0-9@]")


_LETTER = np.zeros(256, bool)
_LETTER[list(range(97, 123)) + list(range(65, 91)) + list(range(128, 256))] = True


def _terms(data: np.ndarray, offsets: np.ndarray):
    """Runs of letters of three bytes or more: start, end, text, hash (lower case in A-Z)."""
    start, end, first = T.words(data, offsets, _LETTER[data])
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    ok = end - start >= 3
    start, end, doc = start[ok], end[ok], doc[ok]
    return start, end, doc, T.Prefix(data, fold=True).of(start, end)


def _code_points(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def _near(rules: Rules):
    """(entity, term, text) hashes of the terms within reach of a span, once a text; (entity, 0, text) for the entity itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.blocks(batches):
            texts = b.column("text").to_pylist()
            found = [(i, [s for kind in base_spans(t) for s in kind]) for i, t in enumerate(texts) if t and _PERSONAL.search(t)]
            found = [(i, s) for i, s in found if s]
            if not found:
                continue
            picked = [i for i, _ in found]
            data, offsets = T.buffers(b.column("text").take(pa.array(picked)))
            start, end, doc, h = _terms(data, offsets)
            cp = _code_points(data)
            name = T.Prefix(data).of(offsets[:-1], offsets[1:])
            first = np.searchsorted(doc, np.arange(len(picked) + 1))
            out = set()
            for k, (i, spans) in enumerate(found):
                base = cp[offsets[k]]
                s, e, own = cp[start[first[k] : first[k + 1]]] - base, cp[end[first[k] : first[k + 1]]] - base, h[first[k] : first[k + 1]]
                for a, z in spans:
                    entity = T.hash_of(texts[i][a:z].lower())
                    before, after = np.searchsorted(e, a, "right"), np.searchsorted(s, z)
                    out.add((entity, 0, int(name[k])))
                    out.update((entity, int(t), int(name[k])) for t in np.r_[own[max(0, before - rules.reach) : before], own[after : after + rules.reach]])
            columns = np.array(sorted(out), dtype=np.uint64).reshape(-1, 3).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(columns[:, j])) for j in range(3)], ["entity", "term", "name"])

    return run


def _holding(keys: np.ndarray):
    """(term, text) of the terms in ``keys``, once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = T.HashSet(keys)
        for b in T.blocks(batches):
            data, offsets = T.buffers(b.column("text"))
            _, _, doc, h = _terms(data, offsets)
            at = np.flatnonzero(known.find(h) >= 0)
            if len(at):
                docs = np.unique(doc[at])
                name = np.zeros(len(offsets) - 1, _U)
                name[docs] = T.Prefix(data).of(offsets[docs], offsets[docs + 1])
                rows = np.unique(np.stack([h[at], name[doc[at]]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(T.signed(np.ascontiguousarray(rows[:, j]))) for j in range(2)], ["term", "name"])

    return run


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, name) of all terms of the texts, once a text; by ``_name`` where that is given."""
    for b in T.blocks(batches):
        data, offsets = T.buffers(b.column("text"))
        _, _, doc, h = _terms(data, offsets)
        key = T.mix(h ^ T.mix(doc.astype(_U) + _U(7)))
        _, at = np.unique(key, return_index=True)
        if "_name" in b.schema.names:
            name = b.column("_name").take(pa.array(doc[at]))
        else:
            name = pa.array(T.signed(T.Prefix(data).of(offsets[:-1], offsets[1:]))[doc[at]])
        yield pa.RecordBatch.from_arrays([pa.array(T.signed(h[at])), name], ["term", "name"])


def _chunks(terms: DataFrame, rules: Rules) -> Iterator[np.ndarray]:
    """The terms in parts of about ``terms_a_pass``, each small enough to send to all tasks."""
    n = seen(terms)
    rounds = -(-n // rules.terms_a_pass)
    for k in range(rounds):
        part = terms if rounds == 1 else terms.filter(F.pmod(F.xxhash64("term"), F.lit(rounds)) == k)
        yield part.select("term").toArrow().column("term").to_numpy().view(np.uint64)


def disclosing_terms(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(term, bits, share): hashes of the terms that give an entity away, from all texts."""
    texts = docs.select("text")
    near = materialize(texts.mapInArrow(_near(rules), "entity long, term long, name long").distinct(), "near")
    pairs = near.groupBy("entity", "term").agg(F.count("*").alias("n_te"))
    often = materialize(pairs.filter(f"n_te >= {rules.min_texts}"), "often")
    entities = often.filter("term = 0").select("entity", F.col("n_te").alias("n_e"))
    candidates = materialize(often.filter("term <> 0").select("term").distinct(), "candidates")
    held = None
    if seen(candidates) > rules.terms_a_pass * rules.passes:
        held = texts.mapInArrow(_terms_of, "term long, name long")
    else:
        for keys in _chunks(candidates, rules):
            part = texts.mapInArrow(_holding(keys), "term long, name long")
            held = part if held is None else held.unionByName(part)
    if held is None:
        discard(near, often, candidates)
        return docs.sparkSession.createDataFrame([], "term long, bits double, share double")
    totals = held.distinct().groupBy("term").agg(F.count("*").alias("n_t"))
    n = max(1, texts.select(F.xxhash64("text").alias("h")).distinct().count())
    scored = often.filter("term <> 0").join(maybe_broadcast(materialize(totals, "totals")), "term").join(maybe_broadcast(entities), "entity")
    share = F.col("n_te") / F.col("n_t")
    bits = F.log2(share * F.lit(float(n)) / F.col("n_e"))
    out = scored.select("term", bits.alias("bits"), share.alias("share")).filter((F.col("bits") >= rules.min_bits) & (F.col("share") >= rules.min_share))
    out = materialize(out.groupBy("term").agg(F.max("bits").alias("bits"), F.max("share").alias("share")), "disclosing")
    discard(near, often, candidates)
    return out


def _format(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, found in zip(KINDS, spans) for a, z in found)


def _term_spans(column: pa.Array, known: T.HashSet, lists: pa.Array | None = None) -> dict[int, list[tuple[int, int]]]:
    """Code point spans of the known terms, or of those in the rows' own lists, by row."""
    data, offsets = T.buffers(column)
    start, end, doc, h = _terms(data, offsets)
    at = np.flatnonzero(known.find(h) >= 0 if lists is None else T.in_lists(h, doc, lists))
    out: dict[int, list[tuple[int, int]]] = {}
    if len(at):
        cp = _code_points(data)
        base = cp[offsets[doc[at]]]
        for d, s, e in zip(doc[at].tolist(), (cp[start[at]] - base).tolist(), (cp[end[at]] - base).tolist()):
            out.setdefault(d, []).append((s, e))
    return out


def _mark(keys: np.ndarray):
    """A pass for terms that are too many for one: appends their starts and ends to ``_marked``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = T.HashSet(keys)
        for b in T.blocks(batches):
            found = _term_spans(b.column("text"), known)
            marked = [(m or []) + [x for s in found.get(i, []) for x in s] for i, m in enumerate(b.column("_marked").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(marked, pa.list_(pa.int64()))], ["doc_id", "text", "_marked"])

    return run


def _find(keys: np.ndarray, replace: dict[str, str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = T.HashSet(keys)
        for b in T.blocks(batches):
            texts = b.column("text").to_pylist()
            lists = b.column("_bad") if "_bad" in b.schema.names else None
            terms = _term_spans(b.column("text"), known, lists) if len(known) or lists is not None else {}
            marked = b.column("_marked").to_pylist() if "_marked" in b.schema.names else None
            rows = []
            for i, t in enumerate(texts):
                spans = base_spans(t) if t and _PERSONAL.search(t) else [[], [], [], []]
                found = terms.get(i, [])
                if marked and marked[i]:
                    found = sorted({*found, *zip(marked[i][::2], marked[i][1::2])})
                covered = sorted(s for kind in spans for s in kind)
                # a term inside a pattern's span is covered by it
                extra = [s for s in found if not any(a < s[1] and s[0] < z for a, z in covered)] if covered else found
                rows.append((spans, extra))
            base = [_format(s) for s, _ in rows]
            columns = [b.column("doc_id")] + [pa.array([len(s[k]) for s, _ in rows], pa.int64()) for k in range(4)]
            columns += [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base], pa.string()), pa.array([_format([*s, x]) for s, x in rows], pa.string())]
            names = ["doc_id", *(f"n_{k}" for k in KINDS[:4]), "base_sha256", "spans"]
            if replace is not None:
                columns.append(pa.array([t if t is None else redact(t, [*s, x], replace) for t, (s, x) in zip(texts, rows)], pa.string()))
                names.append("clean_text")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def redact(text: str, spans: list[list[tuple[int, int]]], replace: dict[str, str]) -> str:
    """``text`` with each span generalised to its kind's replacement; of overlapping spans the earliest, longest one."""
    out, done = [], 0
    for a, z, kind in sorted(((a, z, k) for k, found in zip(KINDS, spans) for a, z in found), key=lambda x: (x[0], -x[1])):
        if a >= done:
            out += [text[done:a], replace.get(kind, "")]
            done = z
    return "".join(out) + text[done:]


GENERALISED = {"email": "<email>", "ip": "<ip>", "card": "<card>", "phone": "<phone>", "term": "<name>"}


def find_personal_data(docs: DataFrame, rules: Rules = Rules(), replace: dict[str, str] | None = None) -> DataFrame:
    """For each row of ``docs(doc_id, text)``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, and clean_text if ``replace`` is given.

    Kinds without a replacement are removed from clean_text. A null text counts as empty and stays null; repeated rows get the same; a null
    doc_id stays null; other columns are not looked at; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    last = np.zeros(0, np.uint64)
    found = disclosing_terms(docs, rules)
    many = seen(found) > rules.terms_a_pass * rules.passes
    if many:
        docs = docs.withColumn("_name", F.xxhash64("text"))
        pairs = docs.select("text", "_name").mapInArrow(_terms_of, "term long, name long").distinct()
        marks = pairs.join(maybe_broadcast(found), "term", "left_semi").select("name", F.col("term").alias("mark"))
        docs = attach_marks(docs, marks, "doc_id").drop("_name")
    for k, keys in enumerate([] if many else _chunks(found, rules)):
        if k == 1:
            docs = docs.withColumn("_marked", F.lit(None).cast("array<long>"))
        if k:
            docs = docs.mapInArrow(_mark(last), "doc_id long, text string, _marked array<long>")
        last = keys
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string" + (", clean_text string" if replace is not None else "")
    return docs.mapInArrow(_find(last, replace), schema)
