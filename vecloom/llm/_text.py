"""Vectorised text kernels over Arrow string buffers: words, lines, and rolling hashes without a Python loop over words.

A short substring's hash is taken from prefix sums of a polynomial in a fixed odd multiplier modulo 2**64, with a random 64-bit value for each
byte, then mixed; so a word costs two lookups. Such polynomials have collisions that can be written down for every multiplier (Thue-Morse
words) once a substring is long, so one of more than ``DIRECT`` bytes is hashed by itself with BLAKE2b.
"""

from __future__ import annotations

import ctypes
from hashlib import blake2b
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):
    _libc = None

U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)
_rng = np.random.default_rng(20_011)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
#: The white space of the contracts: [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_pow = _ipow = np.ones(1, U64)

#: Text bytes handled at once.
BLOCK = 1 << 18
#: Longest run of bytes, or of word hashes, that is hashed by prefix sums.
DIRECT = 32
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _ipow
    if len(_pow) < n:
        size = max(n, BLOCK + 4096)
        out = []
        for m in (_MULT, _INV):
            p = np.full(size, m, U64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if size > 8 * BLOCK:  # one very long text: don't keep tables of its size
            return out[0], out[1]
        _pow, _ipow = out
    return _pow, _ipow


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(29))
    h = h * U64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> U64(32))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & ((1 << 64) - 1)], U64))[0])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string column; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def release() -> None:
    """Give memory freed in this worker back to the system: workers outlive their tasks, beside those of other stages and the executor's heap."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of at most ``limit`` text bytes, or of one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(np.asarray(sizes, np.int64))
        at = 0
        while at < n:
            done = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            stop = min(stop, at + 8192)
            yield batch.slice(at, stop - at)
            at = stop
    release()


def _direct(h: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """``h`` with the places whose range of ``data`` is long filled by BLAKE2b."""
    long = np.flatnonzero(end - start > DIRECT)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data)).cast("B")
        width = data.dtype.itemsize
        h[long] = np.frombuffer(b"".join([blake2b(raw[a:z], digest_size=8).digest() for a, z in zip((start[long] * width).tolist(), (end[long] * width).tolist())]), U64)
    return h


class Prefix:
    """Prefix sums over a block's bytes; ``of(start, end)`` hashes the byte ranges."""

    def __init__(self, data: np.ndarray, fold: bool = False):
        n = len(data)
        self.data, self.fold = data, fold
        p, self.inv = _powers(n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum((_FOLDED if fold else _BYTE)[data] * p[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = mix((self.sums[end] - self.sums[start]) * self.inv[start])
        if self.fold and len(h) and int((end - start).max()) > DIRECT:
            self.data, self.fold = _LOWER[self.data], False  # the sums are made, so the bytes are only for long ranges from here on
        return _direct(h, self.data, start, end)


def hash_of(text: str, fold: bool = False) -> int:
    """The hash that :class:`Prefix` gives the whole of ``text``."""
    raw = np.frombuffer(text.encode(), np.uint8)
    return int(Prefix(raw, fold).of(np.array([0]), np.array([len(raw)]))[0])


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each document with the number of words last) of runs of non-space bytes, or of bytes that are ``inside``."""
    w = ~SPACE[data] if inside is None else inside
    n = len(w)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before = np.empty(n, bool)
    before[1:] = w[:-1]
    edge = offsets[:-1][offsets[:-1] < n]
    before[edge] = False
    after = np.empty(n, bool)
    after[:-1] = w[1:]
    after[n - 1] = False
    after[edge[edge > 0] - 1] = False
    start = np.flatnonzero(w & ~before)
    return start, np.flatnonzero(w & ~after) + 1, np.searchsorted(start, offsets)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first line of each document with the number of lines last) of \\n-split lines; an empty text has one empty line."""
    cut = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], cut + 1]), kind="stable")
    doc_of_cut = np.searchsorted(offsets, cut, "right") - 1
    count = np.bincount(doc_of_cut, minlength=len(offsets) - 1) + 1
    first = np.zeros(len(offsets), np.int64)
    np.cumsum(count, out=first[1:])
    # within a document: its start, then one line after each of its cuts
    start = np.empty(len(starts), np.int64)
    start[first[:-1]] = offsets[:-1]
    rest = np.ones(len(starts), bool)
    rest[first[:-1]] = False
    start[rest] = cut + 1
    end = np.empty(len(starts), np.int64)
    end[:-1] = start[1:] - 1
    last = first[1:] - 1
    end[last] = offsets[1:]
    return start, end, first


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over [bounds[i], bounds[i + 1])."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def sequence_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run h[start:end] of word hashes, in order."""
    p, inv = _powers(len(h) + 1)
    total = np.zeros(len(h) + 1, U64)
    np.cumsum(h * p[: len(h)], out=total[1:])
    return _direct(mix((total[end] - total[start]) * inv[start]), h, start, end)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


class HashSet:
    """Membership of 64-bit hashes: a bitmap of 2**20 places first, then binary search."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys.astype(U64))
        self.map = np.zeros(1 << 20, bool)
        self.map[(self.keys & U64((1 << 20) - 1)).astype(np.int64)] = True

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash in ``keys``, or -1."""
        out = np.full(len(h), -1, np.int64)
        if not len(self.keys):
            return out
        maybe = np.flatnonzero(self.map[(h & U64((1 << 20) - 1)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
            hit = self.keys[at] == h[maybe]
            out[maybe[hit]] = at[hit]
        return out


def in_lists(keys: np.ndarray, doc: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether each key is in its document's list of signed 64-bit hashes; a null list is empty."""
    size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
    held = np.asarray(lists.flatten(), np.int64).view(U64)
    of = mix(np.repeat(np.arange(len(size)), size).astype(U64) + U64(7))
    return np.isin(mix(keys ^ mix(doc.astype(U64) + U64(7))), mix(held ^ of))
