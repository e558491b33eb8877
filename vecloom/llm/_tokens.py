"""Token ids of whole texts by a vocabulary file of the tokenizers library, through a cache of words.

A text is cut where the vocabulary's own pre-tokenizer always cuts, before white space, so that the ids of the pieces, joined, are the ids
of the text. Pieces are found and hashed for a whole block of texts at once; those seen before come from a bounded table of hash and length to
ids, in numpy; only new ones go through the library's merges.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from . import _text as T

#: Pieces kept by each Python worker, with their ids about 30 MB; a full table is emptied. Longer pieces are not kept.
TABLE_PIECES, TABLE_SLOTS, PIECE_BYTES = 650_000, 1 << 20, 64
_coders: dict[str, Coder] = {}


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Coder:
    """``ids(text)``: little-endian unsigned 32-bit ids, or 16-bit (``dtype``) if the vocabulary is small enough."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        pre = self.tokenizer.pre_tokenizer
        if pre.__class__.__name__ == "ByteLevel" and self.tokenizer.normalizer is None:
            self.kind, self.mark = "byte", "\n"  # white space is kept, one space with the word after it
        elif "Removed" in str(pre):
            self.kind, self.mark = "word", " ~ "  # white space is dropped
        else:
            self.kind, self.mark = "", ""
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        ids = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        self.mark_id = ids[0] if len(ids) == 1 else None
        self.unmarked = self.mark.strip() or self.mark
        self._clear()

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece. Pieces go through the library together, with a mark between that no piece has and that is always one id."""
        if self.mark_id is None:
            return self._encode(pieces)
        apart = [i for i, p in enumerate(pieces) if self.unmarked in p or p.isspace()]
        if apart:
            out: list = [None] * len(pieces)
            for i, e in zip(apart, self._encode([pieces[i] for i in apart])):
                out[i] = e
            rest = [i for i, e in enumerate(out) if e is None]
            for i, e in zip(rest, self._encode_pieces([pieces[i] for i in rest]) if rest else []):
                out[i] = e
            return out
        text = self.mark.join(pieces)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
        cuts = np.flatnonzero(ids == self.mark_id)
        if len(cuts) != len(pieces) - 1:
            return self._encode(pieces)
        width, raw = self.dtype.itemsize, ids.tobytes()
        begin = [0, *((cuts + 1) * width).tolist()]
        end = [*(cuts * width).tolist(), len(raw)]
        return [raw[a:z] for a, z in zip(begin, end)]

    def _clear(self) -> None:
        self.keys, self.entry = np.zeros(TABLE_SLOTS, np.uint64), np.full(TABLE_SLOTS, -1, np.int32)
        self.at, self.n = np.zeros(1024, np.int64), 0  # entry k has the ids pool[at[k]:at[k + 1]]
        self.pool, self.used = np.zeros(1 << 16, self.dtype), 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each key, or -1."""
        slot = (h & np.uint64(TABLE_SLOTS - 1)).astype(np.int64)
        out = self.entry[slot]
        left = np.flatnonzero((self.keys[slot] != h) & (out >= 0))  # met another key: look on from there
        out[left] = -1
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & (TABLE_SLOTS - 1)
            e = self.entry[slot]
            same = (e >= 0) & (self.keys[slot] == h[left])
            out[left[same]] = e[same]
            on = (e >= 0) & ~same
            left, slot = left[on], slot[on]
        return out

    def _insert(self, h: np.ndarray, entry: np.ndarray) -> None:
        """Distinct keys that the table doesn't have."""
        slot = (h & np.uint64(TABLE_SLOTS - 1)).astype(np.int64)
        while len(h):
            _, first = np.unique(slot, return_index=True)
            free = first[self.entry[slot[first]] < 0]
            self.keys[slot[free]], self.entry[slot[free]] = h[free], entry[free]
            left = np.ones(len(h), bool)
            left[free] = False
            h, entry, slot = h[left], entry[left], (slot[left] + 1) & (TABLE_SLOTS - 1)

    def _append(self, pieces: list[bytes]) -> np.ndarray:
        """New entries with the ids given as bytes."""
        sizes = np.array([len(p) for p in pieces], np.int64) // self.dtype.itemsize
        flat = np.frombuffer(b"".join(pieces), self.dtype)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.n + len(pieces) + 1 >= len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.pool[self.used : self.used + len(flat)] = flat
        entry = np.arange(self.n, self.n + len(pieces), dtype=np.int32)
        self.at[self.n + 1 : self.n + 1 + len(pieces)] = self.used + np.cumsum(sizes)
        self.n, self.used = self.n + len(pieces), self.used + len(flat)
        return entry

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, first piece of each text with the number of pieces last)."""
        start, end, first = T.words(data, offsets)
        if self.kind == "word":
            return start, end, first
        n = len(offsets) - 1
        doc = np.repeat(np.arange(n), np.diff(first))
        before = np.empty(len(start), np.int64)  # where the white space before a word begins
        before[1:] = end[:-1]
        some = np.flatnonzero(np.diff(first))
        before[first[some]] = offsets[some]
        gap = start - before
        space = (gap > 0) & (data[np.maximum(start - 1, 0)] == 32)
        # white space before a word: all of it but the last character is a piece; the last one is a piece too, unless it is a space, which the word takes
        long, single = gap > 1, (gap > 0) & ~space
        tail = offsets[:-1].copy()
        tail[some] = end[first[some + 1] - 1]
        trailing = tail < offsets[1:]
        ahead = long.astype(np.int64) + single
        place = np.arange(len(start)) + np.cumsum(ahead) + (np.cumsum(trailing) - trailing)[doc]
        total = len(start) + int(ahead.sum() + trailing.sum())
        s, e = np.empty(total, np.int64), np.empty(total, np.int64)
        s[place], e[place] = start - space, end
        at = place[single] - 1
        s[at], e[at] = start[single] - 1, start[single]
        at = (place - single - 1)[long]
        s[at], e[at] = before[long], start[long] - 1
        count = np.bincount(doc, 1 + ahead, n).astype(np.int64) + trailing
        bounds = np.zeros(n + 1, np.int64)
        np.cumsum(count, out=bounds[1:])
        at = (bounds[1:] - 1)[trailing]
        s[at], e[at] = tail[trailing], offsets[1:][trailing]
        return s, e, bounds

    def _odd(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts with white space beyond ASCII or with a special token's string: these go to the library whole."""
        out = np.zeros(len(offsets) - 1, bool)
        if len(data) > 1:
            lead = np.flatnonzero(_LEAD[data[:-1]])
            a, b = data[lead], data[lead + 1]
            c = data[np.minimum(lead + 2, len(data) - 1)]
            hit = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
            hit |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
            out[np.searchsorted(offsets, lead[hit], "right") - 1] = True
        raw = None
        for s in self.special:
            raw = data.tobytes() if raw is None else raw
            at = raw.find(s)
            while at >= 0:
                out[np.searchsorted(offsets, at, "right") - 1] = True
                at = raw.find(s, at + 1)
        return out

    def encode_block(self, column: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds by text), each text's ids with ``end_id`` after them if given. A null text is empty."""
        tail = b"" if end_id is None else np.array([end_id], self.dtype).tobytes()
        data, offsets = T.buffers(column)
        n = len(offsets) - 1
        odd = self._odd(data, offsets) if self.kind else np.ones(n, bool)
        if odd.any():
            texts = [t or "" for t in column.to_pylist()]
            whole = dict(zip(np.flatnonzero(odd).tolist(), self._encode([texts[i] for i in np.flatnonzero(odd)])))
            rest, bounds = self.encode_block(column.filter(pa.array(~odd)), end_id) if not odd.all() else (np.zeros(0, self.dtype), np.zeros(1, np.int64))
            parts, k = [], 0
            for i in range(n):
                if odd[i]:
                    parts.append(np.frombuffer(whole[i] + tail, self.dtype))
                else:
                    parts.append(rest[bounds[k] : bounds[k + 1]])
                    k += 1
            out = np.zeros(n + 1, np.int64)
            np.cumsum([len(p) for p in parts], out=out[1:])
            return np.concatenate(parts), out
        if self.n > TABLE_PIECES:
            self._clear()
        start, end, first = self._pieces(data, offsets)
        h = T.mix(T.Prefix(data).of(start, end) + (end - start).astype(np.uint64))
        entry = self._find(h)
        missing = np.flatnonzero(entry < 0)
        kept, kept_used = self.n, self.used
        if len(missing):
            new, at, back = np.unique(h[missing], return_index=True, return_inverse=True)
            at = missing[at]
            raw = data.tobytes()
            texts = [raw[a:z].decode() for a, z in zip(start[at].tolist(), end[at].tolist())]
            short = end[at] - start[at] <= PIECE_BYTES
            order = np.argsort(~short, kind="stable")  # those to keep first
            made: list[bytes] = []
            for k in range(0, len(order), 2048):
                made += self._encode_pieces([texts[i] for i in order[k : k + 2048].tolist()])
            e = np.empty(len(new), np.int32)
            e[order] = self._append(made)
            entry[missing] = e[back]
            n_short = int(short.sum())
            self._insert(new[short], e[short])
            kept, kept_used = kept + n_short, int(self.at[kept + n_short])
        if end_id is not None:  # one more piece after each text
            stop = self._append([tail])[0]
            entry = np.insert(entry, first[1:], stop)
            first = first + np.arange(len(first))
        begin, size = self.at[entry], self.at[entry + 1] - self.at[entry]
        total = np.zeros(len(entry) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        ids = self.pool[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
        self.n, self.used = kept, kept_used
        return ids, total[first]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes of ``dtype``."""
        if not texts:
            return []
        ids, bounds = self.encode_block(pa.array(texts, pa.string()))
        return [ids[a:z].tobytes() for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def coder(path: str) -> Coder:
    """The worker's coder for a vocabulary file, kept from task to task."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]
