"""Packing by power-of-two decomposition: each document is split into pieces of binary lengths, and equal lengths are bucketed.

A document of n ids gives n // max_len pieces of max_len, then one piece for each binary digit of the rest, longest first. Every piece is
a sequence of its own, so no sequence crosses documents and none needs padding; batches are formed within a bucket of equal lengths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._cluster import ship
from ._tokens import coder, vocabulary

MAX_LEN, END_ID = 1024, 0
#: A sequence_id has six bits for the length's exponent and 33 for the place in its task.
_BUCKET_BITS, _SLOT_BITS = 6, 33


def binary_pieces(n: np.ndarray, max_len: int = MAX_LEN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces of documents of ``n`` ids each, in order."""
    bits = max_len.bit_length() - 1
    whole = n >> bits
    digits = (n[:, None] >> np.arange(bits - 1, -1, -1)) & 1
    count = whole + digits.sum(axis=1)
    doc = np.repeat(np.arange(len(n)), count)
    length = np.full(len(doc), max_len, np.int64)
    d, k = np.nonzero(digits)
    ends = np.cumsum(count)
    at = (np.cumsum(digits, axis=1) - 1)[d, k] + (ends - count + whole)[d]
    length[at] = 1 << (bits - 1 - k)
    total = np.cumsum(length) - length
    base = np.cumsum(n) - n
    return doc, total - base[doc], length


def _run(path: str, end_id: int, max_len: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        part = TaskContext.get().partitionId()
        used = np.zeros(64, np.int64)
        for b in T.blocks(batches):
            flat, bounds = c.encode_block(b.column("text"), end_id)
            flat, n = flat.astype("<u4"), np.diff(bounds)
            doc, start, length = binary_pieces(n, max_len)
            raw = memoryview(flat).cast("B")
            ends = (4 * np.cumsum(length)).tolist()
            crc = [zlib.crc32(raw[a:z]) for a, z in zip([0, *ends[:-1]], ends)]
            bucket = np.log2(length).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            sizes = np.bincount(bucket, minlength=64)
            rank = np.empty(len(bucket), np.int64)
            rank[order] = np.arange(len(bucket)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            slot = used[bucket] + rank
            used += sizes
            sequence = (part << _SLOT_BITS + _BUCKET_BITS) | (slot << _BUCKET_BITS) | bucket
            columns = [b.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[doc])]
            columns += [pa.array(sequence), pa.array(np.zeros(len(doc), np.int64)), pa.array(bucket.astype(np.int32))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"]
            if with_ids:
                bounds = np.zeros(len(doc) + 1, np.int32)
                np.cumsum(length, out=bounds[1:])
                columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, max_len: int = MAX_LEN, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (0, as each piece is a sequence), bucket, and ids if asked.

    A sequence_id is its task, its place among the task's pieces of this length, and the length's exponent in the last six bits; so it is unique without any
    exchange between tasks, and one pass over the texts makes everything. A null or empty text is the end id alone. Null and repeated doc_ids,
    and any other columns, don't matter; an empty table has no pieces.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    ship(docs.sparkSession)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_run(tokenizer or vocabulary("byte_bpe_50k.json"), end_id, max_len, with_ids), schema)
