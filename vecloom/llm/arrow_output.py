"""Token ids in Arrow files: record batches of fixed-size lists, read by memory map without a copy.

Each file holds one range of doc_ids: its ids as equal-length sequences ``ids`` (fixed_size_list, unsigned integers of the least width the
vocabulary allows) with ``mask`` (fixed_size_list of bool, false on the padding of the file's last sequence). Beside it lies an index file
with (doc_id, start, n_tokens), start counted within the file. Ids from the n-th on are at sequence n // length, so any run of ids is
reached by arithmetic. A file's first id in the whole order is the sum of the ids of the files before it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _text as T
from ._cluster import fresh_path, materialize, ship
from ._tokens import coder, vocabulary

END_ID, SEQUENCE, BATCH = 2, 1024, 256
#: Documents in a file, about, where the session's shuffle partitions are fewer than that needs.
FILE_DOCS = 50_000
_MANIFEST = "part long, path string, docs long, tokens long"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def sequence_schema(length: int, dtype: np.dtype) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])


def sequence_batch(ids: np.ndarray, length: int, dtype: np.dtype) -> pa.RecordBatch:
    """A batch of the ids, the last sequence padded with 0 under a false mask."""
    rows = -(-len(ids) // length)
    full = np.zeros(rows * length, dtype)
    full[: len(ids)] = ids
    mask = np.zeros(rows * length, bool)
    mask[: len(ids)] = True
    schema = sequence_schema(length, dtype)
    return pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(full), length), pa.FixedSizeListArray.from_arrays(pa.array(mask), length)], schema=schema)


def _write(root: str, tokenizer: str, end_id: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(tokenizer)
        task = TaskContext.get()
        part = task.partitionId()
        system, folder = _open(root)
        system.create_dir(folder, recursive=True)
        name = f"{folder}/part-{part:06d}"
        attempt = f"{name}.{task.taskAttemptId()}"
        schema = sequence_schema(length, c.dtype)
        held, index, total = b"", [], 0
        step = BATCH * length * c.dtype.itemsize
        with system.open_output_stream(f"{attempt}.arrow") as sink, pa.ipc.new_file(sink, schema) as out:
            for b in T.blocks(batches):
                ids, bounds = c.encode_block(b.column("text"), end_id)
                n = np.diff(bounds)
                start = total + np.cumsum(n) - n
                total += int(n.sum())
                index.append(pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(start), pa.array(n)], ["doc_id", "start", "n_tokens"]))
                held += ids.tobytes()
                at = 0
                while len(held) - at >= step:
                    out.write_batch(sequence_batch(np.frombuffer(held, c.dtype, BATCH * length, at), length, c.dtype))
                    at += step
                held = held[at:]
            if held:
                out.write_batch(sequence_batch(np.frombuffer(held, c.dtype), length, c.dtype))
        fields = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        with system.open_output_stream(f"{attempt}.index") as sink, pa.ipc.new_file(sink, fields) as out:
            for r in index:
                out.write_batch(r)
        # contents depend on the partition alone, so whichever attempt moves last leaves the same files
        system.move(f"{attempt}.arrow", f"{name}.arrow")
        system.move(f"{attempt}.index", f"{name}.index")
        docs = sum(r.num_rows for r in index)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([f"{root}/part-{part:06d}"]), pa.array([docs], pa.int64()), pa.array([total], pa.int64())], ["part", "path", "docs", "tokens"])

    return run


def write_sequences(docs: DataFrame, root: str, tokenizer: str | None = None, end_id: int = END_ID, length: int = SEQUENCE) -> DataFrame:
    """Write ``docs(doc_id, text)`` in ascending doc_id order (null first, then by text where ids repeat); gives the manifest.

    The manifest has (part, path, docs, tokens, first_token), a row a file. A null text is empty: its end id alone. An empty table gives
    files without sequences, or none. Other columns are not written.
    """
    if length % 8:
        raise ValueError("the length of a sequence must be a multiple of 8")
    spark = docs.sparkSession
    ship(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // FILE_DOCS))
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    made = materialize(ordered.mapInArrow(_write(root, tokenizer or vocabulary("word_bpe_49k.json"), end_id, length), _MANIFEST), "manifest")
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens")
    return made.withColumn("first_token", before)


class Sequences:
    """Random access to one file: ``ids(start, n)`` are views of the mapped file where they lie in one batch."""

    def __init__(self, path: str):
        system, where = _open(path)
        local = isinstance(system, fs.LocalFileSystem)
        source = pa.memory_map(f"{where}.arrow") if local else system.open_input_file(f"{where}.arrow")
        self.file = pa.ipc.open_file(source)
        index = pa.memory_map(f"{where}.index") if local else system.open_input_file(f"{where}.index")
        self.index = pa.ipc.open_file(index).read_all()
        self.length = self.file.schema.field("ids").type.list_size
        self._at, self._flat = -1, None

    def _batch(self, k: int) -> np.ndarray:
        if k != self._at:
            self._at, self._flat = k, self.file.get_batch(k).column("ids").flatten().to_numpy(zero_copy_only=True)
        return self._flat

    def mask_bits(self, k: int) -> np.ndarray:
        """The mask of sequence k as the file has it, a view: eight places a byte, the first in the lowest bit. Needs a length that eight divides."""
        mask = self.file.get_batch(k // BATCH).column("mask").flatten()
        at = mask.offset + (k % BATCH) * self.length
        return np.frombuffer(mask.buffers()[1], np.uint8)[at // 8 : (at + self.length) // 8]

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of sequence k, a view, and its mask, unpacked."""
        at = (k % BATCH) * self.length
        return self._batch(k // BATCH)[at : at + self.length], np.unpackbits(self.mask_bits(k), bitorder="little").astype(bool)

    def ids(self, start: int, n: int) -> np.ndarray:
        step, out = BATCH * self.length, []
        while n:
            k, at = divmod(start, step)
            piece = self._batch(k)[at : at + n]
            out.append(piece)
            start, n = start + len(piece), n - len(piece)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint16)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, first in zip(b.column("path").to_pylist(), b.column("first_token").to_pylist()):
            s = Sequences(path)
            start, n = (s.index.column(k).to_numpy() for k in ("start", "n_tokens"))
            crc = [zlib.crc32(s.ids(a, k).astype("<u4").tobytes()) for a, k in zip(start.tolist(), n.tolist())]
            table = pa.table({"doc_id": s.index.column("doc_id"), "start": start + first, "n_tokens": n, "ids_crc32": pa.array(crc, pa.int64())})
            yield from table.combine_chunks().to_batches(max_chunksize=50_000)


def read_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files that the manifest lists; none for an empty manifest.

    Null and repeated doc_ids are given as they were written.
    """
    files = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "first_token", "part").repartition(files, "part").select("path", "first_token").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the documents to the shared folder and read them back: nulls, repeats, empty tables and other columns as in :func:`write_sequences`."""
    spark: SparkSession = docs.sparkSession
    return read_documents(write_sequences(docs, fresh_path(spark, "sequences"), tokenizer))
