"""GGUF model files as a Spark data source: ``format("gguf")`` with option ``mode`` fields or tensors.

The layout is the public one: magic, version 3 (or 2), numbers of tensors and of key/value fields, fields, tensor descriptions, then data
from the next multiple of the alignment. A tensor's dimensions are stored fastest first; ``shape`` has them slowest first.
"""

from __future__ import annotations

import fnmatch
import os
import struct
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCALARS = {0: ("UINT8", "B"), 1: ("INT8", "b"), 2: ("UINT16", "H"), 3: ("INT16", "h"), 4: ("UINT32", "I"), 5: ("INT32", "i"), 6: ("FLOAT32", "f"), 7: ("BOOL", "?"), 10: ("UINT64", "Q"), 11: ("INT64", "q"), 12: ("FLOAT64", "d")}
STRING, ARRAY = 8, 9
#: Tensor types whose values are read: (name, numpy type); others have null data.
TENSORS = {0: ("F32", "<f4"), 1: ("F16", "<f2"), 24: ("I8", "<i1"), 25: ("I16", "<i2"), 26: ("I32", "<i4"), 27: ("I64", "<i8"), 28: ("F64", "<f8")}
QUANTIZED = {2: "Q4_0", 3: "Q4_1", 6: "Q5_0", 7: "Q5_1", 8: "Q8_0", 9: "Q8_1", 10: "Q2_K", 11: "Q3_K", 12: "Q4_K", 13: "Q5_K", 14: "Q6_K", 15: "Q8_K", 30: "BF16"}
#: Integers of 64 bits don't fit into doubles, nor unsigned ones into longs, so whole numbers are there as decimals too.
FIELD_SCHEMA = "path string, key string, type string, array_type string, length long, num double, whole decimal(20,0), str string, nums array<double>, wholes array<decimal(20,0)>, strs array<string>"
TENSOR_SCHEMA = "path string, name string, type string, shape array<long>, n_elements long, data array<double>, whole array<long>"
_WHOLE = frozenset(k for k, (name, _) in SCALARS.items() if "INT" in name)


class _Cursor:
    def __init__(self, handle):
        self.handle = handle

    def take(self, code: str):
        size = struct.calcsize("<" + code)
        return struct.unpack("<" + code, self.handle.read(size))[0]

    def text(self) -> str:
        return self.handle.read(self.take("Q")).decode("utf-8", "replace")

    def value(self, kind: int):
        """(value, array's type or None)."""
        if kind == STRING:
            return self.text(), None
        if kind == ARRAY:
            inner, n = self.take("I"), self.take("Q")
            if inner == ARRAY:
                raise ValueError("nested arrays are not supported")
            if inner == STRING:
                return [self.text() for _ in range(n)], inner
            return [self.value(inner)[0] for _ in range(n)], inner
        return self.take(SCALARS[kind][1]), None


def type_name(kind: int) -> str:
    return {STRING: "STRING", ARRAY: "ARRAY"}.get(kind) or SCALARS[kind][0]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:")))


def _list(path: str) -> list[str]:
    """The .gguf files of a folder on any file system, or the one file; patterns (*, ?) in the last part of the path are matched."""
    system, where = _open(path)
    folder, _, last = where.rstrip("/").rpartition("/")
    about = system.get_file_info(where)
    if about.type == fs.FileType.File:
        return [path]
    root, pattern = (where, "*.gguf") if about.type == fs.FileType.Directory else (folder, last)
    found = system.get_file_info(fs.FileSelector(root or "/", allow_not_found=True))
    head = path[: len(path.rstrip("/")) - len(where.rstrip("/"))] if path.rstrip("/").endswith(where.rstrip("/")) else ""
    return [head + f.path for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern)]


def parse(path: str, with_data: bool) -> tuple[list[tuple], list[tuple]]:
    """(fields, tensors) as rows of the two schemas."""
    system, where = _open(path)
    with system.open_input_file(where) as handle:
        c = _Cursor(handle)
        if handle.read(4) != b"GGUF":
            raise ValueError(f"{path} is not a GGUF file")
        version, n_tensors, n_fields = c.take("I"), c.take("Q"), c.take("Q")
        if version not in (2, 3):
            raise ValueError(f"GGUF version {version} is not supported")
        fields, align = [], 32
        for _ in range(n_fields):
            key, kind = c.text(), c.take("I")
            v, inner = c.value(kind)
            if key == "general.alignment":
                align = int(v)
            num, whole = float(v) if kind in SCALARS else None, Decimal(v) if kind in _WHOLE else None
            nums, wholes = ([float(x) for x in v] if kind == ARRAY and inner != STRING else None), ([Decimal(x) for x in v] if inner in _WHOLE else None)
            fields.append((path, key, type_name(kind), None if inner is None else type_name(inner), len(v) if kind == ARRAY else None, num, whole, v if kind == STRING else None, nums, wholes, v if inner == STRING else None))
        found = []
        for _ in range(n_tensors):
            name, n = c.text(), c.take("I")
            shape = [c.take("Q") for _ in range(n)][::-1]
            found.append((name, shape, c.take("I"), c.take("Q")))
        base = -(-handle.tell() // align) * align
        tensors = []
        for name, shape, kind, offset in found:
            data, whole, count = None, None, int(np.prod(shape)) if shape else 1
            if with_data and kind in TENSORS:
                handle.seek(base + offset)
                kind_np = np.dtype(TENSORS[kind][1])
                values = np.frombuffer(handle.read(count * kind_np.itemsize), kind_np)
                data, whole = values.astype(float).tolist(), values.astype(np.int64).tolist() if kind_np.kind == "i" else None
            tensors.append((path, name, TENSORS[kind][0] if kind in TENSORS else QUANTIZED.get(kind, f"TYPE_{kind}"), [int(x) for x in shape], count, data, whole))
    return fields, tensors


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.mode = options.get("mode", "fields")
        self.data = options.get("data", "true").lower() == "true"
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        return [_Part(f) for f in _list(self.path)] or [_Part("")]

    def read(self, partition) -> Iterator[tuple]:
        if partition.path:
            fields, tensors = parse(partition.path, self.data and self.mode == "tensors")
            yield from fields if self.mode == "fields" else tensors


class GgufSource(DataSource):
    """A file a task; ``data=false`` leaves tensors' values out."""

    @classmethod
    def name(cls) -> str:
        return "gguf"

    def schema(self) -> str:
        return FIELD_SCHEMA if self.options.get("mode", "fields") == "fields" else TENSOR_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_gguf(spark: SparkSession, path: str, mode: str = "fields", data: bool = True) -> DataFrame:
    from ..plans.shared import ship

    ship(spark)
    spark.dataSource.register(GgufSource)
    return spark.read.format("gguf").option("mode", mode).option("data", str(data).lower()).load(path)


def describe(fields: DataFrame) -> DataFrame:
    """(path, line): ``key = value`` or ``key = n x <type>``, keys padded to the longest."""
    value = F.when(F.col("type") == "ARRAY", F.format_string("%d x <%s>", "length", "array_type")).when(F.col("type") == "STRING", F.col("str")).otherwise(F.coalesce(F.col("whole").cast("string"), F.when(F.col("type") == "BOOL", (F.col("num") > 0).cast("string")), F.regexp_replace(F.col("num").cast("string"), r"\.0$", "")))
    widest = fields.groupBy("path").agg(F.max(F.length("key")).cast("int").alias("_w"))
    return fields.join(F.broadcast(widest), "path").select("path", F.concat(F.expr("rpad(key, _w, ' ')"), F.lit(" = "), value).alias("line"))


def write_gguf(path: str, fields: list[tuple[str, int, object]], tensors: list[tuple[str, np.ndarray]], align: int = 32) -> None:
    """A small GGUF file, at a path or URI, for tests and examples. An array field is (key, 9, (inner type, values))."""
    text = lambda s: struct.pack("<Q", len(s.encode())) + s.encode()

    def value(kind: int, v) -> bytes:
        if kind == STRING:
            return text(v)
        if kind == ARRAY:
            inner, items = v
            return struct.pack("<IQ", inner, len(items)) + b"".join(value(inner, x) for x in items)
        return struct.pack("<" + SCALARS[kind][1], v)

    codes = {np.dtype(t).str: k for k, (_, t) in TENSORS.items()}
    head = b"GGUF" + struct.pack("<IQQ", 3, len(tensors), len(fields))
    head += b"".join(text(k) + struct.pack("<I", kind) + value(kind, v) for k, kind, v in fields)
    offset, body = 0, b""
    for name, a in tensors:
        raw = np.ascontiguousarray(a).tobytes()
        head += text(name) + struct.pack("<I", a.ndim) + b"".join(struct.pack("<Q", n) for n in a.shape[::-1]) + struct.pack("<IQ", codes[a.dtype.newbyteorder("<").str if a.dtype.itemsize > 1 else "|i1"], offset)
        body += raw + b"\0" * (-len(raw) % align)
        offset = len(body)
    system, where = _open(path)
    system.create_dir(where.rpartition("/")[0], recursive=True)
    with system.open_output_stream(where) as f:
        f.write(head + b"\0" * (-len(head) % align) + body)
