"""Quantisation of vectors to 8, 4, 2 or 1 bits: a spec, column expressions, and the same in numpy for Arrow kernels."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vec import col, dot, doubles, let, total

BITS = {"float": 32, "half": 16, "qint8": 8, "qint4": 4, "qint2": 2, "qint1": 1}


@dataclass(frozen=True)
class QuantSpec:
    """How vectors are stored. Quantised kinds need a scale and a zero point."""

    kind: str
    scale: float | None = None
    zero_point: float | None = None

    def __post_init__(self):
        if self.kind not in BITS:
            raise ValueError(f"unknown kind: {self.kind}")
        if self.quantized and (self.scale is None or self.zero_point is None):
            raise ValueError("a quantised kind needs scale and zero_point")

    @property
    def bits(self) -> int:
        return BITS[self.kind]

    @property
    def quantized(self) -> bool:
        return self.kind.startswith("qint")

    @property
    def top(self) -> int:
        return (1 << self.bits) - 1

    @classmethod
    def from_width(cls, kind: str, zero: float, width: float) -> QuantSpec:
        """Codes cover [zero - width, zero + width]."""
        if not kind.startswith("qint"):
            return cls(kind)
        scale = 2.0 * width / ((1 << BITS[kind]) - 1)
        return cls(kind, scale, (width - zero) / scale)

    @classmethod
    def from_range(cls, kind: str, low: float, high: float) -> QuantSpec:
        return cls.from_width(kind, (low + high) / 2, (high - low) / 2)

    @classmethod
    def from_data(cls, kind: str, df: DataFrame, vec: str) -> QuantSpec:
        """Range of all components, from one aggregation."""
        r = df.agg(F.min(F.array_min(doubles(vec))).alias("lo"), F.max(F.array_max(doubles(vec))).alias("hi")).first()
        return cls.from_range(kind, r["lo"], r["hi"])

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> QuantSpec:
        return cls(**json.loads(text))


FLOAT, HALF, SIGN = QuantSpec("float"), QuantSpec("half"), QuantSpec("qint1", 2.0, 0.5)


def codes(v: str | Column, spec: QuantSpec) -> Column:
    """Unpacked codes: clamp(round half even(x / scale + zero point), 0, 2**bits - 1)."""
    return F.transform(doubles(v), lambda x: F.least(F.greatest(F.rint(x / spec.scale + spec.zero_point), F.lit(0.0)), F.lit(float(spec.top))).cast("int"))


def pack(c: str | Column, bits: int) -> Column:
    """Codes to bytes, as ints 0..255: code j goes to byte j // (8 / bits), the first in the lowest bits. The length must fill whole bytes."""
    per = 8 // bits

    def part(a: Column):
        place = lambda j, i: F.shiftleft(F.get(a, i * per + j), j * bits)

        def byte(i: Column) -> Column:
            out = place(0, i)
            for j in range(1, per):
                out = out.bitwiseOR(place(j, i))
            return out

        return byte

    whole = F.when(F.size(col(c)) % per == 0, col(c)).otherwise(F.raise_error(F.lit("dimensions must fill whole bytes")).cast("array<int>"))
    return let(whole, lambda a: F.transform(F.sequence(F.lit(0), (F.size(a) / per).cast("int") - 1), part(a)))


def unpack(packed: str | Column, bits: int) -> Column:
    per, mask = 8 // bits, (1 << bits) - 1
    split = lambda byte: F.array(*[F.shiftright(byte, j * bits).bitwiseAND(F.lit(mask)) for j in range(per)])
    return F.flatten(F.transform(col(packed), split))


def quantize(v: str | Column, spec: QuantSpec) -> Column:
    if not spec.quantized:
        return col(v).cast("array<float>") if spec.kind == "float" else F.transform(doubles(v), half)
    return pack(codes(v, spec), spec.bits)


def dequantize(stored: str | Column, spec: QuantSpec) -> Column:
    if not spec.quantized:
        return doubles(stored)
    return F.transform(unpack(stored, spec.bits), lambda q: F.lit(spec.scale) * (q.cast("double") - F.lit(spec.zero_point)))


def convert(stored: str | Column, old: QuantSpec, new: QuantSpec) -> Column:
    """From one spec to another, through the values."""
    return quantize(dequantize(stored, old), new)


def half(x: Column) -> Column:
    """x rounded half-even to the nearest 16-bit float, as double."""
    magnitude = F.abs(x)
    exponent = F.when(magnitude < 2.0**-14, F.lit(-14.0)).otherwise(F.floor(F.log2(F.greatest(magnitude, F.lit(2.0**-14)))).cast("double"))
    unit = F.pow(F.lit(2.0), exponent - 10)
    return F.when(magnitude == 0, F.lit(0.0)).otherwise(F.rint(x / unit) * unit)


def quantized_dot(stored: str | Column, y: str | Column, spec: QuantSpec) -> Column:
    """Inner product with a stored vector, never making its values: scale * (codes . y - zero point * sum(y))."""
    if not spec.quantized:
        return dot(stored, y)
    return F.lit(spec.scale) * (dot(unpack(stored, spec.bits), y) - F.lit(spec.zero_point) * total(y))


def np_codes(x: np.ndarray, spec: QuantSpec) -> np.ndarray:
    return np.clip(np.rint(x.astype(np.float64) / spec.scale + spec.zero_point), 0, spec.top).astype(np.uint8)


def np_pack(c: np.ndarray, bits: int) -> np.ndarray:
    per = 8 // bits
    if c.shape[-1] % per:
        raise ValueError("dimensions must fill whole bytes")
    grouped = c.reshape(*c.shape[:-1], -1, per).astype(np.uint16)
    return (grouped << (np.arange(per, dtype=np.uint16) * bits)).sum(-1).astype(np.uint8)


def np_unpack(p: np.ndarray, bits: int) -> np.ndarray:
    per = 8 // bits
    out = (p[..., None] >> (np.arange(per, dtype=np.uint8) * bits)) & ((1 << bits) - 1)
    return out.reshape(*p.shape[:-1], -1)


def np_dequantize(p: np.ndarray, spec: QuantSpec) -> np.ndarray:
    return spec.scale * (np_unpack(p, spec.bits).astype(np.float64) - spec.zero_point)
