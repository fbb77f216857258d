"""Vector arithmetic on ARRAY<FLOAT> columns, accumulated in double precision."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

METRICS = ("dot", "l2")
SIGNATURE_BITS = 256
HAMMING_LIMIT = 128


def parse_metric(name: str) -> str:
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; expected one of {METRICS}")
    return name


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2sq(a: Column, b: Column) -> Column:
    """Squared Euclidean distance, without the root."""
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def distance(metric: str, a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b) if parse_metric(metric) == "dot" else l2sq(a, b)


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def normalize(v: Column) -> Column:
    """Unit length; the norm is floored at 1e-12, so a zero vector stays zero."""
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm(v), F.lit(1e-12)))


def truncate(v: Column, dim: int) -> Column:
    """The first dim components, renormalised. The order matters: cut first, then scale."""
    if dim < 1:
        raise ValueError("dim must be at least 1")
    return normalize(F.slice(v, 1, dim))


def usable(v: Column, dim: int) -> Column:
    """Non-null, dim finite components, not all zeros. Never null."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def quantize(v: Column, qrange: Column | float) -> Column:
    """Codes in -127..127: half away from zero, clamped before the cast."""
    r = F.lit(qrange) if isinstance(qrange, (int, float)) else qrange
    step = F.lit(127.0) / F.greatest(r, F.lit(1e-9))

    def code(x: Column) -> Column:
        y = F.round(x.cast("double") * step)
        return F.when(F.isnan(x), F.lit(0)).otherwise(F.greatest(F.lit(-127.0), F.least(F.lit(127.0), y)).cast("int"))

    return F.transform(v, code)


def max_abs(v: Column) -> Column:
    return F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))


def _int_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda s, x: s + x)


def dot_i8(a: Column, b: Column) -> Column:
    return _int_sum(F.zip_with(a, b, lambda x, y: x.cast("int") * y.cast("int")))


def l2sq_i8(a: Column, b: Column) -> Column:
    return _int_sum(F.zip_with(a, b, lambda x, y: (x.cast("int") - y.cast("int")) * (x.cast("int") - y.cast("int"))))


def distance_i8(metric: str, a: Column, b: Column, qrange: Column | float) -> Column:
    r = F.lit(qrange) if isinstance(qrange, (int, float)) else qrange
    scale = (F.greatest(r, F.lit(1e-9)) / 127.0) * (F.greatest(r, F.lit(1e-9)) / 127.0)
    return F.lit(1.0) - dot_i8(a, b) * scale if parse_metric(metric) == "dot" else l2sq_i8(a, b) * scale


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two ARRAY<BIGINT> signatures."""
    return _int_sum(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))))


def walsh_signature(v: Column, bits: int) -> Column:
    """Signs against the first `bits` Walsh rows (component j enters row i with the parity of i & j), packed in one BIGINT."""
    if not 1 <= bits <= 62:
        raise ValueError("bits must lie in 1..62")

    def bit(i: Column) -> Column:
        signed = F.transform(v, lambda x, j: F.when(F.bit_count(i.bitwiseAND(j)) % 2 == 0, x.cast("double")).otherwise(-x.cast("double")))
        return F.when(_sum(signed) >= 0, F.lit(1)).otherwise(F.lit(0)).cast("long")

    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), F.lit(0).cast("long"), lambda s, i: s * 2 + bit(i))


def hyperplanes(seed: int, dim: int, bits: int = SIGNATURE_BITS) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((bits, dim))


def pack_signs(vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """int64 lanes: bit i of lane i // 64 tells whether the vector lies on plane i's side."""
    bits = (np.nan_to_num(vectors) @ planes.T >= 0).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64)


def walsh_planes(dim: int) -> np.ndarray:
    """The dim Walsh rows of walsh_signature as a matrix."""
    i = np.arange(dim)
    return np.where(np.bitwise_count(i[:, None] & i[None, :]) % 2 == 0, 1.0, -1.0)


def popcount(lanes: np.ndarray) -> np.ndarray:
    """Set bits of int64 lanes. The view matters: numpy counts the bits of the absolute value of signed numbers."""
    return np.bitwise_count(lanes.view(np.uint64)).astype(np.int32)
