"""Distances and scores as Columns: squared L2 and negated dot product, smaller is nearer.

Components are cast (float32 to double, int8 to long) and folded from left to right, so a result doesn't depend on the
plan. Scores are in (0, 1), larger is nearer.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..sources.schema import METRICS

DOT_SCALE = 0.01


def literal(vector: Sequence[float], vector_type: str = "f32") -> Column:
    """A query vector as one array constant. int8 components are exact; float32 ones are rounded to float32 first."""
    if any(isinstance(v, float) and not math.isfinite(v) for v in vector):
        raise InvalidArgument("query vectors are finite")
    if vector_type == "i8":
        return F.lit([int(v) for v in vector]).cast("array<tinyint>")
    return F.lit([float(v) for v in vector]).cast("array<float>")


def _fold(a: Column, b: Column, vector_type: str, step) -> Column:
    kind = "bigint" if vector_type == "i8" else "double"
    parts = F.zip_with(a.cast(f"array<{kind}>"), b.cast(f"array<{kind}>"), step)
    return F.aggregate(parts, F.lit(0).cast(kind), lambda s, x: s + x)


def l2_sq(a: Column, b: Column, vector_type: str = "f32") -> Column:
    return _fold(a, b, vector_type, lambda x, y: (x - y) * (x - y))


def neg_dot(a: Column, b: Column, vector_type: str = "f32") -> Column:
    return -_fold(a, b, vector_type, lambda x, y: x * y)


def distance(a: Column, b: Column, metric: str, vector_type: str = "f32") -> Column:
    if metric not in METRICS:
        raise InvalidArgument(f"metric {metric!r}")
    return (l2_sq if metric == "l2" else neg_dot)(a, b, vector_type)


def score_of(distance_: Column, metric: str) -> Column:
    d = distance_.cast("double")
    return 1.0 / (1.0 + d) if metric == "l2" else 1.0 / (1.0 + F.exp(DOT_SCALE * d))


def score(a: Column, b: Column, metric: str, vector_type: str = "f32") -> Column:
    return score_of(distance(a, b, metric, vector_type), metric)


def normalise(vector: Column) -> Column:
    """To unit length; a zero vector stays."""
    norm = F.sqrt(-neg_dot(vector, vector))
    return F.when(norm > 0, F.transform(vector.cast("array<double>"), lambda x: x / norm)).otherwise(vector.cast("array<double>"))


def quantise(vector: Column, scale: float) -> Column:
    """round(x * scale) as int8; components outside its range are cut to it."""
    return F.transform(vector, lambda x: F.least(F.greatest(F.round(x.cast("double") * scale), F.lit(-128.0)), F.lit(127.0)).cast("tinyint"))


def fnv1a(text: bytes) -> int:
    """The 64-bit FNV-1a hash."""
    h = 0xCBF29CE484222325
    for b in text:
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h
