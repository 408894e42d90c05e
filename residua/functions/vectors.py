"""Column builders over numeric arrays: distances, slices, similarity, one-hot codes and binning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from residua import constants as C


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def normalised(v: Column) -> Column:
    """v over its length; a null vector stays as it is."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x / F.when(n > 1e-12, n).otherwise(F.lit(1.0)))


def cosine(a: Column, b: Column) -> Column:
    return dot(normalised(a), normalised(b))


def hybrid_similarity(a: Column, b: Column) -> Column:
    """Weighted sum of 1 / (1 + distance / scale) over the slices of two graph vectors; without edge numbers in one of them
    the edges' distance is 1. Held to 0..1."""
    out = F.lit(0.0)
    for _, start, n, scale, weight in C.VECTOR_SLICES:
        x, y = F.slice(a, start + 1, n), F.slice(b, start + 1, n)
        some = F.least(F.size(x), F.size(y))
        d = F.when(some > 0, l2(F.slice(x, F.lit(1), some), F.slice(y, F.lit(1), some))).otherwise(F.lit(1.0))
        out = out + weight / (1 + d / scale)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), out))


def hybrid_reach(threshold: float) -> tuple[int, int, float]:
    """(start, length, distance) of the slice in which vectors above the threshold are held closest together.

    The slice alone may cost the sum no more than what lies between all weights and the threshold.
    """
    spare = sum(w for *_, w in C.VECTOR_SLICES) - threshold
    bounds = [(scale * spare / (w - spare) * (1 + 1e-9), start, n) for _, start, n, scale, w in C.VECTOR_SLICES if w > spare + 1e-9]
    if not bounds:
        raise ValueError("no slice weighs enough to bound a pair at this threshold")
    reach, start, n = min(bounds)
    return start, n, reach


def one_hot(code: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: (k == code).cast("int"))


def repaired_one_hot(v: Column) -> Column:
    """v where it sums to 1, else the one-hot code of its first largest entry."""
    top = F.array_position(v, F.array_max(v))
    fixed = F.transform(v, lambda x, i: (i + 1 == top).cast("double"))
    return F.when(F.abs(total(v) - 1) > 1e-6, fixed).otherwise(v)


def binned(x: Column, lo: float, hi: float, bins: int = 10, eps: float = 1e-6) -> Column:
    """x held to lo..hi, scaled to 0..1 and rounded down to a tenth."""
    held = F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))
    return F.floor(bins * (held - lo) / (hi - lo + eps)) / bins


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
