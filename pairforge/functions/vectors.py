"""Vectors as arrays; all sums in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-12


def dot(a: Column, b: Column) -> Column:
    terms = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(terms, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column, zero: str = "keep") -> Column:
    """a over its length. Near-zero vectors: ``keep`` them, divide by ``epsilon``, or by ``one``."""
    length = norm(a)
    if zero == "epsilon":
        by = F.greatest(length, F.lit(EPSILON))
    elif zero in ("keep", "one"):
        by = F.when(length <= EPSILON, F.lit(1.0)).otherwise(length)
    else:
        raise ValueError(f"unknown rule for zero vectors: {zero}")
    return F.transform(a, lambda x: x.cast("double") / by)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - dot, the dot product held to [-1, 1]; for vectors of length 1."""
    return 1.0 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes."""
    return F.bit_count(a.bitwiseXOR(b))
