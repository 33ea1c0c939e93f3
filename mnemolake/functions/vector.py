"""Vector expressions over ARRAY<FLOAT> columns, computed in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0.0 when either vector is all zeros. Pass stored norms when known."""
    scale = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.coalesce(dot(a, b) / F.nullif(scale, F.lit(0.0)), F.lit(0.0))


def hash_embedding(text: Column, dim: int = 32) -> Column:
    """Deterministic stand-in vector: component i is (sha256 byte [i mod 32] - 128) / 128."""
    pairs = F.regexp_extract_all(F.sha2(F.coalesce(text, F.lit("")), 256), F.lit("(..)"), F.lit(1))
    values = F.transform(
        pairs, lambda p: ((F.conv(p, 16, 10).cast("int") - F.lit(128)) / F.lit(128.0)).cast("float")
    )
    if dim > 32:
        values = F.flatten(F.array_repeat(values, -(-dim // 32)))
    return values if dim % 32 == 0 else F.slice(values, 1, dim)
