"""Vector expressions on `array<float|double>` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bytes of a SHA-1 digest and the zero point of a byte.
DIGEST_BYTES = 20
BYTE_CENTRE = 128.0


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _double(c: Column | str) -> Column:
    return _col(c).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(
        F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x
    )


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(_double(v), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v: Column | str) -> Column:
    """Unit-length copy as doubles; a zero vector stays as it is."""
    length = norm(v)
    return F.when(length == 0.0, _double(v)).otherwise(
        F.zip_with(_double(v), F.array_repeat(length, F.size(_col(v))), lambda x, n: x / n)
    )


def distance(a: Column | str, b: Column | str, metric: str = "cosine") -> Column:
    """Cosine distance `1 - cos` (1 when either vector is zero) or Euclidean distance."""
    if metric == "cosine":
        scale = norm(a) * norm(b)
        return F.when(scale == 0.0, F.lit(1.0)).otherwise(1.0 - dot(a, b) / scale)
    if metric == "l2":
        return F.sqrt(
            F.aggregate(
                F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)),
                F.lit(0.0),
                lambda acc, x: acc + x,
            )
        )
    raise ValueError(f"unknown metric: {metric}")


def score(dist: Column | str) -> Column:
    """Similarity shown to users: `max(0, 1 - distance)`, 1 when the distance is missing."""
    return F.coalesce(F.greatest(F.lit(0.0), 1.0 - _col(dist)), F.lit(1.0))


def hash_values(text: Column | str, dim: int) -> Column:
    """Raw deterministic vector: digest byte `i mod 20`, centred and scaled to [-1, 1)."""
    digest = F.sha1(_col(text).cast("binary"))
    parts = [
        (F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("double") - BYTE_CENTRE) / BYTE_CENTRE
        for i in range(min(DIGEST_BYTES, dim))
    ]
    base = F.array(*parts)
    if dim <= DIGEST_BYTES:
        return base
    full, rest = divmod(dim, DIGEST_BYTES)
    return F.concat(F.flatten(F.array_repeat(base, full)), F.slice(base, 1, rest))


def hash_embed(text: Column | str, dim: int) -> Column:
    """Deterministic unit vector of a text; stands in for a model in tests and examples."""
    return l2_normalize(hash_values(text, dim))
