"""Exact nearest vectors by cosine similarity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(vector: Column | str, query: Sequence[float]) -> Column:
    """Cosine similarity to a constant vector, summed in double precision."""
    given = F.col(vector) if isinstance(vector, str) else vector
    v = given.cast("array<double>")
    q = F.array(*[F.lit(float(x)) for x in query])
    norm = sum(float(x) * float(x) for x in query) ** 0.5
    return _dot(v, q) / (F.sqrt(_dot(v, v)) * F.lit(norm))


def nearest(
    vectors: DataFrame,
    query: Sequence[float],
    n: int = 10,
    key: str = "vec_id",
    vector: str = "embedding",
    where: Column | None = None,
    digits: int | None = 4,
) -> DataFrame:
    """The ``n`` rows most similar to ``query``; filters apply before the cut.

    Each task keeps its own best ``n``, so only those travel.
    """
    rows = vectors if where is None else vectors.where(where)
    exact = rows.withColumn("_sim", cosine(vector, query))
    score = F.col("_sim") if digits is None else F.round("_sim", digits)
    return (
        exact.orderBy(F.desc("_sim"), key).limit(n).withColumn("score", score).drop("_sim")
    )


def vector_of(vectors: DataFrame, key: str, value, vector: str = "embedding") -> list[float]:
    """One stored vector, to use as a query."""
    row = vectors.where(F.col(key) == value).select(vector).first()
    if row is None:
        raise KeyError(value)
    return list(row[0])
