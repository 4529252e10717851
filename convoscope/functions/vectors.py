"""Array<float|double> column math (dot products, norms, scaling).

Higher-order array functions run in the JVM; values are promoted to double."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    prod = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def dot_literal(a, vec: Sequence[float]) -> Column:
    """Dot product with a constant vector (a driver-side parameter)."""
    lit = F.array(*[F.lit(float(v)) for v in vec])
    return dot(a, lit)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalize(a) -> Column:
    n = norm(a)
    return F.transform(_c(a), lambda x: x.cast("double") / n)
