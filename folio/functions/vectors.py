"""Vector expressions over ``array<float>`` columns.

Spark ships no vector SQL functions, so these are higher-order expressions.
Norms are meant to be computed once (at ingest) and reused by every score.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def sum_squares(v) -> Column:
    return F.aggregate(_c(v), F.lit(0.0).cast("double"),
                       lambda acc, x: acc + x.cast("double") * x.cast("double"))


def l2_norm(v) -> Column:
    return F.sqrt(sum_squares(v))


def scale(v, by) -> Column:
    """Each element divided by ``by`` (a column evaluated once per row)."""
    return F.transform(_c(v), lambda x: (x.cast("double") / by).cast("float"))


def dot(a, b) -> Column:
    """Inner product in double precision."""
    return F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def cosine(a, b, norm_a=None, norm_b=None) -> Column:
    """Cosine similarity; pass precomputed norms to avoid recomputing them.
    A zero vector gives null, never a division error."""
    na = _c(norm_a) if norm_a is not None else l2_norm(a)
    nb = _c(norm_b) if norm_b is not None else l2_norm(b)
    return F.try_divide(dot(a, b), na * nb)
