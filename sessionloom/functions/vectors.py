"""Column functions on vectors held as arrays; sums run in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def as_double(vector) -> Column:
    return _col(vector).cast("array<double>")


def total(vector) -> Column:
    return F.aggregate(as_double(vector), F.lit(0.0), lambda acc, x: acc + x)


def dot(left, right) -> Column:
    return total(F.zip_with(as_double(left), as_double(right), lambda a, b: a * b))


def l2_norm(vector) -> Column:
    return F.sqrt(F.aggregate(as_double(vector), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_distance(left, right) -> Column:
    return l2_norm(F.zip_with(as_double(left), as_double(right), lambda a, b: a - b))


def cosine(left, right) -> Column:
    """Cosine similarity; 0 if one of the vectors is zero."""
    lengths = l2_norm(left) * l2_norm(right)
    return F.when(lengths == 0, F.lit(0.0)).otherwise(F.try_divide(dot(left, right), lengths))


def truncate_l2(vector, size: int) -> Column:
    """The first ``size`` dimensions scaled to length 1; a zero vector stays as it is."""
    cut = F.slice(as_double(vector), 1, size)
    length = l2_norm(cut)
    return F.when(length > 0, F.transform(cut, lambda x: x / length)).otherwise(cut)


def one_hot(label, size: int) -> Column:
    """Dense one-hot array of ``size`` entries for a 0-based label."""
    label = _col(label)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)),
                       lambda i: F.when(i == label, 1).otherwise(0))
