"""All-pairs work on vectors inside groups, without ever emitting the pairs.

Points of a group are numbered and cut into tiles; every pair of tiles is one task input of
bounded size, and only a summary leaves the task (sums, counts, a spanning forest).  A large
group thus spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.operators.ordered import sessionwise
from sessionloom.operators.scale import same_keys, small_table

TILE = 512


def number_points(points: DataFrame, group: str, order: Sequence[str], name: str = "_n", source: DataFrame | None = None) -> DataFrame:
    """Add ``name`` (1-based number inside the group).  ``source`` has the same groups and is cheap to count."""
    return sessionwise(points, lambda t: t.numbered(name), group, order, source=source)


def tile_pairs(points: DataFrame, group: str, compute: Callable, schema: str,
               columns: Sequence[str], tile: int = TILE) -> DataFrame:
    """Run ``compute(group, left, right)`` on every pair of tiles of every group.

    ``left`` and ``right`` are pandas frames with ``columns``; for the pair of a tile with
    itself ``right`` is None.  ``points`` comes from ``number_points``.
    """
    tiled = points.withColumn("_t", F.floor((F.col("_n") - 1) / tile))
    last = tiled.groupBy(group).agg(F.max("_t").alias("_last"))
    # Every point meets every tile of its group once: as left in (own, j >= own), as right
    # in (i < own, own).
    spread = (tiled.alias("p").join(small_table(last).alias("l"), same_keys("p", "l", [group]))
              .select("p.*", "l._last")
              .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_last"))))
              .select(group, F.least("_t", "_other").alias("_i"), F.greatest("_t", "_other").alias("_j"),
                      (F.col("_t") > F.col("_other")).alias("_right"), *columns))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf[~pdf["_right"]]
        right = pdf[pdf["_right"]] if key[1] != key[2] else None
        return plain_strings(compute(key[0], left, right))

    return spread.groupBy(group, "_i", "_j").applyInPandas(run, schema)


def plain_strings(frame: pd.DataFrame) -> pd.DataFrame:
    """Text columns, and all columns of an empty frame, as Python objects: Arrow then takes
    the type from the schema alone."""
    if frame.empty:
        return frame.astype(object)
    text = [c for c in frame.columns if pd.api.types.is_string_dtype(frame[c].dtype)]
    return frame.astype({c: object for c in text})


def matrix(series: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in series])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` to all of ``b``.

    Squares come from one matrix product; where little is left of the lengths, so that digits cancel, they
    are summed from the differences instead."""
    long, wide = (a * a).sum(axis=1), (b * b).sum(axis=1)
    squares = long[:, None] + wide[None, :] - 2 * (a @ b.T)
    i, j = np.nonzero(~(squares > 1e-3 * (long[:, None] + wide[None, :])))
    for at in range(0, len(i), 1 << 16):
        some = slice(at, at + (1 << 16))
        squares[i[some], j[some]] = ((a[i[some]] - b[j[some]]) ** 2).sum(axis=1)
    return np.sqrt(squares)
