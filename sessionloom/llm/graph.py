"""Connected components of an edge list, without the graph ever leaving the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.operators.scale import materialize


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def star_forest(edges: DataFrame) -> DataFrame:
    """(a, b): every node ``a`` of a component but its smallest, and that smallest node ``b``.

    Alternates two steps until nothing changes: every node tells its larger neighbours, then
    its smaller ones, of the smallest node it knows.  Minima are combined before the shuffle
    and a join on a node with very many neighbours is split, so hubs are no problem.  The
    number of rounds grows with the logarithm of the longest path.
    """
    forest = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(forest)
    if not state[0]:
        return forest
    while True:
        both = forest.unionByName(forest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        step = (small.select("a", F.col("m").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("m").alias("b")))
                .filter("a <> b").distinct())
        forest = materialize(step)
        before, state = state, _state(forest)
        if state == before:
            return forest
