"""Ordered work inside sessions, also when one session is far too large for a task.

``Timeline`` wraps a DataFrame whose rows have an order inside each session and offers the
few ordered steps the session operators need: running aggregates, the neighbouring row and
session totals.  A normal session is one window partition.  A *hot* session (more rows than
``sessionloom.hotGroupRows``) is first range-partitioned by its order into blocks; every
step is then done per block, and the one summary row per block that crosses the border is
carried over and joined back.  The rows of a hot session never meet in one task.

``sessionwise(df, step)`` picks the way: ``step`` is written once against ``Timeline``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.operators.scale import (
    HOT_ROWS,
    HOT_ROWS_DEFAULT,
    broadcast_if_small,
    hot_groups,
    materialize,
    same_keys,
    setting,
)

BLOCK = "_block"

_MERGE: dict[str, Callable[[Column, Column], Column]] = {
    "sum": lambda own, carried: F.coalesce(own + carried, own, carried),
    "count": lambda own, carried: F.coalesce(own, F.lit(0)) + F.coalesce(carried, F.lit(0)),
    "min": lambda own, carried: F.least(own, carried),
    "max": lambda own, carried: F.greatest(own, carried),
}
_FOLD = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


class Timeline:
    """Rows with an order inside each session.  ``block`` is set for hot sessions only."""

    def __init__(self, df: DataFrame, session: str = "session",
                 order: Sequence[str] = ("ts", "seq"), block: str | None = None):
        self.df, self.session, self.order, self.block = df, session, tuple(order), block

    # -- plain DataFrame steps ---------------------------------------------------------
    def of(self, df: DataFrame) -> "Timeline":
        return Timeline(df, self.session, self.order, self.block)

    def with_columns(self, **columns: Column) -> "Timeline":
        return self.of(self.df.withColumns(columns))

    def filter(self, condition) -> "Timeline":
        return self.of(self.df.filter(condition))

    def drop(self, *names: str) -> "Timeline":
        return self.of(self.df.drop(*names))

    def _window(self, keys: Sequence[str]):
        parts = [self.session, *keys] + ([self.block] if self.block else [])
        return Window.partitionBy(*parts).orderBy(*self.order)

    # -- ordered steps -----------------------------------------------------------------
    def running(self, keys: Sequence[str] = (), inclusive: bool = True,
                **folds: tuple[str, Column]) -> "Timeline":
        """Running ``(kind, value)`` aggregates; ``kind`` is sum, count, min or max."""
        frame = self._window(keys).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        if not self.block:
            return self.with_columns(
                **{name: _FOLD[kind](value).over(frame) for name, (kind, value) in folds.items()})
        parts = [self.session, *keys]
        before = Window.partitionBy(*parts).orderBy(self.block).rowsBetween(
            Window.unboundedPreceding, -1)
        merge_kind = {kind: "sum" if kind == "count" else kind for kind in _FOLD}
        carry = self.df.groupBy(*parts, self.block).agg(
            *[_FOLD[kind](value).alias(f"_c_{name}") for name, (kind, value) in folds.items()]
        ).withColumns({f"_c_{name}": _FOLD[merge_kind[kind]](F.col(f"_c_{name}")).over(before)
                       for name, (kind, _) in folds.items()})
        local = self.df.withColumns(
            {name: _FOLD[kind](value).over(frame) for name, (kind, value) in folds.items()})
        joined = local.alias("l").join(
            carry.alias("c"), same_keys("l", "c", [*parts, self.block]), "left")
        kept = [F.col(f"l.`{name}`") for name in local.columns if name not in folds]
        merged = [_MERGE[kind](F.col(f"l.`{name}`"), F.col(f"c._c_{name}")).alias(name)
                  for name, (kind, _) in folds.items()]
        return self.of(materialize(joined.select(*kept, *merged)))

    def neighbour(self, step: int, keys: Sequence[str] = (), **values: Column) -> "Timeline":
        """``values`` of the previous (``step=-1``) or the next (``step=1``) row."""
        pick = F.lag if step < 0 else F.lead
        window = self._window(keys)
        if not self.block:
            return self.with_columns(
                **{name: pick(value).over(window) for name, value in values.items()})
        parts = [self.session, *keys]
        payload = F.struct(*[value.alias(name) for name, value in values.items()])
        edge = (F.max_by if step < 0 else F.min_by)(payload, F.struct(*self.order))
        carry = self.df.groupBy(*parts, self.block).agg(edge.alias("_edge")).withColumn(
            "_edge", pick("_edge").over(Window.partitionBy(*parts).orderBy(self.block)))
        local = self.df.withColumn("_near", pick(payload).over(window))
        joined = local.alias("l").join(
            carry.alias("c"), same_keys("l", "c", [*parts, self.block]), "left"
        ).withColumn("_near", F.coalesce(F.col("l._near"), F.col("c._edge")))
        kept = [F.col(f"l.`{name}`") for name in self.df.columns if name not in values]
        return self.of(materialize(joined.select(
            *kept, *[F.col("_near")[name].alias(name) for name in values])))

    def numbered(self, name: str = "pos") -> "Timeline":
        """1-based position inside the session."""
        if not self.block:
            return self.with_columns(
                **{name: F.row_number().over(self._window(())).cast("bigint")})
        return self.running(**{name: ("count", F.lit(1))})

    def totals(self, **folds: tuple[str, Column]) -> "Timeline":
        """Whole-session aggregates on every row."""
        if not self.block:
            whole = Window.partitionBy(self.session)
            return self.with_columns(
                **{name: _FOLD[kind](value).over(whole) for name, (kind, value) in folds.items()})
        total = self.df.groupBy(self.session).agg(
            *[_FOLD[kind](value).alias(name) for name, (kind, value) in folds.items()])
        joined = self.df.alias("l").join(broadcast_if_small(materialize(total)).alias("c"),
                                         same_keys("l", "c", [self.session]), "left")
        return self.of(joined.select("l.*", *[F.col(f"c.`{name}`") for name in folds]))


def sessionwise(df: DataFrame, step: Callable[[Timeline], Timeline], session: str = "session",
                order: Sequence[str] = ("ts", "seq"), limit: int | None = None,
                source: DataFrame | None = None) -> DataFrame:
    """Apply ``step`` to every session: one window per normal session, blocks for hot ones.

    Hot sessions are looked up in ``source`` if given: a table that ``df`` was made from by
    dropping rows, such as the raw log, in which counting is a scan of one column.
    """
    limit = limit or setting(df.sparkSession, HOT_ROWS, HOT_ROWS_DEFAULT)
    hot = hot_groups(df if source is None else source, [session], limit)
    if hot is None:
        return step(Timeline(df, session, order)).df
    keys = broadcast_if_small(hot.select(session)).alias("h")
    match = same_keys("d", "h", [session])
    normal = df.alias("d").join(keys, match, "left_anti")
    large = df.alias("d").join(keys, match, "left_semi")
    rows = hot.agg(F.sum("_rows")).first()[0]
    blocks = max(2, -(-rows // limit) * 2)
    # The block id is read off the range partition once and stored, so every later step
    # sees the same blocks whatever is recomputed.
    cut = materialize(large.repartitionByRange(int(blocks), session, *order)
                      .withColumn(BLOCK, F.spark_partition_id()))
    done = step(Timeline(cut, session, order, BLOCK)).df.drop(BLOCK)
    return step(Timeline(normal, session, order)).df.drop(BLOCK).unionByName(done)


def chain(*steps: Callable[[Timeline], Timeline]) -> Callable[[Timeline], Timeline]:
    """Steps one after another on the same session partitioning."""
    return lambda rows: reduce(lambda acc, step: step(acc), steps, rows)


def global_number(df: DataFrame, order: Sequence[str], out: str = "number") -> DataFrame:
    """1-based number of each row in the order of the whole table.

    A small table is one sorted task; a large one is range-partitioned, numbered per
    partition and shifted by the rows before it.
    """
    key = "_everything"
    return sessionwise(df.withColumn(key, F.lit(0)), lambda t: t.numbered(out), key, order).drop(key)


def with_halo(df: DataFrame, label: str, size: int, before: int, after: int,
              block: str = "_tile", home: str = "_home") -> DataFrame:
    """Copy rows near a border into the neighbouring tile.

    Tiles hold ``size`` labels.  Every tile then also holds the ``before`` labels below it
    and the ``after`` labels above it, so a window that looks no further can run per tile.
    ``home`` marks the one copy that belongs to the tile.
    """
    if size <= max(before, after):
        raise ValueError("tiles must be larger than the halo")
    own = F.floor(F.col(label) / size)
    inside = F.pmod(F.col(label), F.lit(size))
    tiles = F.array_compact(F.array(
        own,
        F.when((inside >= size - before), own + 1),
        F.when((inside < after) & (own > 0), own - 1)))
    return (df.withColumn(block, F.explode(tiles))
            .withColumn(home, F.col(block) == F.floor(F.col(label) / size)))
