"""Helpers that keep plans safe on skewed and very large inputs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.session import ensure_checkpoint_dir

# A group above this many rows is processed in several blocks instead of one task.
HOT_ROWS = "sessionloom.hotGroupRows"
HOT_ROWS_DEFAULT = 2_000_000
# A side above this many rows or bytes is not broadcast.
BROADCAST_ROWS = "sessionloom.broadcastRows"
BROADCAST_ROWS_DEFAULT = 1_000_000
BROADCAST_BYTES = 256 << 20


def setting(spark: SparkSession, key: str, default: int) -> int:
    return int(spark.conf.get(key, str(default)))


def materialize(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage: a table in the shared checkpoint folder.

    Unlike ``checkpoint()`` this runs the plan once, not twice, and later reads prune columns
    and know the size of the table.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _tables.add((spark.sparkContext.applicationId, table.semanticHash()))
    return table


_tables: set[tuple[str, int]] = set()
_scopes: list[list[str]] = []


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that ``materialize`` writes inside the block when it ends.

    For work that has written its result by then, such as a batch of a stream that runs for months;
    a DataFrame that was built inside must not be used afterwards.
    """
    known, seen = set(_tables), set(_hot_seen)
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _tables.intersection_update(known)
        for key in set(_hot_seen) - seen:
            del _hot_seen[key]


def once(df: DataFrame) -> DataFrame:
    """For input that is read several times: materialized, unless it is such a table already."""
    if (df.sparkSession.sparkContext.applicationId, df.semanticHash()) in _tables:
        return df
    return materialize(df)


def _value_bytes(value: Column, kind: T.DataType) -> Column:
    """A bound for the width of a value in a hashed relation, whatever it is made of."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("bigint") + 16
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
            added = F.aggregate(value, F.lit(0).cast("bigint"), lambda total, x: total + _value_bytes(x, inner))
        else:
            added = F.size(value).cast("bigint") * 16
        return F.greatest(F.coalesce(added, F.lit(0)), F.lit(0)).cast("bigint") + 16
    if isinstance(kind, T.MapType):
        return (_value_bytes(F.map_keys(value), T.ArrayType(kind.keyType)) + _value_bytes(F.map_values(value), T.ArrayType(kind.valueType)))
    if isinstance(kind, T.StructType):
        return sum((_value_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(16).cast("bigint"))
    return F.lit(16).cast("bigint")


def _row_bytes(df: DataFrame) -> Column:
    return sum((_value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0).cast("bigint"))


def is_small(df: DataFrame, max_rows: int | None = None) -> bool:
    """True if the whole of ``df`` stays under the broadcast bounds.

    Rows and bytes are added up where they lie; one row per partition moves.  Call it on something
    cheap to compute: a table that lies on disk, or the result of ``materialize``.
    """
    max_rows = max_rows or setting(df.sparkSession, BROADCAST_ROWS, BROADCAST_ROWS_DEFAULT)
    size = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(_row_bytes(df)).alias("bytes")).first()
    return size["rows"] <= max_rows and (size["bytes"] or 0) <= BROADCAST_BYTES


def broadcast_if_small(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Broadcast ``df`` if it is proven small; else leave the join to adaptive execution,
    which shuffles both sides and splits skewed partitions."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def small_table(df: DataFrame) -> DataFrame:
    """A lookup table or aggregate that is joined to rows: computed once, broadcast if it is
    small."""
    return broadcast_if_small(once(df))


_hot_seen: dict[tuple, DataFrame | None] = {}


def hot_groups(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> DataFrame | None:
    """The key values that hold more than ``limit`` rows, or None if there are none.

    Only the key columns are read, and counts are combined before the shuffle, so a key
    that holds most of the table costs no more than any other.  At most rows / limit
    values come back.

    The answer is remembered per plan.  It only decides how rows are spread over tasks, so
    an answer that has become old costs time, never a row.
    """
    spark = df.sparkSession
    limit = limit or setting(spark, HOT_ROWS, HOT_ROWS_DEFAULT)
    seen = (spark.sparkContext.applicationId, df.semanticHash(), tuple(keys), limit)
    if seen not in _hot_seen:
        hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > limit)
        hot = materialize(hot)
        _hot_seen[seen] = None if hot.isEmpty() else hot
    return _hot_seen[seen]


def same_keys(left: str, right: str, keys: Sequence[str]):
    """Null-safe equality of the key columns of two aliased sides."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(f"{left}.`{key}`").eqNullSafe(F.col(f"{right}.`{key}`"))
    return condition
