"""Aggregates of whole vectors: partial results per batch of rows, merged after one shuffle by key.

A vector stays one value from the scan to the result.  Every Arrow batch gives a row per key it holds,
so a key with most of the rows sends one row per batch; the sorted partials of a key are then
added up as they stream by, which needs room for one of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

# Neutral value, and how values of the same key combine.
_FOLDS = {"sum": (0.0, np.add), "mean": (0.0, np.add), "max": (-np.inf, np.maximum), "min": (np.inf, np.fmin)}
HELD_BYTES = 64 << 20


def _dense(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column as a matrix, and which of its cells hold a value."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    shape = (len(column), int(lengths.max(initial=0)))
    values, there = np.zeros(shape), np.zeros(shape, bool)
    cells = np.arange(shape[1])[None, :] < lengths[:, None]
    values[cells] = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
    there[cells] = flat.is_valid().to_numpy(zero_copy_only=False)
    return values, there


def _groups(keys: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order of their groups, where each group starts there, and a row of each group."""
    code = keys.groupby(list(keys.columns), dropna=False, sort=False).ngroup().to_numpy()
    order = np.argsort(code, kind="stable")
    starts = np.flatnonzero(np.diff(code[order], prepend=-1))
    return order, starts, order[starts]


def _same(a: Sequence, b: Sequence) -> bool:
    return all(x == y or (pd.isna(x) and pd.isna(y)) for x, y in zip(a, b))


def _joined(a: np.ndarray, b: np.ndarray, fold, neutral: float) -> np.ndarray:
    width = max(len(a), len(b))
    return fold(*(np.pad(x, (0, width - len(x)), constant_values=neutral) for x in (a, b)))


def vector_aggregate(df: DataFrame, keys: Sequence[str], vector: str, how: str = "mean", out: str = "vector") -> DataFrame:
    """One vector per key: ``sum``, ``mean``, ``max`` or ``min`` of every dimension over the rows that have it.

    Null elements are left out, as are keys without any element; a dimension that only has nulls is null.
    """
    neutral, fold = _FOLDS[how]
    names = [f"_k{i}" for i in range(len(keys))]
    plain = df.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), F.col(vector).cast("array<double>").alias("_v"))
    kinds = ", ".join(f"{n} {plain.schema[n].dataType.simpleString()}" for n in names)
    arrow = to_arrow_schema(plain.select(names).schema)
    schema = pa.schema([*arrow, ("_v", pa.list_(pa.float64())), ("_c", pa.list_(pa.int64()))])

    def rows(of_keys: pa.RecordBatch, values: Sequence, counts: Sequence) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(c.cast(t.type) for c, t in zip(of_keys.columns, arrow)),
                                           pa.array(list(values), schema.field("_v").type), pa.array(list(counts), schema.field("_c").type)], schema=schema)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values, there = _dense(batch.column("_v"))
                order, starts, first = _groups(batch.select(names).to_pandas())
                total = fold.reduceat(np.where(there, values, neutral)[order], starts, axis=0)
                yield rows(batch.select(names).take(pa.array(first)), total, np.add.reduceat(there[order].astype(np.int64), starts, axis=0))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None     # key, its row, values and counts so far
        for batch in batches:
            if not batch.num_rows:
                continue
            frame = batch.select(names).to_pandas()
            order, starts, first = _groups(frame)       # sorted by key: groups are runs
            done = []
            for at, row in enumerate(first.tolist()):
                key = tuple(frame.iloc[row])
                members = order[starts[at]:starts[at + 1] if at + 1 < len(starts) else None].tolist()
                if held is None or not _same(held[0], key):
                    if held is not None:
                        done.append(held)
                    held = (key, batch.select(names).slice(row, 1), np.zeros(0), np.zeros(0, np.int64))
                for m in members:
                    more = np.array(batch.column("_v")[m].as_py(), float), np.array(batch.column("_c")[m].as_py(), np.int64)
                    held = (*held[:2], _joined(held[2], more[0], fold, neutral), _joined(held[3], more[1], np.add, 0))
            if done:
                yield rows(pa.Table.from_batches([d[1] for d in done]).combine_chunks().to_batches()[0], [d[2] for d in done], [d[3] for d in done])
        if held is not None:
            yield rows(held[1], [held[2]], [held[3]])

    layout = f"{kinds}, _v array<double>, _c array<bigint>"
    merged = plain.mapInArrow(partial, layout).repartition(*names).sortWithinPartitions(*names).mapInArrow(merge, layout)
    value = F.zip_with("_v", "_c", lambda v, c: F.when(c > 0, v / c if how == "mean" else v))
    return merged.filter("exists(_c, c -> c > 0)").select(*(F.col(n).alias(k) for k, n in zip(keys, names)), value.alias(out))


def vector_scatter(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Per group ``n``, ``mean`` and ``scatter`` (binary, doubles): the sum of (v - mean)(v - mean)', centred throughout.

    All vectors have the same length.  A task sends one row per group, or several if it meets so many groups
    that their matrices pass ``HELD_BYTES``.
    """
    kind = df.schema[group].dataType.simpleString()
    key_type = to_arrow_schema(df.select(group).schema).field(0).type
    schema = pa.schema([("_g", key_type), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("scatter", pa.binary())])

    def combine(a, b):
        (n, mean, scatter), (m, other, more) = a, b
        step = other - mean
        return n + m, mean + step * (m / (n + m)), scatter + more + np.outer(step, step) * (n * m / (n + m))

    def batch_of(found: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(found), key_type), pa.array([s[0] for s in found.values()], pa.int64()),
             pa.array([s[1] for s in found.values()], schema.field("mean").type), pa.array([s[2].tobytes() for s in found.values()], pa.binary())], schema=schema)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            values, _ = _dense(batch.column("_v"))
            order, starts, first = _groups(batch.select(["_g"]).to_pandas())
            for at, row in enumerate(first.tolist()):
                mine = values[order[starts[at]:starts[at + 1] if at + 1 < len(starts) else None]]
                mean = mine.mean(axis=0)
                state, key = (len(mine), mean, (mine - mean).T @ (mine - mean)), batch.column("_g")[row].as_py()
                found[key] = combine(found[key], state) if key in found else state
            if sum(s[2].nbytes for s in found.values()) > HELD_BYTES:
                yield batch_of(found)
                found = {}
        if found:
            yield batch_of(found)

    def merge(table: pa.Table) -> pa.Table:
        state = None
        for n, mean, scatter in zip(table.column("n").to_pylist(), table.column("mean").to_pylist(), table.column("scatter").to_pylist()):
            more = (n, np.array(mean), np.frombuffer(scatter).reshape(len(mean), len(mean)))
            state = more if state is None else combine(state, more)
        return pa.Table.from_batches([batch_of({table.column("_g")[0].as_py(): state})])

    layout = f"_g {kind}, n bigint, mean array<double>, scatter binary"
    parts = df.select(F.col(group).alias("_g"), F.col(vector).cast("array<double>").alias("_v")).mapInArrow(partial, layout)
    return parts.groupBy("_g").applyInArrow(merge, layout).withColumnRenamed("_g", group)
