"""Exact top-k search by inner product: three phases with a uniform threshold.

The dimensions are cut into ``GROUPS`` slices, so that a score is the sum of one partial
score per slice and any vector with a total of at least ``t`` has a slice with at least
``t / GROUPS``.  Vectors and queries are stored in blocks; a task works on one block of each.

1. Every task takes the k best of each slice's list, resolves their totals and returns the k
   best totals of each query.  The k-th best of all of them is a lower bound of the final k-th.
2. That cutoff goes back to every task (joined to the queries, as it grows with them).  A task
   collects each entry with a slice of at least cutoff / GROUPS.
3. The remaining slices of those entries are resolved exactly; of those that reach the cutoff
   at most k per query leave the task, ties to the smaller id, and a rank ends it.

Components become floor(64 * x).  Rows whose vector is null or holds null or non-finite
components take no part, nor do rows without an id.  Rows that agree in id and vector count
once; rows that only share an id are all candidates of other ids.  A vector that is shorter
than another counts as 0 in the missing components.  Scores beyond a long are returned as the
largest or smallest long.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.operators.scale import materialize

GROUPS = 4
VECTOR_BLOCK = 4096
QUERY_BLOCK = 512
SCALE = 64
EXACT = float(2**53)


def _pack(table: pa.Table, key: str) -> pa.Table:
    ids = table.column("vec_id").to_numpy().astype(np.int64)
    column = table.column("embedding").combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    width = int(lengths.max(initial=0))
    values = np.zeros((len(ids), width))
    values[np.arange(width)[None, :] < lengths[:, None]] = flat
    return pa.table({key: pa.array([table.column(key)[0].as_py()], pa.int64()), "width": pa.array([width], pa.int32()),
                     "ids": pa.array([ids.tobytes()], pa.binary()), "data": pa.array([values.tobytes()], pa.binary())})


def _blocks(rows: DataFrame, key: str, size: int) -> DataFrame:
    count = max(1, -(-rows.count() // size))
    keyed = rows.withColumn(key, F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(count)))
    schema = f"{key} long, width int, ids binary, data binary"
    return materialize(keyed.groupBy(key).applyInArrow(lambda table: _pack(table, key), schema))


def _matrix(data: bytes, rows: int, width: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.float64).reshape(rows, width)


def _numbers(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles if every sum of their products is below 2^53 and so exact, else as Python integers."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1]) < EXACT:
        return a, b
    whole = np.vectorize(int, otypes=[object])
    return whole(a), whole(b)


def _slices(batch: pa.RecordBatch, row: int, step: int = 128):
    """Query ids, vector ids and partial scores (one matrix per slice) of a tile, some queries at a time."""
    get = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
    queries, ids = np.frombuffer(get["q_ids"], np.int64), np.frombuffer(get["ids"], np.int64)
    width = min(get["width"], get["q_width"])
    q, v = _matrix(get["q_data"], len(queries), get["q_width"])[:, :width], _matrix(get["data"], len(ids), get["width"])[:, :width]
    q, v = _numbers(q, v)
    edges = np.linspace(0, width, GROUPS + 1).astype(int)
    for first in range(0, len(queries), step):
        part = slice(first, first + step)
        yield part, queries[part], ids, [q[part, a:b].dot(v[:, a:b].T) for a, b in zip(edges, edges[1:])], get


def _best(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best entries of each row, ties to the smaller id."""
    if scores.dtype == object:
        order = np.array(sorted(range(len(rows)), key=lambda i: (rows[i], -scores[i], ids[i])), dtype=np.int64)
    else:
        order = np.lexsort((ids, -scores, rows))
    ranked = rows[order]
    first = np.searchsorted(ranked, ranked, "left")
    return order[np.arange(len(order)) - first < k]


def _long(scores: np.ndarray) -> pa.Array:
    top = 2**63 - 1
    return pa.array([max(-top, min(top, int(x))) for x in scores], pa.int64())


def exact_topk(df: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding",
               vector_block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """For every row of ``queries`` (rows of ``df``) its k best others: query_id, rank, vec_id, score."""
    def valid(rows: DataFrame) -> DataFrame:
        number = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding"))
        finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        return number.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(finite).distinct()

    vectors = _blocks(valid(df), "block", vector_block)
    asked = _blocks(valid(queries), "q_block", query_block).select(
        "q_block", F.col("width").alias("q_width"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    n_blocks = (vectors.agg(F.max("block")).first()[0] or 0) + 1

    def tiles(asked: DataFrame) -> DataFrame:
        every = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
        # Spark takes the exploded side for as small as the packed file it is read from, and would send all tiles
        # through the driver to broadcast them.
        return every.hint("merge").join(vectors.hint("merge"), "block")

    def local_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                for part, query_ids, ids, partial, get in _slices(batch, row):
                    n, keep = len(query_ids), min(k + 1, len(ids))
                    total = sum(partial)
                    chosen = np.zeros((n, len(ids)), bool)
                    for scores in partial:
                        top = np.argpartition(scores, len(ids) - keep, axis=1)[:, len(ids) - keep:]
                        np.put_along_axis(chosen, top, True, axis=1)
                    chosen &= query_ids[:, None] != ids[None, :]
                    at, of = np.nonzero(chosen)
                    best = _best(at, total[at, of], ids[of], k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(best), get["q_block"]), pa.int64()),
                         pa.array((at[best] + part.start).astype(np.int32)), _long(total[at, of][best])],
                        names=["q_block", "at", "score"])

    lists = tiles(asked).mapInArrow(local_lists, "q_block long, at int, score long")
    rank = F.row_number().over(Window.partitionBy("q_block", "at").orderBy(F.desc("score")))
    cutoffs = (lists.withColumn("_rank", rank).filter(F.col("_rank") <= k).groupBy("q_block", "at")
               .agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("cutoff"))
               .groupBy("q_block").agg(F.collect_list(F.struct("at", "cutoff")).alias("cutoffs")))

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                for part, query_ids, ids, partial, get in _slices(batch, row):
                    known = {x["at"]: x["cutoff"] for x in get["cutoffs"] or ()}
                    cuts = [known.get(i + part.start) for i in range(len(query_ids))]
                    limit = np.array([-np.inf if c is None else c for c in cuts], dtype=partial[0].dtype)[:, None]
                    enough = partial[0] * GROUPS >= limit
                    for scores in partial[1:]:
                        enough |= scores * GROUPS >= limit
                    enough &= query_ids[:, None] != ids[None, :]
                    at, of = np.nonzero(enough)
                    total = sum(scores[at, of] for scores in partial)
                    reach = total >= limit[at, 0]
                    at, of, total = at[reach], of[reach], total[reach]
                    best = _best(at, total, ids[of], k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(query_ids[at[best]]), pa.array(ids[of[best]]), _long(total[best])],
                        names=["query_id", "vec_id", "score"])

    found = tiles(asked.join(cutoffs, "q_block", "left")).mapInArrow(resolve, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
