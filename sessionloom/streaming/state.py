"""Rows of live sessions in Spark's state store: a batch brings back whole sessions without reading old files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.sources.readers import LIVE_SCHEMA

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROW_SCHEMA = T.StructType([*LIVE_SCHEMA.fields, T.StructField("seq", T.LongType())])


def touched_sessions(rows: DataFrame, session: str = "session") -> DataFrame:
    """All rows so far of the sessions that have rows in the batch.

    ``rows`` is a stream of ``ts``, ``session``, ``cat``, ``message``, ``seq`` and ``place``.  The state of a session is the list
    of its rows, an aggregate of the stream that gives back the lists it changed; the rows of one session are one value.
    Rows without ``seq`` get one: the number of the batch in the session, then their place in the batch."""
    kept = [c for c in (*ROW_SCHEMA.names, "place") if c != session]
    # In a stream this is the time of the batch, also if the batch is run again.
    row = F.struct(F.current_timestamp().alias("_batch"), *kept)
    lists = rows.select(session, row.alias("_row")).groupBy(session).agg(F.collect_list("_row").alias("_rows"))
    batches = F.array_sort(F.array_distinct(F.transform("_rows", lambda r: r["_batch"])))
    flat = lists.select(session, batches.alias("_batches"), F.explode("_rows").alias("_row")).select(session, "_batches", "_row.*")
    number = F.array_position("_batches", F.col("_batch")) - 1
    placed = F.coalesce("seq", number * (1 << 44) + F.col("place"))
    return flat.withColumn("seq", placed).select(*ROW_SCHEMA.names)


def use_rocksdb(spark: SparkSession) -> None:
    """This store keeps the state out of the heap; a session that has another one set by hand keeps it."""
    if "HDFSBacked" in (spark.conf.get(PROVIDER, None) or "HDFSBacked"):
        spark.conf.set(PROVIDER, ROCKSDB)
