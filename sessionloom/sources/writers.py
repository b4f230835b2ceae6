"""Writers.  Parts are sized for large outputs, and a session is never split over files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.operators.ordered import global_number
from sessionloom.operators.scale import materialize, once, small_table

CHUNK_FOLDERS = 1000  # of session chunks, at most

# Columns and types of a training row.
TRAINING_TYPES = {
    "session_id": "string",
    "item_id-count": "int",
    "item_id-list": "array<bigint>",
    "timestamp_interval-list": "array<double>",
    "timestamp_interval_norm_global-list": "array<double>",
    "merge_count-list": "array<double>",
    "merge_count_norm-list": "array<double>",
    "cat-list": "array<bigint>",
    "classification-list": "array<bigint>",
    "target-list": "array<bigint>",
    "day_index": "bigint",
}


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def session_chunks(df: DataFrame, per_chunk: int = 10_000, session: str = "session") -> DataFrame:
    """Add ``chunk``: sessions in order of their id, ``per_chunk`` of them each."""
    return _with_chunk(df, materialize(df.select(session).distinct()), per_chunk, session)


def _with_chunk(df: DataFrame, ids: DataFrame, per_chunk: int, session: str) -> DataFrame:
    numbered = global_number(ids, [session], "_n").select(
        session, F.floor((F.col("_n") - 1) / per_chunk).alias("chunk"))
    return df.join(small_table(numbered), session)


def write_session_chunks(df: DataFrame, path: str, per_chunk: int = 10_000, session: str = "session", folders: int = CHUNK_FOLDERS) -> None:
    """Chunks in folders ``first_chunk=...``, one each up to ``folders`` chunks, else runs of consecutive ones.

    A chunk lies in one folder and holds whole sessions; a huge one may span several files.  A folder costs as much as thousands
    of rows, so their number does not follow the input.  Rows are sorted by chunk, so a filter on ``chunk`` reads little else."""
    ids = materialize(df.select(session).distinct())
    chunks = -(-ids.count() // per_chunk)  # from the files' footers
    width = max(1, -(-chunks // folders))
    chunked = _with_chunk(df, ids, per_chunk, session).withColumn("first_chunk", F.col("chunk") - F.pmod(F.col("chunk"), F.lit(width)))
    # Rebalancing gives a folder few files and still cuts one that is far too large.
    (chunked.hint("rebalance", "first_chunk").sortWithinPartitions("first_chunk", "chunk")
     .write.mode("overwrite").partitionBy("first_chunk").parquet(path))


def training_rows(df: DataFrame) -> DataFrame:
    """The fixed columns and types; a missing column is written as null."""
    return df.select(*[
        (F.col(f"`{name}`") if name in df.columns else F.lit(None)).cast(kind).alias(name)
        for name, kind in TRAINING_TYPES.items()])


def write_training(df: DataFrame, path: str, rows_per_file: int = 400_000) -> None:
    training_rows(df).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def vocab_lines(vocabulary: DataFrame) -> DataFrame:
    """The lines of one JSON object, an entry each, by id; ``vocabulary`` is a table of distinct names."""
    known = once(vocabulary.select("item", "item_id").filter(F.col("item").isNotNull()))
    if known.isEmpty():
        return known.sparkSession.createDataFrame([("{}",)], "value string")
    place = F.struct("item_id", "item")
    ends = known.agg(F.struct(F.min(place).alias("first"), F.max(place).alias("last"))).scalar()
    entry = F.to_json(F.create_map("item", "item_id"))
    marked = known.select("item_id", "item", entry.alias("entry"), (place == ends["first"]).alias("opens"), (place == ends["last"]).alias("closes"))
    return marked.orderBy("item_id", "item").select(F.concat(
        F.when(F.col("opens"), "{").otherwise(","), F.expr("substring(entry, 2, length(entry) - 2)"), F.when(F.col("closes"), "}").otherwise("")).alias("value"))


def write_vocab_json(vocabulary: DataFrame, path: str) -> None:
    """Part files that are one JSON object if put together in their order; each is written by a task of its own."""
    vocab_lines(vocabulary).write.mode("overwrite").text(path)


def write_stats_csv(stats: DataFrame, path: str) -> None:
    stats.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def partitioned_time_write(df: DataFrame, path: str, column: str = "day_idx") -> None:
    """One folder per value of the time column."""
    df.hint("rebalance", column).write.mode("overwrite").partitionBy(column).parquet(path)


def write_splits(df: DataFrame, path: str, part: str | None = None, split: str = "split") -> None:
    """Folders ``[<part>=.../]split=...``."""
    columns = ([part] if part else []) + [split]
    df.hint("rebalance", *columns).write.mode("overwrite").partitionBy(*columns).parquet(path)
