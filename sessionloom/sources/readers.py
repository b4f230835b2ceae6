"""Readers with explicit schemas; nothing is inferred from the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.operators.lookups import last_wins
from sessionloom.operators.sessions import drop_repeats
from sessionloom.operators.stats import first_seen

LOG_COLUMNS = ("session_anonymized", "ts", "cat", "message")

LIVE_SCHEMA = T.StructType([
    T.StructField("ts", T.StringType()),
    T.StructField("session", T.StringType()),
    T.StructField("cat", T.StringType()),
    T.StructField("message", T.StringType()),
])

CLICK_SCHEMA = T.StructType([
    T.StructField("session_id", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("item_id", T.LongType()),
    T.StructField("category", T.StringType()),
])


def read_logs(spark: SparkSession, path: str, columns=LOG_COLUMNS, seq: str | None = None) -> DataFrame:
    """All Parquet files below ``path``, four columns; other columns are never read.

    ``seq`` adds the ingest order: file by name, then row of the file.
    """
    files = spark.read.option("recursiveFileLookup", True).parquet(path)
    order = [F.struct("_metadata.file_path", "_metadata.row_index").alias(seq)] if seq else []
    return files.select(*columns, *order)


def read_json_log(spark: SparkSession, path: str) -> DataFrame:
    """Live log with one JSON object per line."""
    return spark.read.schema(LIVE_SCHEMA).json(path)


def read_csv_logs(spark: SparkSession, path: str, schema: T.StructType | None = None, by_name: bool = False) -> DataFrame:
    """All CSV files of a folder, with a header line; a file whose columns differ fails.

    With ``by_name`` files may order their columns differently or lack some: files of the same header are read
    together, and the groups are put together by column name.  ``schema`` then gives the columns and
    types of the result.
    """
    def read(paths, kind: T.StructType | None) -> DataFrame:
        reader = spark.read.option("header", True).option("multiLine", False).option("enforceSchema", False)
        return (reader.schema(kind) if kind else reader).csv(paths)

    if not by_name:
        return read(path, schema)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    first = lines.filter("at = 0").withColumn("n", F.monotonically_increasing_id()).groupBy("file").agg(F.min_by("value", "n").alias("header"))
    headers = first.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("header").collect()
    parts = []
    for row in headers:
        found = read(row["files"], None)
        if schema:
            found = found.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields if f.name in found.columns))
        parts.append(found)
    if schema:
        parts.append(spark.createDataFrame([], schema))
    if not parts:
        raise ValueError(f"no CSV file with a header in {path}")
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return whole.select(*schema.names) if schema else whole


def read_clicks_csv(spark: SparkSession, path: str) -> DataFrame:
    """Click log without a header line; neighbouring repeats are dropped and the first time
    of every item is added."""
    clicks = spark.read.schema(CLICK_SCHEMA).csv(path)
    kept = drop_repeats(clicks, "item_id", session="session_id", order=("timestamp", "item_id", "category"))
    return first_seen(kept, "item_id", "timestamp")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Message dictionary with ``message``, ``label`` and, if present, ``seq``; the last row of a
    message wins.  Without ``seq`` rows count by file name and line."""
    table = spark.read.option("header", True).csv(path)
    if "seq" not in table.columns:
        table = table.select("*", _line_order().alias("seq"))
    else:
        table = table.withColumn("seq", F.col("seq").cast("bigint"))
    return last_wins(table, "message", "label", "seq")


def _line_order():
    """Orders the rows of text files by file, block of the file and line; blocks are read by different tasks."""
    return F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """Vocabulary from a JSON object ``{item: id}`` in one or several files.

    Lines are read by several tasks, so an object should have an entry per line, as ``write_vocab_json``
    and indented JSON have; what stands in one line is one row.  The last id of an item counts, by file
    name, line and place in the line.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", r"^\s*[{,]?\s*|\s*[,}]?\s*$", "").alias("body"), _line_order().alias("line"))
    entries = lines.filter("body <> ''").select("line", F.posexplode(F.map_entries(F.from_json(
        F.concat(F.lit("{"), "body", F.lit("}")), "map<string,bigint>"))).alias("at", "e"))
    return entries.groupBy(F.col("e.key").alias("item")).agg(F.max_by("e.value", F.struct("line", "at")).alias("item_id"))


def read_docs(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """One row per text file."""
    files = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    return files.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
