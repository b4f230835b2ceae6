"""From raw documents to packed training sequences: five stages, each a Spark job over a written table.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's ``docs``.  All but the
last return the columns of ``documents``.  Every row is judged by its own text, also if it
shares its id, or has none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm import decontam, neardup, packing, quality, repeats
from sessionloom.llm.queries import TOKENIZER, table
from sessionloom.llm.repeats import text_key
from sessionloom.operators.scale import broadcast_if_small, materialize


def _small_batches(spark: SparkSession) -> None:
    """Arrow batches of some MB of text: the default of 10,000 rows takes several times as much in every worker."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, "2000")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier rejects go.  Null and empty texts are judged like others; an empty table stays
    empty, further columns stay, whatever their names."""
    _small_batches(spark)
    return quality.drop_rejected(docs, table(spark, sf_dir, "labels"))


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row``: a number of each (id, text) in the order of ids, null without an id."""
    rows = docs.withColumn("_text", text_key("text"))
    pairs = rows.filter("doc_id IS NOT NULL").select("doc_id", "_text")
    several = materialize(pairs.groupBy("doc_id").agg(F.min("_text").alias("low"), F.max("_text").alias("high")).filter("low <> high"))
    if several.isEmpty():
        return docs.withColumn("_row", F.col("doc_id"))
    numbers = materialize(pairs.distinct().orderBy("doc_id", "_text").select("doc_id", "_text", F.monotonically_increasing_id().alias("_row")))
    return materialize(rows.join(broadcast_if_small(numbers), ["doc_id", "_text"], "left").select(*docs.columns, "_row"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The text with the smallest id of each group stays, in one row; rows without an id and those of null or empty
    texts stay.  An empty table stays empty, further columns stay."""
    _small_batches(spark)
    rows = _numbered(docs)
    copies = materialize(neardup.near_duplicates(rows, "_row").filter("NOT kept").select("_row").distinct())
    left = rows.join(broadcast_if_small(copies), "_row", "left_anti")
    again = materialize(rows.groupBy("_row").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 AND _row IS NOT NULL").select("_row"))
    if not again.isEmpty():
        left = left.join(again, "_row", "left_anti").unionByName(left.join(again, "_row", "left_semi").dropDuplicates(["_row"]))
    return left.select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes and more that occur elsewhere too are cut out of the texts.  Every row stays, null texts stay
    null; ``n_chars``, if there is one, is that of the text that is left.  An empty table stays empty."""
    _small_batches(spark)
    cut = repeats.cut_repeats(docs)
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else cut


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a passage of the benchmark go; null and empty texts hold none.  An empty table stays empty, further
    columns stay."""
    _small_batches(spark)
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"), by_row=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences; a null text counts as empty.  An empty table gives no rows, further columns
    are not read."""
    _small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality", keep_good), ("near_duplicates", drop_near_duplicates), ("repeats", cut_repeats),
          ("decontamination", drop_leaks), ("packing", pack)]

# Spelled words, hashed groups and suffix order are not for SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
