"""Joins with dictionaries and other lookup tables.

A lookup table is computed once and broadcast only if it is proven small; see ``small_table``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.messages import display_name
from sessionloom.operators.scale import materialize, small_table


def last_wins(table: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """One row per key with the value listed last."""
    return table.groupBy(key).agg(F.max_by(value, seq).alias(value))


def first_wins(table: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key: the first in the given order."""
    others = [c for c in table.columns if c != key]
    best = F.min_by(F.struct(*others), F.struct(*order))
    return table.groupBy(key).agg(best.alias("_best")).select(key, "_best.*")


def translate(df: DataFrame, dictionary: DataFrame, keep_unmapped: bool = False,
              message: str = "message", label: str = "label", out: str = "message_eng") -> DataFrame:
    """Look up the label of each message; unmapped rows are dropped or keep their text.

    A null label counts as unmapped when rows are dropped.
    """
    pairs = dictionary.select(F.col(message).alias("_key"), F.col(label).alias(out))
    if not keep_unmapped:
        pairs = pairs.filter(F.col(out).isNotNull())
    pairs = small_table(pairs.withColumn("_hit", F.lit(True)))
    joined = df.join(pairs, F.col(message) == F.col("_key"), "left" if keep_unmapped else "inner")
    if keep_unmapped:
        joined = joined.withColumn(out, F.when(F.col("_hit"), F.col(out)).otherwise(F.col(message)))
    return joined.drop("_key", "_hit")


def attach_side_info(df: DataFrame, info: DataFrame, item: str = "item_id",
                     key: str = "message_content") -> DataFrame:
    """Add description, classification and target of the item; duplicate keys fan out."""
    side = info.select(F.col(key).alias("_key"), F.col("summary").alias("description"),
                       "classification", "target")
    return df.join(small_table(side), F.col(item) == F.col("_key"), "left").drop("_key")


def encode_items(df: DataFrame, vocabulary: DataFrame, item: str = "item_id",
                 default: int | None = None) -> DataFrame:
    """Replace item names by vocabulary ids; unknown names give null or ``default``."""
    words = small_table(vocabulary.select(F.col("item").alias("_key"), F.col("item_id").alias("_id")))
    code: Column = F.col("_id")
    if default is not None:
        code = F.coalesce(code, F.lit(default).cast("bigint"))
    return (df.join(words, F.col(item) == F.col("_key"), "left")
            .withColumn(item, code).drop("_key", "_id"))


def decode_items(df: DataFrame, codes: DataFrame, vocabulary: DataFrame, code: str = "code",
                 out: str = "name") -> DataFrame:
    """Encoded id -> vocabulary id -> shown name; anything unknown is ``Unknown``."""
    first = codes.select(F.col("code").alias("_code"), F.col("value").alias("_word"))
    second = vocabulary.select(F.col("item_id").alias("_id"), F.col("item").alias("_name"))
    return (df.join(small_table(first), F.col(code) == F.col("_code"), "left")
            .join(small_table(second), F.col("_word") == F.col("_id"), "left")
            .withColumn(out, display_name("_name")).drop("_code", "_word", "_id", "_name"))


def _mapped_list(df: DataFrame, values: str, lookup: DataFrame, on: str, mapped: Column, out: str, kind: str) -> DataFrame:
    """A list column mapped through a lookup, in order.

    Rows are told apart by a number of their own, so equal keys do no harm, and the input is
    computed once.  An empty or null list gives an empty list of ``kind``."""
    rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()))
    flat = (rows.select("_row", F.posexplode(values).alias("_pos", "_value"))
            .join(lookup, F.col("_value") == F.col(on), "left").withColumn("_mapped", mapped))
    back = flat.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_pos", "_mapped"))).alias("_list"))
    return rows.join(back, "_row", "left").withColumn(out, F.coalesce(
        F.transform("_list", lambda x: x["_mapped"]), F.array().cast(kind))).drop("_list", "_row")


def decode_lists(df: DataFrame, names: DataFrame, values: str, out: str = "names") -> DataFrame:
    """Map every id of a list to its name, in order; missing ids read ``not found(<id>)``."""
    lookup = small_table(names.select(F.col("id").alias("_id"), F.col("name").alias("_name")))
    text = F.coalesce("_name", F.concat(F.lit("not found("), F.col("_value").cast("string"), F.lit(")")))
    return _mapped_list(df, values, lookup, "_id", text, out, "array<string>")


def semi(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(small_table(keys.select(on)), on, "left_semi")


def anti(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(small_table(keys.select(on)), on, "left_anti")


def join_sums_back(df: DataFrame, group: str, event: str, value: str, out: str) -> DataFrame:
    """Sum of ``value`` per (group, event), on every row.

    Summed first and joined back: partial sums keep a frequent pair off one task.
    """
    sums = df.groupBy(group, event).agg(F.sum(value).alias(out))
    return df.join(small_table(sums), [group, event], "left")


def lookup_embeddings(df: DataFrame, table: DataFrame, values: str, dims: int, out: str = "vectors", reserved: int = 3) -> DataFrame:
    """Replace each id of a list by its vector; reserved and unknown ids give zeros."""
    vectors = small_table(table.select(F.col("code").alias("_code"), F.col("vector").alias("_vector")))
    zero = F.array_repeat(F.lit(0.0), dims)
    vector = F.when(F.col("_value") < reserved, zero).otherwise(F.coalesce(F.col("_vector").cast("array<double>"), zero))
    return _mapped_list(df, values, vectors, "_code", vector, out, "array<array<double>>")
