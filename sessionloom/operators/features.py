"""Vocabulary, encoding, normalisation, embeddings and list features."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.constants import MAX_LIST_LENGTH, MIN_SESSION_LENGTH, RESERVED_CODES, WORKFLOW
from sessionloom.functions.vectors import truncate_l2
from sessionloom.operators.filters import min_length_sessions
from sessionloom.operators.lookups import first_wins
from sessionloom.operators.moments import vector_aggregate
from sessionloom.operators.ordered import global_number, sessionwise
from sessionloom.operators.scale import broadcast_if_small, materialize, once, small_table
from sessionloom.operators.sessions import groupby_lists, time_intervals


def build_vocabulary(messages: DataFrame, merged: DataFrame, item: str = "message_content",
                     cat: str = "cat") -> DataFrame:
    """Ids from 1: messages by falling count, then workflows by falling count, names on ties."""
    single = messages.groupBy(F.col(item).alias("item")).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(0).alias("_kind"), "item", "n")
    flows = merged.filter(F.col(cat) == WORKFLOW).groupBy(F.col(item).alias("item")).agg(
        F.count(F.lit(1)).alias("n")).select(F.lit(1).alias("_kind"), "item", "n")
    counted = materialize(single.unionByName(flows)).withColumn("_rank", -F.col("n"))
    return global_number(counted, ["_kind", "_rank", "item"], "item_id").select("item", "n", "item_id")


def categorify_table(df: DataFrame, column: str, reserved: int = RESERVED_CODES) -> DataFrame:
    """Codes of the values of a column with their sizes: most frequent first, from ``reserved``."""
    counted = materialize(
        df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("size"))).withColumn("_rank", -F.col("size"))
    coded = global_number(counted, ["_rank", "value"], "_n")
    return coded.select("value", "size", (F.col("_n") - 1 + reserved).alias("code"))


def categorify_tables(df: DataFrame, columns: Sequence[str], reserved: int = RESERVED_CODES) -> dict[str, DataFrame]:
    """``categorify_table`` of several columns: one pass counts the values of all, one numbering serves all."""
    kinds = [f"_c{i}" for i in range(len(columns))]
    values = df.select(*(F.col(c).alias(k) for c, k in zip(columns, kinds)))
    # The grouping id has a bit for every column that a row is not about.
    every = (1 << len(kinds)) - 1
    counted = values.groupingSets([[F.col(k)] for k in kinds], *kinds).agg(F.grouping_id().alias("_id"), F.count(F.lit(1)).alias("size"))
    own = F.coalesce(*(F.when((F.col("_id") == every - (1 << (len(kinds) - 1 - i))) & F.col(k).isNotNull(), F.lit(i)) for i, k in enumerate(kinds)))
    counted = materialize(counted.withColumns({"_column": own, "_rank": -F.col("size")}).filter(F.col("_column").isNotNull()))
    numbered = materialize(sessionwise(counted, lambda t: t.numbered("_n"), "_column", ("_rank", *kinds)))
    return {c: numbered.filter(F.col("_column") == i).select(F.col(k).alias("value"), "size", (F.col("_n") - 1 + reserved).alias("code"))
            for i, (c, k) in enumerate(zip(columns, kinds))}


def categorify(df: DataFrame, column: str, table: DataFrame | None = None,
               out: str | None = None) -> DataFrame:
    """Replace the values of a column by their codes; null and unknown values stay null."""
    table = categorify_table(df, column) if table is None else table
    codes = small_table(table.select(F.col("value").alias("_value"), F.col("code").alias("_code")))
    return (df.join(codes, F.col(column) == F.col("_value"), "left")
            .withColumn(out or column, F.col("_code")).drop("_value", "_code"))


def normalize(df: DataFrame, columns: dict[str, str], source: DataFrame | None = None) -> DataFrame:
    """Global z-scores (population deviation) as new columns, ``{column: new name}``.

    One combinable aggregate over ``source`` (default: ``df``) gives all means and deviations
    as a single scalar.
    """
    facts = (df if source is None else source).agg(F.struct(*[f.alias(f"{kind}_{i}") for i, c in enumerate(columns) for kind, f in (
        ("mean", F.avg(F.col(c).cast("double"))), ("std", F.stddev_pop(F.col(c).cast("double"))))])).scalar()
    out = df.withColumn("_facts", facts)
    for i, (column, name) in enumerate(columns.items()):
        gap = F.col(column).cast("double") - F.col("_facts")[f"mean_{i}"]
        std = F.col("_facts")[f"std_{i}"]
        out = out.withColumn(name, F.when(std > 0, gap / std).otherwise(gap))
    return out.drop("_facts")


def prepare_interactions(df: DataFrame, session: str = "session_anonymized", ts: str = "ts",
                         item: str = "message_content", order: Sequence[str] = ("ts", "seq"),
                         keep: Sequence[str] = ("seq",), source: DataFrame | None = None) -> DataFrame:
    """Interaction table: renamed columns, time since the previous row, no null rows."""
    timed = time_intervals(df, ts=ts, session=session, order=order, source=source)
    renamed = timed.select(
        F.col(session).alias("session_id"), F.col(item).alias("item_id"), F.col(ts).alias("timestamp"),
        "merge_count", "cat", "timestamp_interval", *keep)
    return renamed.dropna()


FEATURE_CODES = ("item_id", "classification", "target", "cat")
FEATURE_NORMS = {"timestamp_interval": "timestamp_interval_norm_global", "merge_count": "merge_count_norm"}


def session_features(df: DataFrame, session: str = "session_id", order: Sequence[str] = ("timestamp", "seq"),
                     codes: Sequence[str] = FEATURE_CODES, norms: dict[str, str] = FEATURE_NORMS,
                     keep: Sequence[str] = ("timestamp_interval", "merge_count"),
                     longest: int = MAX_LIST_LENGTH, minimum: int = MIN_SESSION_LENGTH) -> DataFrame:
    """Training rows: encode, normalise, one row per session, last ``longest`` elements of
    each list, sessions longer than ``minimum``.

    The length test runs on the counts before any list is built.
    """
    df = once(df)  # read for the lengths, the codes, the moments and the lists
    counts = df.groupBy(session).agg(F.count(codes[0]).alias("_n"))
    long_enough = min_length_sessions(counts, "_n", minimum)
    # Codes and moments come from the input as it is, not from the table that grows join by join.
    source = df
    for column, table in categorify_tables(df, codes).items():
        df = categorify(df, column, table)
    df = normalize(df, norms, source)
    lists = groupby_lists(df, session, order, [*codes, *keep, *norms.values()], last=longest).drop("piece")
    return lists.join(long_enough.withColumnRenamed("_n", f"{codes[0]}-count"), session)


def embedding_table(vectors: DataFrame, codes: DataFrame, dims: int, item: str = "item",
                    vector: str = "embedding", order: Sequence[str] = ("seq",),
                    reserved: int = RESERVED_CODES) -> DataFrame:
    """Vectors by item code: the first vector of an item counts, cut and scaled, after
    ``reserved`` zero rows."""
    first = first_wins(vectors, item, order)
    keyed = first.join(broadcast_if_small(codes.select(F.col("value").alias(item), "code")), item)
    rows = keyed.select(F.col("code").cast("bigint").alias("code"), truncate_l2(vector, dims).alias("vector"))
    zeros = vectors.sparkSession.range(reserved).select(
        F.col("id").alias("code"), F.array_repeat(F.lit(0.0), dims).alias("vector"))
    return zeros.unionByName(rows).orderBy("code")


def combine_vectors(df: DataFrame, key: str, vector: str, how: str = "mean") -> DataFrame:
    """One vector per key from the vectors of its rows; whole vectors combine before the shuffle."""
    return vector_aggregate(df, [key], vector, how)


def _add(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: a + b)


def aggregate_features(df: DataFrame, features: Sequence[str], how: str = "concat",
                       item: str | None = None, out: str = "combined") -> DataFrame:
    """Combine vector columns: ``concat`` or ``stack`` by sorted name, ``element-wise-sum``, or
    ``element-wise-sum-item-multi`` (item times the sum of the others).

    Vectors of unequal length raise an error, except for ``concat``.
    """
    names = sorted(features)
    if how == "concat":
        return df.withColumn(out, F.concat(*names))
    even = reduce(Column.__and__, [F.size(n) == F.size(names[0]) for n in names], F.lit(True))
    if how == "stack":
        value = F.array(*names)
    elif how == "element-wise-sum":
        value = reduce(_add, [F.col(n) for n in names])
    elif how == "element-wise-sum-item-multi":
        if item is None:
            raise ValueError("name the item column")
        others = reduce(_add, [F.col(n) for n in names if n != item])
        value = F.zip_with(F.col(item), others, lambda a, b: a * b)
    else:
        raise ValueError(f"unknown way to aggregate: {how}")
    return df.withColumn(out, F.when(even, value).otherwise(
        F.raise_error(F.lit("the shapes of all input features are not equal"))))


def to_values_offsets(df: DataFrame, key: str, values: str) -> tuple[DataFrame, DataFrame]:
    """Ragged export: flat values with their place, and the running offsets from 0.

    Offsets are a running sum over list lengths in key order, done in blocks on large tables.
    """
    marked = materialize(df.select(key, values).withColumn("_id", F.monotonically_increasing_id()))
    # Only sizes are summed up in order; the lists stay where they are and get their place by row number.
    sized = marked.select(key, "_id", F.size(values).cast("bigint").alias("_size"), F.lit(0).alias("_all"))
    spans = materialize(sessionwise(sized, lambda t: t.running(_end=("sum", F.col("_size"))).numbered("_row"), "_all", (key, "_id")))
    starts = marked.join(spans.select("_id", (F.col("_end") - F.col("_size")).alias("_start")), "_id")
    flat = starts.select(key, "_start", F.posexplode(values).alias("_at", "value")).select(
        (F.col("_start") + F.col("_at")).alias("position"), "value")
    offsets = spans.select(F.col("_row").alias("row"), F.col("_end").alias("offset"))
    head = df.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("row"),
                                           F.lit(0).cast("bigint").alias("offset"))
    return flat, head.unionByName(offsets)


def pad_sequences(values, length: int) -> Column:
    """Right-pad with 0 to ``length``; longer lists are cut to their first elements."""
    values = F.col(values) if isinstance(values, str) else values
    cut = F.slice(values, 1, length)
    return F.concat(cut, F.array_repeat(F.lit(0), length - F.size(cut)))


def pad_to_batch(df: DataFrame, batch: str, values: str, max_length: int, out: str = "padded") -> DataFrame:
    """Pad to the longest list of the batch, at most ``max_length``."""
    longest = small_table(df.groupBy(batch).agg(
        F.least(F.max(F.size(values)), F.lit(max_length)).alias("_len")))
    joined = df.join(longest, batch)
    cut = F.slice(values, F.lit(1), F.col("_len"))
    return joined.withColumn(out, F.concat(cut, F.array_repeat(
        F.lit(0), F.col("_len") - F.size(cut)))).drop("_len")
