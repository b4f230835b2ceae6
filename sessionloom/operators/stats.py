"""Counts and statistics of a log.  Every count combines partials before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.constants import RESERVED_CODES, RESERVED_WEIGHT
from sessionloom.functions.messages import strip_max_marker
from sessionloom.operators.scale import small_table


def message_counts(df: DataFrame, column: str = "message", strip_marker: bool = False) -> DataFrame:
    """Rows per value, most frequent first; ``strip_marker`` is for raw data."""
    if strip_marker:
        df = df.withColumn(column, strip_max_marker(column))
    return (df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc(column)))


def session_lengths(df: DataFrame, session: str = "session") -> DataFrame:
    return df.groupBy(session).agg(F.count(F.lit(1)).alias("length"))


def session_length_totals(df: DataFrame, session: str = "session") -> DataFrame:
    """Number of sessions, rows and the average length (0 if there are none)."""
    return session_lengths(df, session).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("rows"),
        F.coalesce(F.avg("length"), F.lit(0.0)).alias("avg_length"))


def session_stats(df: DataFrame, session: str = "session", ts: str = "ts") -> DataFrame:
    """Seconds from first to last row, and rows, per session."""
    return df.groupBy(session).agg(
        (F.max(ts) - F.min(ts)).alias("seconds"), F.count(F.lit(1)).alias("rows"))


def session_stats_both(raw: DataFrame, filtered: DataFrame, session: str = "session",
                       ts: str = "ts") -> DataFrame:
    """Session statistics before and after filtering, side by side."""
    before = session_stats(raw, session, ts).toDF(session, "seconds_before", "rows_before")
    after = session_stats(filtered, session, ts).toDF(session, "seconds_after", "rows_after")
    return before.join(after, session, "left")


def session_stats_summary(stats: DataFrame) -> DataFrame:
    """Mean rows and mean length in minutes over all sessions."""
    return stats.agg(F.avg("rows").alias("mean_rows"),
                     (F.avg("seconds") / 60).alias("mean_minutes"))


def histogram(df: DataFrame, column: str, bins: int = 100) -> DataFrame:
    """Equal-width bins between the smallest and the largest value; the last bin is closed."""
    value = F.col(column).cast("double")
    bounds = df.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high"))).scalar()
    low, high = F.col("_bounds.low"), F.col("_bounds.high")
    bucket = F.when(high == low, F.lit(bins // 2)).otherwise(
        F.least(F.floor((value - low) / ((high - low) / bins)), F.lit(bins - 1)))
    return (df.select(column, bounds.alias("_bounds")).filter(value.isNotNull())
            .select(bucket.cast("int").alias("bin"))
            .groupBy("bin").agg(F.count(F.lit(1)).alias("rows")))


def category_counts(df: DataFrame, cat: str = "cat") -> DataFrame:
    return df.groupBy(cat).agg(F.count(F.lit(1)).alias("count"))


def top_commands(df: DataFrame, k: int = 50, by: Sequence[str] = (),
                 message: str = "message", strip_marker: bool = True) -> DataFrame:
    """The ``k`` most frequent messages, overall or inside each ``by`` group.

    Ranking runs on the counted table, and Spark keeps only ``k`` rows per group and task
    before it shuffles them.
    """
    text = strip_max_marker(message) if strip_marker else F.col(message)
    counts = df.groupBy(*by, text.alias(message)).agg(F.count(F.lit(1)).alias("count"))
    if not by:
        top = counts.orderBy(F.desc("count"), F.asc(message)).limit(k)
        return top.withColumn("rank", F.row_number().over(
            Window.orderBy(F.desc("count"), F.asc(message))))
    order = Window.partitionBy(*by).orderBy(F.desc("count"), F.asc(message))
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hourly_activity(df: DataFrame, ts: str = "ts") -> DataFrame:
    return (df.groupBy(F.date_format(ts, "yyyy-MM-dd HH").alias("hour"))
            .agg(F.count(F.lit(1)).alias("count")))


def rare_items(df: DataFrame, item: str, below: int = 10) -> DataFrame:
    return (df.groupBy(item).agg(F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") < below).select(item))


def minority_sessions(df: DataFrame, item: str = "item", session: str = "session",
                      below: int = 10) -> DataFrame:
    """Every row of the sessions in which an item occurs that is rare in the whole corpus."""
    marked = df.join(small_table(rare_items(df, item, below)), item, "left_semi")
    return df.join(small_table(marked.select(session).distinct()), session, "left_semi")


def minority_counts(df: DataFrame, minority: DataFrame, session: str = "session") -> DataFrame:
    """Sessions in all, and sessions with a rare item."""
    every = df.agg(F.countDistinct(session).alias("sessions"))
    some = minority.agg(F.countDistinct(session)).scalar()
    return every.select("sessions", some.alias("minority_sessions"))


def minority_coverage(splits: dict[str, DataFrame], minority: DataFrame,
                      session: str = "session") -> DataFrame:
    """Distinct minority sessions found in each split."""
    wanted = small_table(minority.select(session).distinct())
    parts = [df.join(wanted, session, "left_semi")
             .agg(F.countDistinct(session).alias("minority_sessions"))
             .select(F.lit(name).alias("split"), "minority_sessions")
             for name, df in splits.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def class_weights(sizes: DataFrame, code: str = "code", size: str = "size",
                  reserved: int = RESERVED_CODES) -> DataFrame:
    """Weight of each class code, inverse to its size and scaled to sum 1.

    The reserved codes come first with a tiny weight.
    """
    total = sizes.agg(F.sum(size)).scalar()
    classes = sizes.agg(F.count(F.lit(1))).scalar()
    raw = sizes.withColumn("_w", total / ((classes + reserved) * F.col(size)))
    scaled = raw.select(F.col(code).cast("bigint").alias(code),
                        (F.col("_w") / raw.agg(F.sum("_w")).scalar()).alias("weight"))
    head = sizes.sparkSession.range(reserved).select(
        F.col("id").alias(code), F.lit(RESERVED_WEIGHT).alias("weight"))
    return head.unionByName(scaled)


def first_seen(df: DataFrame, item: str = "item", ts: str = "ts",
               out: str = "item_ts_first") -> DataFrame:
    """Earliest time of the item, on every row of the item.

    Aggregated first and joined back, so a popular item is never one window.
    """
    return df.join(small_table(df.groupBy(item).agg(F.min(ts).alias(out))), item, "left")
