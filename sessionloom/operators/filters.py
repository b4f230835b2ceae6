"""Row filters and projections of the log."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom import constants as C
from sessionloom.functions import messages as M
from sessionloom.operators.ordered import global_number
from sessionloom.operators.scale import materialize, small_table

TOP_ROWS = 100_000    # rows that may meet in one task

def keep_categories(df: DataFrame, categories: Iterable[str] = C.LOG_CATEGORIES,
                    cat: str = "cat", contains: bool = False) -> DataFrame:
    """Keep rows of the categories; ``contains`` accepts them anywhere inside the value."""
    categories = list(categories)
    if contains:
        return df.filter(F.col(cat).rlike("|".join(categories)))
    return df.filter(F.col(cat).isin(categories))


def drop_prefixes(df: DataFrame, prefixes: Iterable[str] = C.NOISE_PREFIXES,
                  message: str = "message") -> DataFrame:
    return df.filter(~M.has_prefix(message, prefixes))


def drop_suffixes(df: DataFrame, suffixes: Iterable[str] = C.NOISE_SUFFIXES,
                  message: str = "message", spare_menu: bool = True,
                  menu_suffixes: Sequence[str] = C.MENU_NOISE_SUFFIXES) -> DataFrame:
    kept = df.filter(~M.has_menu_suffix(message, menu_suffixes)) if spare_menu and menu_suffixes else df
    return kept.filter(~M.has_suffix(message, suffixes, spare_menu))


def strip_max_marker(df: DataFrame, message: str = "message") -> DataFrame:
    return df.withColumn(message, M.strip_max_marker(message))


def prefilter(df: DataFrame, message: str = "message", ts: str = "ts") -> DataFrame:
    """The batch noise filter; the order matters, since markers hide some suffixes."""
    return (df.transform(keep_categories)
            .filter(~M.is_noise(message, C.NOISE_PREFIXES, C.NOISE_SUFFIXES))
            .transform(strip_max_marker, message=message)
            .withColumn(ts, M.to_unix_seconds(ts, df.schema[ts].dataType.typeName())))


def prefilter_live(df: DataFrame, message: str = "message", ts: str = "ts") -> DataFrame:
    """The live noise filter: categories by substring, menu rows not spared, one suffix less."""
    suffixes = [s for s in C.NOISE_SUFFIXES if s != C.BATCH_ONLY_SUFFIX]
    return (df.transform(keep_categories, contains=True)
            .filter(~M.is_noise(message, C.NOISE_PREFIXES, suffixes, spare_menu=False))
            .transform(strip_max_marker, message=message)
            .withColumn(ts, M.live_ts_to_unix(ts)))


def drop_exact(df: DataFrame, messages: Iterable[str] = C.NOISE_MESSAGES,
               message: str = "message") -> DataFrame:
    return df.filter(~F.col(message).isin(list(messages)))


def frequent_values(df: DataFrame, column: str, threshold: int, inclusive: bool) -> DataFrame:
    """Values that survive: ``inclusive`` drops counts ``<= threshold``, else ``< threshold``."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    keep = F.col("_n") > threshold if inclusive else F.col("_n") >= threshold
    return counts.filter(keep).select(column)


def drop_infrequent(df: DataFrame, column: str, threshold: int = 10,
                    inclusive: bool = True) -> DataFrame:
    """Rows whose value occurs often enough."""
    return df.join(small_table(frequent_values(df, column, threshold, inclusive)),
                   column, "left_semi")


def drop_null_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(subset=list(columns) if columns else None)


def find_missing(df: DataFrame, columns: Sequence[str] = ("classification", "target")) -> DataFrame:
    """Rows in which any of the columns is null."""
    return df.filter(reduce(Column.__or__, [F.col(c).isNull() for c in columns]))


def drop_empty_ids(df: DataFrame, message: str = "message", out: str = "id") -> DataFrame:
    """Add the ids of the message; rows without an id are dropped."""
    return df.withColumn(out, M.extract_command_ids(message)).filter(F.col(out) != "")


def min_length_sessions(df: DataFrame, length: str, minimum: int = C.MIN_SESSION_LENGTH,
                        strict: bool = True) -> DataFrame:
    """Sessions longer than ``minimum`` (``strict``) or at least that long."""
    return df.filter(F.col(length) > minimum if strict else F.col(length) >= minimum)


def with_tags(df: DataFrame, tags: dict[str, Sequence[str]]) -> DataFrame:
    """Write feature tags into the column metadata."""
    return df.select(*[
        F.col(f.name).alias(f.name, metadata={**f.metadata, "tags": list(tags[f.name])})
        if f.name in tags else F.col(f.name) for f in df.schema.fields])


def select_by_tag(df: DataFrame, tags: Iterable[str]) -> DataFrame:
    """Columns that carry one of the tags."""
    wanted = set(tags)
    return df.select(*[f.name for f in df.schema.fields if wanted & set(f.metadata.get("tags", []))])


def filter_features(df: DataFrame, names: Iterable[str], exclude: bool = False) -> DataFrame:
    """Columns by name, in table order."""
    names = set(names)
    return df.select(*[c for c in df.columns if (c in names) != exclude])


def slice_rows(df: DataFrame, low: int, high: int, order: Sequence[str]) -> DataFrame:
    """Rows ``low`` to ``high`` (exclusive) of the table in the given order.

    Top rows are cut per partition before they meet.  Beyond ``TOP_ROWS`` the rows are numbered in ranges and
    picked by number, so no task holds ``high`` of them.
    """
    if high > TOP_ROWS:
        numbered = global_number(materialize(df), order, "_number")
        return numbered.filter((F.col("_number") > low) & (F.col("_number") <= high)).drop("_number").orderBy(*order)
    return df.orderBy(*order).offset(low).limit(max(high - low, 0))


def session_rows(df: DataFrame, value, session: str = "session") -> DataFrame:
    return df.filter(F.col(session) == value)


def merge_features(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Columns of several feature tables with one row per key; a later table wins a name."""
    def merge(left: DataFrame, right: DataFrame) -> DataFrame:
        kept = [c for c in left.columns if c == key or c not in right.columns]
        return left.select(*kept).join(right, key)
    return reduce(merge, tables)
