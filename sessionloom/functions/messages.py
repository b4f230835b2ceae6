"""Column functions on log messages and their time stamps.

Patterns use ``(?d)`` and ``\\z`` so that ``.`` and ``$`` treat only ``\\n`` as a line end.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_MARKER = r"\(MAX-\d+\)"
ID_GROUP = r"\((-?\d+)\)"


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def _one_of(texts: Iterable[str]) -> str:
    return "(?:" + "|".join(re.escape(t) for t in texts) + ")"


def prefix_pattern(prefixes: Iterable[str]) -> str:
    """Prefixes are patterns, not plain text."""
    return "^(?:" + "|".join(prefixes) + ")"


def suffix_pattern(suffixes: Iterable[str], spare_menu: bool = True) -> str:
    """Plain-text suffixes at the end of the message, before at most one line feed.

    With ``spare_menu`` the line is taken as a whole and its end is compared once, so the
    pattern is not tried again at every place; menu rows and messages with a line feed
    elsewhere then never match.
    """
    if spare_menu:
        return "^(?!Menu:).*+(?<=" + _one_of(suffixes) + ")\\n?\\z"
    return _one_of(suffixes) + "\\n?\\z"


def has_prefix(message, prefixes: Iterable[str]) -> Column:
    return _col(message).rlike(prefix_pattern(prefixes))


def has_suffix(message, suffixes: Iterable[str], spare_menu: bool = True) -> Column:
    return _col(message).rlike("(?d)" + suffix_pattern(suffixes, spare_menu))


def is_noise(message, prefixes: Iterable[str], suffixes: Iterable[str], spare_menu: bool = True) -> Column:
    """Prefix or suffix rule, as one pattern.

    One pattern reads the message once.  Separate tests on a computed message would have
    Spark push each of them down with its own copy of the computation.
    """
    return _col(message).rlike(f"(?d)(?:{prefix_pattern(prefixes)})|(?:{suffix_pattern(suffixes, spare_menu)})")


def has_menu_suffix(message, suffixes: Iterable[str]) -> Column:
    """A menu row ends with one of the suffixes; no suffixes match nothing."""
    suffixes = list(suffixes)
    if not suffixes:
        return F.lit(False)
    return _col(message).rlike("(?d)Menu: .*(?:" + "|".join(re.escape(s) for s in suffixes) + ")$")


def strip_max_marker(message) -> Column:
    return F.regexp_replace(_col(message), MAX_MARKER, "")


def to_unix_seconds(ts, kind: str = "timestamp_ntz") -> Column:
    """Whole seconds since the epoch, cut towards zero; unreadable values give 0.

    ``kind`` is the column's type: ``timestamp_ntz``, ``timestamp`` or ``string``.  Values
    without a zone are UTC, whatever the session's time zone is.
    """
    value = _col(ts)
    if kind == "timestamp_ntz":
        seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), value)
    else:
        if kind == "string":
            value = F.try_to_timestamp(F.concat(value, F.lit(" +0000")), F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS xx"))
        seconds = (F.unix_micros(value) / 1_000_000).cast("bigint")
    return F.coalesce(seconds, F.lit(0).cast("bigint"))


def live_ts_to_unix(ts) -> Column:
    """``m/d/Y H:M:S fraction zone`` to seconds: the fraction token is dropped; errors give 0."""
    pattern = r"^\s*(\S+)\s+(\S+)\s+[-+]?(?:\d+\.?\d*|\.\d+)\s+(.+?)\s*$"
    text = F.concat_ws(" ", *[F.regexp_extract(_col(ts), pattern, i) for i in (1, 2, 3)])
    parsed = F.coalesce(*[F.try_to_timestamp(text, F.lit(f"M/d/yyyy H:m:s {zone}"))
                          for zone in ("xx", "xxx", "X")])
    return F.coalesce(F.unix_seconds(parsed), F.lit(0).cast("bigint"))


def extract_command(message) -> Column:
    """Text after the first ``": "``; null if there is none."""
    return F.nullif(F.regexp_extract(_col(message), r"(?d): (.+)$", 1), F.lit(""))


def extract_command_ids(message) -> Column:
    """All ids in round brackets, joined by a blank and marked by the kind of message."""
    message = _col(message)
    ids = F.array_join(F.regexp_extract_all(message, F.lit(ID_GROUP), F.lit(1)), " ")
    mark = (F.when(message.startswith("Tool:"), "T: ")
            .when(message.startswith("Menu:"), "M: ")
            .when(message.startswith("End Event:"), "E: ")
            .otherwise(""))
    return F.when(ids != "", F.concat(mark, ids)).otherwise(ids)


def extract_category(message) -> Column:
    """Text before the first colon; null if there is no colon."""
    message = _col(message)
    pattern = r"(?d)^(.*?):"
    return F.when(message.rlike(pattern), F.regexp_extract(message, pattern, 1))


def strip_command_ids(message) -> Column:
    """Remove one blank and the bracketed ids that follow it directly at the end."""
    return F.regexp_replace(_col(message), r"(?d) (\(-?\d+\))+$", "")


def is_printable(text) -> Column:
    """Only printable ASCII, tab, line feed, carriage return, vertical tab and form feed."""
    return _col(text).rlike(r"^[\x20-\x7e\t\n\r\x0b\x0c]*\z")


def is_ascii(text) -> Column:
    return _col(text).rlike(r"^[\x00-\x7f]*\z")


def display_name(name) -> Column:
    """Name as shown to the user; unknown items are called ``Unknown``."""
    return F.replace(F.coalesce(_col(name), F.lit("Unknown")), F.lit("End Event: "), F.lit(""))


def normalize_quotes(message) -> Column:
    return F.translate(_col(message), "'", "")
