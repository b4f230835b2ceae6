"""Message functions and filters: one row per rule."""

import pytest
from pyspark.sql import functions as F

from sessionloom import constants as C
from sessionloom.functions import messages as M
from sessionloom.operators import filters, lookups, redundancy, stats


def values(spark, function, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, m string")
    return [r["v"] for r in df.select("i", function("m").alias("v")).orderBy("i").collect()]


def test_extract(spark):
    assert values(spark, M.extract_command, "End Event: A: b (1)", "no colon", ": x", "a: ", None) == [
        "A: b (1)", None, "x", None, None]
    assert values(spark, M.extract_command_ids, "Tool: X (-26) (0)", "Menu: Y (3)", "End Event: Z (a)", "Undo Event: Q (5)") == [
        "T: -26 0", "M: 3", "", "5"]
    assert values(spark, M.extract_category, "Tool: X: y", "none", ":x") == ["Tool", None, ""]
    assert values(spark, M.strip_command_ids, "X (-26) (0)", "X (1)(2)", "X(1)", "X (1) y") == ["X (-26)", "X", "X(1)", "X (1) y"]
    assert values(spark, M.strip_max_marker, "a (242)(MAX-12)(MAX-3)", "(MAX-)") == ["a (242)", "(MAX-)"]
    assert values(spark, M.display_name, "End Event: A End Event: B", None) == ["A B", "Unknown"]
    assert values(spark, M.normalize_quotes, "it's 'x'") == ["its x"]


def test_printable_and_ascii(spark):
    assert values(spark, M.is_printable, "ab~ \t\n\r\x0b\x0c", "é", "\x7f", "\x1b", "a\n") == [True, False, False, False, True]
    assert values(spark, M.is_ascii, "a\x7f", "é", "") == [True, False, True]


def test_times(spark):
    string = lambda c: M.to_unix_seconds(c, "string")
    assert values(spark, string, "2024-01-01 00:00:01.999999", "2024-01-01 00:00:01.5", "2024-01-01", None) == [1704067201, 1704067201, 0, 0]
    assert values(spark, M.live_ts_to_unix, "1/2/2024 03:04:05 0.75 +0100", "01/02/2024 03:04:05 0 -02:00", "1/2/2024 03:04:05 x +0000",
                  "1/2/2024 03:04:05", None) == [1704161045, 1704171845, 0, 0, 0]


def test_noise(spark):
    suffix = lambda c: M.has_suffix(c, C.NOISE_SUFFIXES)
    live = lambda c: M.has_suffix(c, C.NOISE_SUFFIXES, spare_menu=False)
    texts = ["Tool: Zoom (-242)", "Menu: Zoom (-242)", "Tool: Zoom (-242)\n", "a\nTool: Zoom (-242)", "Tool: Zoom (-242) ", "X (242)(MAX-1)", "(8)"]
    assert values(spark, suffix, *texts) == [True, False, True, False, False, False, True]
    assert values(spark, live, *texts) == [True, True, True, True, False, False, True]
    prefix = lambda c: M.has_prefix(c, C.NOISE_PREFIXES)
    assert values(spark, prefix, "Event: x", "End Event: x", "Menu: Undo it", "x Event:", "Abort Event:") == [True, False, True, False, False]
    noise = lambda c: M.is_noise(c, C.NOISE_PREFIXES, C.NOISE_SUFFIXES)
    assert values(spark, noise, *texts, "Event: x") == [True, False, True, False, False, False, True, True]


def test_prefilter_order(spark):
    df = spark.createDataFrame([
        ("s", "2024-01-01 00:00:00.1", "Tool", "Tool: Zoom (-242)"), ("s", "bad", "Tool", "Tool: Zoom (-242)(MAX-1)"),
        ("s", "2024-01-01 00:00:00.1", "tool", "Tool: A"), ("s", "2024-01-01 00:00:00.1", "xMenu", "Menu: A"),
        ("s", "2024-01-01 00:00:00.1", "UNDO", None)], "session string, ts string, cat string, message string")
    got = [tuple(r) for r in filters.prefilter(df).collect()]
    assert got == [("s", 0, "Tool", "Tool: Zoom (-242)")]
    assert filters.keep_categories(df, contains=True).count() == 4


def test_frequency_bounds(spark):
    df = spark.createDataFrame([("a",)] * 10 + [("b",)] * 11 + [("c",)] * 9, "v string")
    assert {r["v"] for r in filters.drop_infrequent(df, "v", 10, True).collect()} == {"b"}
    assert {r["v"] for r in filters.drop_infrequent(df, "v", 10, False).collect()} == {"a", "b"}


def test_dictionary_lookup(spark):
    table = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", None, 3)], "message string, label string, seq int")
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "message string")
    last = lookups.last_wins(table, "message", "label", "seq")
    assert [r["message_eng"] for r in lookups.translate(rows, last).collect()] == ["y"]
    kept = {r["message"]: r["message_eng"] for r in lookups.translate(rows, last, keep_unmapped=True).collect()}
    assert kept == {"a": "y", "b": None, "c": "c"}


def test_confidence_per_file(spark):
    rows = [("A", "x", 10, 4, 0), ("A", "y", 10, 9, 0), ("A", "x", 30, 16, 1), ("B", "End Event: Delete (58)", 5, 5, 0),
            ("C", "x", 1500, 200, 0), ("C", "y", 1500, 100, 0), ("D", "x", 100, 41, 0), ("D", "y", 100, 40, 0)]
    df = spark.createDataFrame(rows, "command string, event string, sup1 bigint, sup2 bigint, file_index int")
    got = {(r["command"], r["event"]): (r["sup1_group_sum"], r["sup2_sum"]) for r in redundancy.pair_confidence(df).collect()}
    assert got == {("A", "x"): (40, 20), ("C", "x"): (1500, 200), ("D", "x"): (100, 41)}


def test_empty_totals(spark):
    empty = spark.createDataFrame([], "session string")
    assert tuple(stats.session_length_totals(empty).first()) == (0, 0, 0.0)


def test_tags(spark):
    df = filters.with_tags(spark.createDataFrame([(1, 2, 3)], "a int, b int, c int"), {"a": ["item"], "c": ["session"]})
    assert filters.select_by_tag(df, ["item", "x"]).columns == ["a"]
    assert filters.filter_features(df, ["a"], exclude=True).columns == ["b", "c"]


def test_unequal_features(spark):
    from sessionloom.operators.features import aggregate_features

    df = spark.createDataFrame([([1.0, 2.0], [1.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="not equal"):
        aggregate_features(df, ["a", "b"], "element-wise-sum").select(F.col("combined")).collect()
