"""Live tables on feeds without an order of their own, zero vectors, infinite scores, repeated keys."""

import datetime
import json
import math

from sessionloom.functions import vectors
from sessionloom.operators import dictionary, lookups, retrieval
from sessionloom.operators.scale import once
from sessionloom.plans import catalog_rank
from sessionloom.streaming.live import LiveTable, live_history


def _append(path, *rows):
    with open(path, "a") as file:
        file.writelines(json.dumps(dict(zip(("ts", "session", "cat", "message"), r))) + "\n" for r in rows)


def test_appended_lines_of_a_growing_file_are_taken_in(spark, tmp_path):
    log = tmp_path / "in" / "log.json"
    log.parent.mkdir()
    live = LiveTable(spark, str(tmp_path / "out"), lambda rows: rows, buckets=4)
    _append(log, ("t1", "a", "c", "m1"), ("t2", "b", "c", "m2"))
    assert live.sync(str(log.parent)) == 0 and live.current().count() == 2
    assert live.sync(str(log.parent)) is None
    _append(log, ("t3", "a", "c", "m3"))
    _append(log.parent / "second.json", ("t4", "c", "c", "m4"))
    assert live.sync(str(log.parent)) == 1
    rows = live.current().orderBy("session", "seq").collect()
    assert [(r["session"], r["message"]) for r in rows] == [("a", "m1"), ("a", "m3"), ("b", "m2"), ("c", "m4")]


def test_rows_without_seq_are_ordered_as_read(spark, tmp_path):
    live = LiveTable(spark, str(tmp_path / "out"), lambda rows: rows, buckets=2)
    for version in range(2):
        live.apply(spark.createDataFrame([("t", "a", "c", f"m{version}", None)], "ts string, session string, cat string, message string, seq long"), version)
    assert [r["message"] for r in live.current().orderBy("seq").collect()] == ["m0", "m1"]


def test_inputs_of_the_live_queries_are_computed_once(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    events = [(i, at, i % 3, "click", 1.0, f'{{"k": {i}}}') for i in range(20)] + [(None, at, 1, "view", 1.0, '{"k": 1}')]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame(events, schema).write.parquet(str(tmp_path / "events.parquet"))
    log, *sides = catalog_rank._live_inputs(spark, str(tmp_path))
    assert not any("events.parquet" in file for file in log.inputFiles())
    assert all(once(side) is side for side in sides)
    assert log.count() == len(events) and log.columns == ["session", "ts", "seq", "cat", "message"]


def test_history(spark):
    rows = spark.createDataFrame([("a", 2, 1, "y"), ("a", 1, 9, "x"), ("b", 1, 1, "z")], "session string, timestamp int, seq int, item_id string")
    assert sorted(map(tuple, live_history(rows).collect())) == [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")]


def test_zero_vectors_have_similarity_zero(spark):
    words = spark.createDataFrame([(1, "a", [0.0, 0.0]), (1, "b", [1.0, 0.0]), (1, "c", [1.0, 0.0])], "id long, message string, embedding array<double>")
    row = dictionary.group_similarity(words).first()
    assert (row["length"], round(row["mean_similarity"], 9), round(row["median_similarity"], 9)) == (3, round(1 / 3, 9), 0.0)
    assert words.select(vectors.cosine("embedding", "embedding").alias("c")).orderBy("c").first()["c"] == 0.0


def test_median_is_the_same_for_one_and_several_tiles(spark):
    words = spark.createDataFrame([(1, f"m{i}", [math.cos(i), math.sin(i * i)]) for i in range(20)], "id long, message string, embedding array<double>")
    medians = {dictionary.group_similarity(words, tile=tile).first()["median_similarity"] for tile in (512, 6)}
    assert max(medians) - min(medians) < 1e-12


def test_infinite_scores_are_kept(spark):
    items = spark.createDataFrame([(1, [math.inf]), (2, [1.0]), (3, [-math.inf]), (4, [0.5])], "item long, vector array<double>")
    sessions = spark.createDataFrame([(2, [1.0])], "session long, vector array<double>")
    got = [(r["item"], r["score"]) for r in retrieval.score_by_vectors(sessions, items, 4).orderBy("rank").collect()]
    assert got == [(1, math.inf), (2, 1.0), (4, 0.5), (3, -math.inf)]
    own = retrieval.score_by_vectors(sessions, items, 2, skip_self=True).orderBy("rank").collect()
    assert [r["item"] for r in own] == [1, 4]


def test_lists_with_repeated_keys(spark):
    rows = spark.createDataFrame([(1, [5, 9]), (1, [9]), (2, []), (3, None)], "session long, items array<long>")
    names = spark.createDataFrame([(5, "five")], "id long, name string")
    found = sorted(((r["session"], r["names"]) for r in lookups.decode_lists(rows, names, "items").collect()), key=repr)
    assert found == [(1, ["five", "not found(9)"]), (1, ["not found(9)"]), (2, []), (3, [])]
    codes = spark.createDataFrame([(5, [1.0, 2.0])], "code long, vector array<double>")
    found = sorted(((r["session"], r["vectors"]) for r in lookups.lookup_embeddings(rows, codes, "items", 2).collect()), key=repr)
    assert found == [(1, [[0.0, 0.0]]), (1, [[1.0, 2.0], [0.0, 0.0]]), (2, []), (3, [])]


def test_csv_files_with_another_column_order_fail(spark, tmp_path):
    import pytest

    from sessionloom.sources.readers import read_csv_logs
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,x\n3,4\n")
    with pytest.raises(Exception, match="header"):
        read_csv_logs(spark, str(tmp_path)).collect()


def test_width_of_nested_values_is_measured(spark):
    from sessionloom.operators import scale
    wide = "x" * 500_000
    rows = spark.createDataFrame([([wide], {"k": wide}, (wide, 1), None)], "a array<string>, m map<string,string>, s struct<t:string,n:int>, e array<array<string>>")
    for column in "ams":
        assert rows.select(scale._row_bytes(rows.select(column)).alias("n")).first()["n"] >= 500_000
    assert rows.select(scale._row_bytes(rows.select("e")).alias("n")).first()["n"] < 100


def test_csv_files_are_put_together_by_name(spark, tmp_path):
    from pyspark.sql import types as T

    from sessionloom.sources.readers import read_csv_logs
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,x\n3,4\n5,6\n")
    (tmp_path / "c.csv").write_text("x\n7\n")
    rows = read_csv_logs(spark, str(tmp_path), by_name=True)
    assert sorted(map(tuple, rows.select("x", "y").collect()), key=str) == [("1", "2"), ("4", "3"), ("6", "5"), ("7", None)]
    kind = T.StructType([T.StructField("y", T.LongType()), T.StructField("z", T.StringType())])
    typed = read_csv_logs(spark, str(tmp_path), kind, by_name=True)
    assert sorted(map(tuple, typed.collect()), key=str) == [(2, None), (3, None), (5, None), (None, None)]


def test_commands_are_described_with_the_classes_so_far(spark):
    rows = spark.createDataFrame([(f"c{i}", f"k{i % 3}") for i in range(30)] + [("bad", "k0")], "message_content string, context string")

    def describe(command, context, classes):
        if command == "bad":
            raise KeyError("no class")
        return command, context, ",".join(classes)

    got = retrieval.augment_commands(rows, describe, rounds=3).collect()
    assert len(got) == 31 and {r["error"] for r in got} == {None, "KeyError: 'no class'"}
    later = [set(r["target"].split(",")) for r in got if r["target"]]
    assert later and all(x <= {"k0", "k1", "k2"} for x in later) and {"k0", "k1", "k2"} in later
    assert any(r["target"] == "" for r in got)
