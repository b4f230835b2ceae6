"""Chunks of sessions in a bounded number of folders, sessions in the state of a stream."""

import json
import os

from sessionloom.sources import writers
from sessionloom.streaming.live import LiveTable
from sessionloom.streaming.state import touched_sessions


def test_folders_do_not_follow_the_number_of_chunks(spark, tmp_path):
    rows = spark.createDataFrame([(s, i) for s in range(100) for i in range(s % 3 + 1)], "session long, item long")
    for folders, want in ((4, 4), (25, 25), (1000, 25)):
        path = str(tmp_path / str(folders))
        writers.write_session_chunks(rows, path, 4, folders=folders)
        names = [n for n in os.listdir(path) if n.startswith("first_chunk=")]
        found = spark.read.parquet(path)
        assert len(names) == want
        assert sorted((r["session"], r["item"], r["chunk"]) for r in found.collect()) == [(s, i, s // 4) for s in range(100) for i in range(s % 3 + 1)]
        assert found.select("chunk", "first_chunk").distinct().count() == 25  # a chunk lies in one folder
    writers.write_session_chunks(rows.limit(0), str(tmp_path / "none"), 4)


def test_state_keeps_the_order_of_batches_without_python(spark, tmp_path):
    """Rows without an order are numbered by the session's batches; the state is an aggregate, not a call per session."""
    log, live = tmp_path / "log.json", LiveTable(spark, str(tmp_path / "out"), lambda rows: rows)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for version, lines in enumerate(([("a", "1", None), ("b", "2", 7)], [("a", "3", None), ("a", "4", None), (None, "5", None)], [("b", "6", None)])):
            with open(log, "a") as file:
                file.writelines(json.dumps({"ts": "t", "session": s, "cat": "c", "message": m, "seq": q}) + "\n" for s, m, q in lines)
            assert live.sync(str(log), stateful=True) == version
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    rows = live.current().orderBy("session", "seq").collect()
    assert [(r["session"], r["message"], r["seq"] >> 44) for r in rows if r["session"]] == [
        ("a", "1", 0), ("a", "3", 1), ("a", "4", 1), ("b", "2", 0), ("b", "6", 1)]
    stream = spark.readStream.schema("ts string, session string, cat string, message string, seq long, place long").json(str(tmp_path / "out"))
    plan = touched_sessions(stream)._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "TransformWithState" not in plan and "Py" not in plan
