"""Files that grow, and the segments of a live table."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from sessionloom.sources import tail
from sessionloom.streaming.live import LiveTable


class Counting(tail.GrowingLinesReader):
    """Notes every range of bytes that tasks read."""

    def __init__(self, *args):
        super().__init__(*args)
        self.ranges = []

    def _read(self, store, file, first, last):
        self.ranges.append((file, first, last))
        return super()._read(store, file, first, last)


def take(reader, start):
    """Lines of one batch, the next offset, and the ranges its tasks read."""
    end = reader.latestOffset()
    reader.ranges.clear()
    rows = []
    for part in reader.partitions(start, end):
        for batch in reader.read(part):
            rows += [(os.path.basename(r["file"]), r["position"], r["place"], r["value"]) for r in batch.to_pylist()]
    return rows, end, list(reader.ranges)


def test_every_byte_of_a_growing_file_is_read_once(tmp_path):
    log = tmp_path / "log.txt"
    reader, offset, read, lines = Counting(str(log)), {"files": {}}, [], []
    log.write_bytes(b"")
    for piece in (b"one\ntwo\nthr", b"ee\r\nfour\n", b"", b"\n\nf\xff\nhalf", b" line\n"):
        with open(log, "ab") as file:
            file.write(piece)
        rows, offset, ranges = take(reader, offset)
        lines += [(p, v) for _, p, _, v in rows]
        read += [(first, last) for _, first, last in ranges]
    assert lines == [(0, "one"), (4, "two"), (8, "three"), (15, "four"), (22, "f�"), (25, "half line")]
    assert sorted(read) == read and read[0][0] == 0 and read[-1][1] == log.stat().st_size
    assert all(a[1] == b[0] for a, b in zip(read, read[1:]))


@pytest.mark.parametrize("split", [1, 3, 10, 1000])
def test_ranges_of_any_size_give_every_line_once(tmp_path, split, monkeypatch):
    monkeypatch.setattr(tail, "CHUNK", 5)
    monkeypatch.setattr(tail, "LOOK_BACK", 4)
    random.seed(split)
    text = "".join(random.choice("ab\n") * random.randint(1, 6) for _ in range(80)) + "\nopen"
    (tmp_path / "x.txt").write_text(text)
    (tmp_path / "y.txt").write_text("only\n")
    (tmp_path / "_hidden").write_text("no\n")
    rows, end, _ = take(Counting(str(tmp_path), split), {"files": {}})
    want, at = [], 0
    for line in text.split("\n")[:-1]:
        want += [("x.txt", at, at, line)] if line else []
        at += len(line) + 1
    assert rows == [*want, ("y.txt", 0, at, "only")] and list(end["files"].values()) == [at, 5]


def test_replaced_and_vanished_files(tmp_path):
    (tmp_path / "a").write_text("1\n2\n")
    (tmp_path / "b").write_text("3\n")
    reader = Counting(str(tmp_path))
    _, offset, _ = take(reader, {"files": {}})
    (tmp_path / "a").write_text("9\n")
    (tmp_path / "b").unlink()
    rows, offset, _ = take(reader, offset)
    assert rows == [("a", 0, 0, "9")] and len(offset["files"]) == 1


def batch(spark, version):
    rows = [(f"t{version}", f"s{(version * 7 + i) % 13}", "c", f"m{version}-{i}", None) for i in range(3)]
    return spark.createDataFrame(rows, "ts string, session string, cat string, message string, seq long")


def found(table):
    return sorted((r["session"], r["message"]) for r in table.collect())


def test_batches_are_merged_and_old_readers_stay_right(spark, tmp_path):
    def transform(rows):
        return rows.filter(~F.col("message").endswith("-2") | (F.col("session") != "s1"))

    live = LiveTable(spark, str(tmp_path), transform, fanout=3, retain=4, rows_per_bucket=20)
    want, old = [], None
    for version in range(50):
        live.apply(batch(spark, version), version)
        want += [(r["session"], r["message"]) for r in batch(spark, version).collect()]
        if version == 47:
            old, then = live.current(), list(want)
    clean = sorted(x for x in want if not (x[1].endswith("-2") and x[0] == "s1"))
    assert found(live.current()) == clean
    assert found(old) == sorted(x for x in then if x in clean)              # opened before the last merges
    state = live.manifest.load()
    for kind in ("raw", "result", "touched"):
        assert len(os.listdir(tmp_path / kind)) <= 3 * 4 + 3 * 4            # segments of four levels, and those kept for readers
    assert len(state["segments"]) <= 2 * 4 + 1 and max(s["buckets"] for s in state["segments"]) > 1
    assert sum(s["rows"] for s in state["segments"]) == 150
    before = sorted(os.listdir(tmp_path / "manifest"))
    live.apply(batch(spark, 49), 49)                                        # a repeated batch
    assert sorted(os.listdir(tmp_path / "manifest")) == before and found(live.current()) == clean


def test_a_large_batch_is_bucketed_at_once(spark, tmp_path):
    live = LiveTable(spark, str(tmp_path), lambda rows: rows, rows_per_bucket=10)
    rows = spark.range(95).select(F.lit("t").alias("ts"), F.concat(F.lit("s"), F.col("id") % 9).alias("session"), F.lit("c").alias("cat"),
                                  F.col("id").cast("string").alias("message"), F.lit(None).cast("long").alias("seq"))
    live.apply(rows, 0)
    live.apply(rows.limit(3), 1)
    assert live.manifest.load()["segments"][0]["buckets"] == 10 and live.current().count() == 98


def test_a_batch_that_failed_half_way_is_taken_in_again(spark, tmp_path):
    def fail(rows):
        raise ValueError("no")

    with pytest.raises(ValueError):
        LiveTable(spark, str(tmp_path), fail).apply(batch(spark, 0), 0)
    live = LiveTable(spark, str(tmp_path), lambda rows: rows)
    live.apply(batch(spark, 0), 0)
    assert live.current().count() == 3


def test_three_appends_to_one_file(spark, tmp_path):
    log, live = tmp_path / "log.json", LiveTable(spark, str(tmp_path / "out"), lambda rows: rows)
    line = '{"ts": "t", "session": "%s", "cat": "c", "message": "%s"}\n'
    for version, text in enumerate((line % ("a", "1") + line % ("b", "2"), (line % ("a", "3"))[:-5], (line % ("a", "3"))[-5:] + line % ("a", "4"))):
        with open(log, "a") as file:
            file.write(text)
        assert live.sync(str(log)) == (None if version == 1 else min(version, 1))
    rows = live.current().filter("session = 'a'").orderBy("seq").collect()
    assert [r["message"] for r in rows] == ["1", "3", "4"]


@pytest.mark.parametrize("cuts", [1, 4])
def test_sessions_in_the_state_equal_the_whole_log(spark, tmp_path, cuts):
    random.seed(cuts)
    rows = [(f"t{i}", random.choice("abcde"), random.choice(["c", None]), f"m{i}") for i in range(60)]
    seen = []

    def transform(frame):
        """Per session: number of rows and the messages in order; a session with a null first row has no result."""
        seen.append(frame.count())
        lists = frame.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("seq", "message", "cat"))).alias("l"))
        return lists.filter("l[0].cat IS NOT NULL").select("session", F.array_join(F.transform("l", lambda x: x["message"]), ",").alias("message"))

    log, live = tmp_path / "log.json", LiveTable(spark, str(tmp_path / "out"), transform, fanout=2)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    edges = [0, *sorted(random.sample(range(1, 60), cuts - 1)), 60]
    try:
        for a, b in zip(edges, edges[1:]):
            with open(log, "a") as file:
                file.writelines(json.dumps(dict(zip(("ts", "session", "cat", "message"), r))) + "\n" for r in rows[a:b])
            assert live.sync(str(log), stateful=True) is not None
        assert live.sync(str(log), stateful=True) is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    want = []
    for s in "abcde":
        mine = [r for r in rows if r[1] == s]
        if mine and mine[0][2] is not None:
            want.append((s, ",".join(r[3] for r in mine)))
    assert found(live.current()) == want and max(seen) <= 60
    assert not (tmp_path / "out" / "raw").exists()


def test_a_batch_leaves_no_intermediate_tables(spark, tmp_path):
    from sessionloom.operators import scale
    from sessionloom.session import ensure_checkpoint_dir

    def transform(rows):
        return scale.materialize(scale.once(rows).filter("message IS NOT NULL"))

    def tables():
        return {n for n in os.listdir(ensure_checkpoint_dir(spark).removeprefix("file:")) if n.startswith("table-")}

    before, mine = tables(), scale.materialize(spark.range(3))
    live = LiveTable(spark, str(tmp_path), transform)
    for version in range(3):
        live.apply(batch(spark, version), version)
    assert live.current().count() == 9 and len(tables() - before) == 1 and mine.count() == 3
