"""Session operators against plain Python, on normal and on hot sessions."""

import random

import brute
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sessionloom import constants as C
from sessionloom.operators import redundancy, sessions, workflows
from sessionloom.operators.ordered import global_number
from sessionloom.operators.retrieval import pack_batches

# None: one window per session; 7: every session above seven rows is cut into blocks.
LIMITS = [None, 7]


def make_log(seed, n_sessions=25, longest=60, commands=3):
    rng = random.Random(seed)
    kinds = ["End Event: ", "End Event: ", "Undo Event: ", "Undo and Remove Action: ", "Redo Event: ", "Tool: "]
    rows, seq = [], 0
    for s in range(n_sessions):
        ts = 0
        for _ in range(rng.randint(1, longest)):
            ts += rng.randint(0, 2)
            seq += 1
            message = rng.choice(kinds) + f"C{rng.randrange(commands)} ({rng.randrange(2)})"
            rows.append((f"s{s}", ts, seq, message if rng.random() > 0.03 else "Undo Event: "))
    return rows


def by_session(rows):
    out = {}
    for row in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(row[0], []).append(row)
    return out


@pytest.mark.parametrize("limit", LIMITS)
def test_undo_redo(spark, limit):
    rows = make_log(1, n_sessions=40)
    df = spark.createDataFrame(rows, "session string, ts bigint, seq bigint, message string")
    got = {(r["session"], r["seq"]) for r in sessions.undo_redo(df, limit=limit).collect()}
    want = {(s, q) for s, part in by_session(rows).items() for q in brute.undo_redo([(r[2], r[3]) for r in part])}
    assert got == want


def test_restored_event_cannot_be_undone_again(spark):
    messages = ["End Event: A", "Undo Event: A", "Redo Event: A", "Undo Event: A", "End Event: A", "Undo and Remove Action: A",
                "Redo Event: A", "Tool: X"]
    df = spark.createDataFrame([("s", i, i, m) for i, m in enumerate(messages)],
                               "session string, ts bigint, seq bigint, message string")
    assert sorted(r["seq"] for r in sessions.undo_redo(df).collect()) == [0, 7]


def items_frame(spark, seed, values="ABC", n_sessions=20, longest=80, nulls=0.1):
    rng = random.Random(seed)
    rows, seq = [], 0
    for s in range(n_sessions):
        for i in range(rng.randint(1, longest)):
            seq += 1
            rows.append((f"s{s}", i // 2, seq, None if rng.random() < nulls else rng.choice(values)))
    return rows, spark.createDataFrame(rows, "session string, ts bigint, seq bigint, item string")


@pytest.mark.parametrize("limit", LIMITS)
def test_collapse_and_repeats(spark, limit):
    rows, df = items_frame(spark, 3)
    got = sorted((r["session"], r["seq"], r["item"], r["merge_count"]) for r in sessions.collapse_runs(df, limit=limit).collect())
    want = sorted((s, *c) for s, part in by_session(rows).items() for c in brute.collapse([(r[2], r[3]) for r in part]))
    assert got == want
    kept = {(r["session"], r["seq"]) for r in sessions.drop_repeats(df, limit=limit).collect()}
    first = {(s, part[i][2]) for s, part in by_session(rows).items() for i in range(len(part))
             if i == 0 or part[i][3] is None or part[i][3] != part[i - 1][3]}
    assert kept == first


@pytest.mark.parametrize("limit", LIMITS)
def test_splits_and_intervals(spark, limit):
    rows, df = items_frame(spark, 4)
    parts = {r["seq"]: r["session_part"] for r in sessions.split_fixed(df, min_items=3, max_items=10, limit=limit).collect()}
    for s, part in by_session(rows).items():
        group, k, left = [], 1, part
        while len(left) >= 3:
            size = min(len(left), 10)
            group.append([f"{s}-{k}", left[:size]])
            left, k = left[size:], k + 1
        if left and group:
            group[-1][1] = group[-1][1] + left
        elif left:
            group.append([s, left])
        for name, chunk in group:
            assert all(parts[r[2]] == name for r in chunk)
    gaps = {r["seq"]: r["timestamp_interval"] for r in sessions.time_intervals(df, limit=limit).collect()}
    for part in by_session(rows).values():
        for i, r in enumerate(part):
            assert gaps[r[2]] == (r[1] - part[i - 1][1] if i else 0)


@pytest.mark.parametrize("limit", LIMITS)
def test_random_split_sizes(spark, limit):
    rows, df = items_frame(spark, 5, longest=200)
    out = sessions.split_random(df, min_items=5, max_items=12, limit=limit)
    assert out.count() == len(rows)
    sizes = {}
    for r in out.collect():
        sizes.setdefault((r["session"], r["session_part"]), []).append((r["ts"], r["seq"]))
    totals = {s: len(p) for s, p in by_session(rows).items()}
    for (s, name), chunk in sizes.items():
        if totals[s] < 5:
            assert name == s
        else:
            assert 5 <= len(chunk) < 12 + 5
    again = sessions.split_random(df.repartition(17), min_items=5, max_items=12, limit=limit)
    assert sorted(map(tuple, again.select("seq", "session_part").collect())) == sorted(
        map(tuple, out.select("seq", "session_part").collect()))


PATTERNS = [["A", "B"], ["A", "C", "A"], ["C", "C", "C"], ["B", "A,B"], ["A", "A", "B", "A", "A"]]


@pytest.mark.parametrize("limit", LIMITS)
def test_merge_workflows(spark, limit):
    rows, df = items_frame(spark, 6, nulls=0)
    for merge, plain in ((workflows.merge_workflows, brute.merge_all),
                         (lambda d, i, p, limit: workflows.merge_first_match(d.withColumn("cat", F.lit("x")), i, p, limit=limit),
                          brute.merge_first)):
        got = {}
        for r in sorted(merge(df, "item", PATTERNS, limit=limit).collect(), key=lambda r: (r["session"], r["ts"], r["seq"])):
            got.setdefault(r["session"], []).append(r["item"])
        assert got == {s: plain([r[3] for r in part], PATTERNS) for s, part in by_session(rows).items()}


def test_greedy_cover_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(workflows, "TILE", 4)
    rows = [("s", i, i, "ABA"[i % 2] if i % 23 else "C") for i in range(300)]
    df = spark.createDataFrame(rows, "session string, ts bigint, seq bigint, item string")
    got = [r["item"] for r in sorted(workflows.merge_first_match(
        df.withColumn("cat", F.lit("x")), "item", [["A", "B", "A"], ["B", "A"]]).collect(), key=lambda r: r["seq"])]
    assert got == brute.merge_first([r[3] for r in rows], [["A", "B", "A"], ["B", "A"]])


def test_a_command_does_not_look_at_all_events_of_its_session(monkeypatch):
    n, looked = 2000, []
    find = np.flatnonzero
    monkeypatch.setattr(redundancy.np, "flatnonzero", lambda x: looked.append(len(x)) or find(x))
    rows = pd.DataFrame({"cat": [C.LOW_LEVEL, "Tool"] * (n // 2), "label": range(n), "ts": [f"{i:05d}" for i in range(n)], "text": ["e", "t"] * (n // 2),
                         "gone": False, "home": True, "allowed": [["e"]] * n})
    dropped = redundancy._dropped_in(rows, None, None, 5, 1)
    # The last command takes the first event; every other one takes the event behind it, which is open still.
    assert sorted(dropped) == [0, *range(2, n, 2)]
    assert sum(looked) < 5 * n


@pytest.mark.parametrize("tile,window", [(20_000, (10, 30)), (45, (10, 30)), (12, (3, 8)), (20_000, (None, None)), (25, (None, None))])
def test_replace_low_level(spark, tile, window):
    rng = random.Random(9)
    rows = []
    for s in range(6):
        ts, label = 0, 0
        for _ in range(rng.randint(5, 150)):
            ts += rng.randint(0, 2)
            label += rng.choice([1, 1, 1, 4])
            cat = rng.choice(["UNDO", "UNDO", "Tool", "Menu"])
            text = f"E{rng.randrange(3)}" if cat == "UNDO" else f"{cat}{rng.randrange(3)}"
            rows.append((f"s{s}", label, ts, cat, text))
    pairs = {"Tool0": {"E0", "E1"}, "Tool1": {"E1"}, "Menu0": {"E0"}, "Menu1": {"E2"}}
    df = spark.createDataFrame(rows, "session string, label bigint, ts bigint, cat string, message_eng string")
    table = spark.createDataFrame([(c, e) for c, es in pairs.items() for e in es], "command string, event string")
    got = sorted((r["session"], r["label"]) for r in redundancy.replace_low_level(df, table, *window, tile=tile).collect())
    want = sorted((s, label) for s in {r[0] for r in rows} for label in brute.replace_low_level(
        [r[1:] for r in rows if r[0] == s], pairs, *window))
    assert got == want


def test_a_long_session_without_window(spark):
    """100,000 rows in one session: tile by tile as in one piece, and no rank over the whole session."""
    rows = spark.range(100_000).select(
        F.lit("s").alias("session"), F.col("id").alias("label"), F.floor(F.col("id") / 3).alias("ts"),
        F.when(F.xxhash64("id") % 3 == 0, "Tool").otherwise("UNDO").alias("cat"),
        F.concat(F.when(F.xxhash64("id") % 3 == 0, "T").otherwise("E"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4))).alias("message_eng"))
    pairs = spark.createDataFrame([("T0", "E1"), ("T1", "E2"), ("T1", "E3")], "command string, event string")
    by_tile, whole = (redundancy.dropped_labels(rows, pairs, None, None, tile=tile) for tile in (20_000, 200_000))
    assert by_tile.count() == whole.count() > 10_000 and by_tile.exceptAll(whole).isEmpty()


def test_tiles_of_following_events(spark):
    rng = random.Random(5)
    rows = [("s", i, i // 2, rng.choice(["UNDO", "Tool"]), f"m{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "session string, label bigint, ts bigint, cat string, message_eng string")
    one = {r["label"]: r["events"] for r in redundancy.following_low_level(df).collect()}
    many = {r["label"]: r["events"] for r in redundancy.following_low_level(df, tile=13).collect()}
    assert one == many
    for label, _, ts, cat, _ in [r for r in [(x[1], x[0], x[2], x[3], x[4]) for x in rows] if r[3] == "Tool"]:
        view = [r for r in rows if abs(r[1] - label) <= 10 and r[3] == "UNDO"]
        assert one[label] == ([r[4] for r in view if r[2] >= ts][:3] + [r[4] for r in view if r[2] < ts][:1])


def test_global_number(spark):
    rng = random.Random(1)
    values = rng.sample(range(10_000), 500)
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    spark.conf.set("sessionloom.hotGroupRows", "40")
    try:
        got = {r["v"]: r["number"] for r in global_number(df, ["v"]).collect()}
    finally:
        spark.conf.unset("sessionloom.hotGroupRows")
    assert got == {v: i + 1 for i, v in enumerate(sorted(values))}


def test_learned_merges_recount_only_sessions_with_the_pair(spark):
    rng = random.Random(11)
    sessions = {f"s{i}": [rng.choice("aabbc") for _ in range(rng.randint(0, 8))] for i in range(40)}
    sessions |= {f"x{i}": ["p", "q"] for i in range(3)} | {"y": ["a", "a", "a", "b"]}
    df = spark.createDataFrame([(s, 1, i, x) for s, items in sessions.items() for i, x in enumerate(items)], "session string, ts int, seq int, item string")
    want, sizes = [], []
    for _ in range(7):
        counts = {}
        for items in sessions.values():
            for pair in zip(items, items[1:]):
                counts[pair] = counts.get(pair, 0) + 1
        best = min(counts, key=lambda p: (-counts[p], p))
        if counts[best] < 2:
            break
        want.append((",".join(best).split(","), counts[best]))
        sizes.append(sum(len(items) for items in sessions.values() if best in zip(items, items[1:])))
        for s, items in sessions.items():
            out, i = [], 0
            while i < len(items):
                step = 2 if tuple(items[i:i + 2]) == best else 1
                out.append(",".join(items[i:i + step]))
                i += step
            sessions[s] = out
    read: list[int] = []
    assert workflows.learn_merges(df, 7, sizes=read) == want
    assert read == sizes[:len(read)] and len(read) == 6 and min(read) < df.count() / 3


@pytest.mark.parametrize("hot", [False, True])
def test_pack_batches(spark, hot):
    rng = random.Random(2)
    tokens = [rng.randint(1, 60) for _ in range(400)] + [500, 3, 500]
    df = spark.createDataFrame(list(enumerate(tokens)), "doc_id bigint, tokens bigint")
    if hot:
        spark.conf.set("sessionloom.hotGroupRows", "50")
    try:
        got = {r["doc_id"]: r["batch"] for r in pack_batches(df, 100).collect()}
    finally:
        spark.conf.unset("sessionloom.hotGroupRows")
    assert [got[i] for i in range(len(tokens))] == brute.greedy_batches(tokens, 100)


def test_pack_batches_over_many_ranges(spark):
    rng = random.Random(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for most, sizes in ((40, (1, 60)), (40, (0, 3)), (10_000, (0, 9)), (7, (0, 1))):
            tokens = [rng.randint(*sizes) if rng.random() < 0.9 else None for _ in range(300)]
            df = spark.createDataFrame(list(enumerate(tokens)), "doc_id bigint, tokens bigint").withColumn("text", F.lit("x"))
            got = {r["doc_id"]: r["batch"] for r in pack_batches(df, most).collect()}
            assert [got[i] for i in range(300)] == brute.greedy_batches([t or 0 for t in tokens], most)
            assert pack_batches(df.drop("text"), most).columns == ["doc_id", "tokens", "batch"]
        assert pack_batches(df.limit(0), 5).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_slices_by_number(spark, monkeypatch):
    from sessionloom.operators import filters
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("v")).repartition(5)
    plain = [r["v"] for r in filters.slice_rows(df, 90, 130, ["v"]).collect()]
    monkeypatch.setattr(filters, "TOP_ROWS", 10)
    assert [r["v"] for r in filters.slice_rows(df, 90, 130, ["v"]).collect()] == plain == list(range(90, 130))
    assert filters.slice_rows(df, 600, 700, ["v"]).count() == 0


def test_codes_of_several_columns_in_one_pass(spark):
    from sessionloom.operators import features
    rng = random.Random(4)
    rows = [(rng.choice("abcd"), rng.choice([1, 2, None]), rng.choice([None, 0.5, 1.5])) for _ in range(200)]
    df = spark.createDataFrame(rows, "x string, y int, z double")
    tables = features.categorify_tables(df, ["x", "y", "z"])
    for column, table in tables.items():
        assert sorted(map(tuple, table.collect())) == sorted(map(tuple, features.categorify_table(df, column).collect()))


def test_lists_in_pieces(spark):
    rows, df = items_frame(spark, 8)
    out = sessions.groupby_lists(df, lists=["item"], counts=["item"], piece_rows=10)
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r["session"], r["piece"])):
        assert len(r["item-list"]) <= 10
        got.setdefault(r["session"], []).extend(r["item-list"])
    assert got == {s: [r[3] for r in part] for s, part in by_session(rows).items()}


def test_result_does_not_depend_on_partitions(spark):
    rows = make_log(11)
    df = spark.createDataFrame(rows, "session string, ts bigint, seq bigint, message string")
    results = []
    for partitions, shuffled in (("1", df), ("17", df.repartition(5)), ("8", df.orderBy(F.rand(3)))):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        results.append(sorted(r["seq"] for r in sessions.undo_redo(shuffled, limit=20).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1] == results[2]


def test_lists_in_pieces_pass_through_the_lookups(spark):
    """A session over the limit gives pieces; each keeps its own names, although the session repeats."""
    from sessionloom.operators import lookups
    df = spark.createDataFrame([("s", i, i, i) for i in range(10)], "session string, ts int, seq int, item long")
    names = spark.createDataFrame([(i, f"n{i}") for i in range(0, 10, 2)], "id long, name string")
    lists = sessions.groupby_lists(df, lists=["item"], piece_rows=4)
    found = lookups.decode_lists(lists, names, "item-list").orderBy("piece").collect()
    want = [f"n{i}" if i % 2 == 0 else f"not found({i})" for i in range(10)]
    assert [r["names"] for r in found] == [want[:4], want[4:8], want[8:]]
