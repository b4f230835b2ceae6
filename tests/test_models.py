"""Vectors, clusters, targets, sampling and the live table."""

import math
import random
import time

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.functions.vectors import truncate_l2
from sessionloom.operators import dictionary, masking, ranking, retrieval, sampling, splits
from sessionloom.plans import views as V
from sessionloom.sources.readers import read_logs
from sessionloom.streaming.live import LiveTable, live_filter

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    rows, raw = [], {}
    for g in range(3):
        centers = rng.normal(size=(3, 4))
        data = np.concatenate([c + 0.12 * rng.normal(size=(7 + g, 4)) for c in centers])
        raw[f"g{g}"] = data
        rows += [(f"g{g}", f"m{i:03d}", [float(x) for x in v]) for i, v in enumerate(data)]
    return raw, spark.createDataFrame(rows, "id string, message string, embedding array<double>")


@pytest.mark.parametrize("tile", [512, 5])
def test_similarity(points, tile):
    raw, df = points
    for r in dictionary.group_similarity(df, tile=tile).collect():
        u = raw[r["id"]] / np.linalg.norm(raw[r["id"]], axis=1, keepdims=True)
        sims = (u @ u.T)[np.triu_indices(len(u), 1)]
        assert r["length"] == len(u)
        assert np.allclose([r["mean_similarity"], r["median_similarity"], r["std_dev_similarity"]],
                           [sims.mean(), np.median(sims), sims.std()], atol=1e-9)


@pytest.mark.parametrize("tile", [512, 5])
def test_clusters_and_silhouette(points, tile):
    raw, df = points
    clusters = dictionary.cluster_group(df, 0.35, tile=tile)
    got = {}
    for r in clusters.collect():
        got.setdefault(r["id"], {})[r["message"]] = r["cluster"]
    scores = {r["id"]: r["score"] for r in dictionary.silhouette(df, clusters, tile=tile).collect()}
    for g, data in raw.items():
        want = brute.components(data, 0.35)
        assert [got[g][f"m{i:03d}"] for i in range(len(data))] == [f"m{x:03d}" for x in want]
        assert math.isclose(scores[g], brute.silhouette(data, want), abs_tol=1e-9)


def test_tuned_bound(points):
    raw, df = points
    grid = [0.1, 0.3, 0.5]
    best, _ = dictionary.tune_eps(df, grid, tile=8)
    for r in best.collect():
        data = raw[r["id"]]
        worth = {}
        for e in grid:
            labels = brute.components(data, e)
            penalty = len(set(labels)) in (1, len(data))
            worth[e] = -1.0 if penalty else round(brute.silhouette(data, labels), 12)
        assert r["eps"] == max(grid, key=lambda e: (worth[e], -e))


def test_long_chain_is_one_component(spark):
    n = 300
    rng = random.Random(1)
    names = [f"k{i:04d}" for i in rng.sample(range(n), n)]
    nodes = spark.createDataFrame([("g", k) for k in names], "id string, message string")
    edges = spark.createDataFrame([("g", a, b) for a, b in zip(names, names[1:])], "id string, a string, b string")
    roots = {r["root"] for r in dictionary.components(nodes, edges, "id", "message").collect()}
    assert roots == {"k0000"}


def test_scores_by_blocks_equal_scores_by_broadcast(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(60)]
    left = spark.createDataFrame(rows, "session bigint, vector array<double>")
    right = left.withColumnRenamed("session", "item")
    small = retrieval.score_by_vectors(left, right, 4, skip_self=True).collect()
    blocks = retrieval.score_by_vectors(left, right, 4, skip_self=True, item_block=7, session_block=9).collect()
    key = lambda r: (r["session"], r["rank"], r["item"], round(r["score"], 9))
    assert sorted(map(key, small)) == sorted(map(key, blocks))
    data = np.array([v for _, v in rows])
    scores = data @ data.T
    np.fill_diagonal(scores, -np.inf)
    for r in small:
        assert np.argsort(-scores[r["session"]])[r["rank"] - 1] == r["item"]


def test_blocks_of_short_items_are_skipped(spark):
    rng = np.random.default_rng(2)
    length = np.repeat([100.0, 1.0, 0.5, 0.1], 25)
    items = [(i, [float(x) for x in v / np.linalg.norm(v) * n]) for i, (v, n) in enumerate(zip(rng.normal(size=(100, 4)), length))]
    items += [(900, [0.0] * 4), (901, [100.0, 0.0, 0.0, 0.0]), (902, [100.0, 0.0, 0.0, 0.0])]
    sessions = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(30, 4)))] + [(50, [0.0] * 4), (51, [1e-9, 0.0, 0.0, 0.0])]
    right = spark.createDataFrame(items, "item bigint, vector array<double>")
    left = spark.createDataFrame(sessions, "session bigint, vector array<double>")
    got = {}
    for r in retrieval.score_by_vectors(left, right, 3, item_block=25, session_block=8).orderBy("session", "rank").collect():
        got.setdefault(r["session"], []).append(r["item"])
    for s, v in sessions:
        order = sorted(items, key=lambda i: (-float(np.dot(i[1], v)), i[0]))
        assert got[s] == [i for i, _ in order[:3]]
    blocks = retrieval._item_blocks(right.withColumnRenamed("vector", "item_vector"), 25)
    longest = [r[0] for r in blocks.groupBy("_ib").agg({"_length": "max"}).orderBy("_ib").select("max(_length)").collect()]
    best = retrieval.score_by_vectors(left, right, 3).drop("rank")
    asked = retrieval._reach(left, best, longest, 3, 1.0)
    # Of five blocks, only sessions without a positive third score meet more than the first two.
    assert {r["session"]: r["_reach"] for r in asked.collect() if r["_reach"] > 2} == {50: 5}
    assert retrieval._tiles(asked, 1000, 1).count() <= 4 + 1


def test_only_scores_that_count_are_sorted():
    """The best of a block by a known bound, of ties and odd scores, equal those of a whole sort."""
    rng = np.random.default_rng(4)
    for _ in range(40):
        scores = rng.integers(-3, 4, (20, 30)).astype(float)
        scores[rng.random((20, 30)) < 0.05] = rng.choice([np.nan, np.inf, -np.inf])
        ids, items = rng.permutation(50)[:20], rng.permutation(50)[:30]
        least, want = np.full(20, -np.inf), []
        for i, row in enumerate(scores):
            ranked = sorted((-x, t) for x, t in zip(row, items) if t != ids[i] and not np.isnan(x))[:4]
            want += [(ids[i], t, -x) for x, t in ranked]
            if len(ranked) == 4:
                least[i] = -ranked[-1][0]
        for bound in (None, least):
            found = retrieval._best(ids, items, scores.copy(), 4, True, bound)
            assert sorted(map(tuple, found.itertuples(index=False))) == sorted(want)


def test_predict_rejects_too_many(spark):
    with pytest.raises(ValueError):
        retrieval.predict(spark.createDataFrame([(1, [1])], "session int, items array<int>"), lambda b: None, k=9, top_k=5)


def sequences(spark, n=200):
    rng = random.Random(2)
    rows = [(i, [rng.randint(1, 50) for _ in range(rng.randint(2, 25))] + [0] * rng.randint(0, 3)) for i in range(n)]
    return spark.createDataFrame(rows, "session bigint, items array<bigint>")


@pytest.mark.parametrize("make", [masking.mlm_targets, masking.span_targets])
def test_targets_draw_once_per_row(spark, make):
    """No hash of the row's key, except that of a single item, is computed inside a function of the items."""
    df = spark.createDataFrame([(1, list(range(1, 4001)))], "session bigint, items array<bigint>")
    plan = make(df, "session", "items")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000
    started = time.time()
    labels = make(spark.createDataFrame([(1, list(range(1, 30_001)))], "session bigint, items array<bigint>"), "session", "items").first()["labels"]
    assert len(labels) == 30_000 and 0.05 < sum(x > 0 for x in labels) / 30_000 < 0.3
    assert time.time() - started < 60


@pytest.mark.parametrize("make", [masking.mlm_targets, masking.span_targets])
def test_mask_invariants(spark, make):
    df = sequences(spark)
    share = []
    for r in make(df, "session", "items").collect():
        real = [i for i, x in enumerate(r["items"]) if x]
        hit = [i for i, x in enumerate(r["labels"]) if x]
        assert 1 <= len(hit) < len(real) and set(hit) <= set(real)
        assert all(r["labels"][i] == r["items"][i] for i in hit)
        share.append(len(hit) / len(real))
    assert 0.08 < sum(share) / len(share) < 0.4


def test_corruption(spark):
    df = masking.corrupt_items(masking.mlm_targets(sequences(spark), "session", "items"), "session", "items", "labels", 51, 1)
    for r in df.collect():
        for x, y, label, flag in zip(r["items"], r["corrupted"], r["labels"], r["is_replaced"]):
            assert flag == (x != y) and (label or not flag) and (y == 0 or 1 <= y < 51)


def test_swap_noise_keeps_padding(spark):
    rows = [(i, i % 7) for i in range(2000)]
    out = masking.swap_noise(spark.createDataFrame(rows, "k bigint, v bigint"), "k", "v", p=0.3).collect()
    assert len(out) == 2000
    assert all(r["v"] == 0 for r in out if r["k"] % 7 == 0) and all(r["v"] for r in out if r["k"] % 7)
    assert 300 < sum(r["v"] != r["k"] % 7 for r in out) < 650


def test_log_uniform(spark):
    n = 20
    ids = spark.range(n).withColumnRenamed("id", "item_id")
    probs = {r["item_id"]: r["probability"] for r in sampling.log_uniform_probs(ids, n).collect()}
    assert math.isclose(sum(probs.values()), 1.0, abs_tol=1e-9)
    drawn = spark.range(20_000).select(sampling.log_uniform_id(
        __import__("sessionloom.functions.hashing", fromlist=["uniform"]).uniform(F.col("id"), "t"), n).alias("d"))
    seen = {r["d"]: r["count"] / 20_000 for r in drawn.groupBy("d").count().collect()}
    assert all(abs(seen[i] - probs[i]) < 0.015 for i in range(n))
    few = [r["item_id"] for r in sampling.negatives(spark, 100, 10).collect()]
    assert few == sorted(set(few)) and len(few) <= 10 and max(few) < 100


def test_generated_sessions(spark):
    flat = sampling.generate_interactions(spark.range(3000), "id")
    per = flat.groupBy("session_id").agg(F.countDistinct("day").alias("d"), F.countDistinct("price").alias("p"))
    assert per.filter("d > 1 or p > 1").count() == 0
    bounds = flat.agg(F.min("item_id"), F.max("category"), F.min("category"), F.max("purchase")).first()
    assert bounds[0] >= 1 and bounds[1] <= 99 and bounds[2] >= 1 and bounds[3] <= 1
    lists = sampling.generate_sessions(spark.range(3000), "id", maximum_length=3)
    assert lists.filter(F.size("item_id-list_trim") > 3).count() == 0


def test_balanced_split_covers_every_item(spark):
    rng = random.Random(4)
    rows = [(f"s{rng.randrange(60)}", rng.randrange(40)) for _ in range(400)] + [("only", 99)]
    df = spark.createDataFrame(rows, "session string, item int")
    split = splits.split_balanced(df, "session", "item")
    for name in ("train", "val"):
        covered = df.join(split.filter(F.col("split") == name), "session").select("item").distinct().count()
        assert covered == df.select("item").distinct().count()
    with pytest.raises(ValueError):
        splits.split_random(df, "session", 0.7, 0.6)


def test_metrics_need_columns(spark):
    with pytest.raises(ValueError):
        ranking.session_metrics(spark.createDataFrame([(1, 2)], "session int, item int"))


def test_zero_vector_stays(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    assert [r[0] for r in df.select(truncate_l2("v", 2)).collect()] == [[0.0, 0.0], [0.6, 0.8]]


def test_stream_equals_batch(spark, tmp_path):
    log = V.log0(spark, SMALL).withColumn("ts", F.date_format("ts", "MM/dd/yyyy HH:mm:ss '0.'SSSSSS '+0000'")).select(
        "ts", "session", "cat", "message", "seq")
    kept = V.modeling_log(spark, SMALL)
    words = spark.createDataFrame([("Tool: T0", 1), ("End Event: E0", 2)], "item string, item_id bigint")
    info = spark.createDataFrame([(i, "s", "c", "t") for i in ("Tool: T0", "Tool: T1", "End Event: E0", "End Event: E1")],
                                 "message_content string, summary string, classification string, target string")

    def transform(rows):
        return live_filter(rows, V.dict0(kept), V.pairs0(spark), words, info, V.PATTERNS)

    want = sorted(map(tuple, transform(log).collect()))
    # Rows arrive in time order in three files, one file per micro-batch.
    for i, (low, high) in enumerate([(0, 300), (300, 650), (650, 10**9)]):
        log.filter((F.col("seq") >= low) & (F.col("seq") < high)).coalesce(1).write.json(str(tmp_path / f"part{i}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        for f in (tmp_path / f"part{i}").glob("*.json"):
            f.rename(tmp_path / "in" / f"{i}.json")
    live = LiveTable(spark, str(tmp_path / "out"), transform, buckets=4)
    live.watch(str(tmp_path / "in"), str(tmp_path / "state"), files_per_trigger=1).awaitTermination()
    assert sorted(map(tuple, live.current().select(*transform(log).columns).collect())) == want


def test_read_logs_in_ingest_order(spark, tmp_path):
    for name, rows in (("b/x", [("s", "t", "Tool", "3")]), ("a/y", [("s", "t", "Tool", "1"), ("s", "t", "Tool", "2")])):
        spark.createDataFrame(rows, "session_anonymized string, ts string, cat string, message string").withColumn(
            "other", F.lit(1)).coalesce(1).write.parquet(str(tmp_path / name))
    log = read_logs(spark, str(tmp_path), seq="seq")
    assert log.columns == ["session_anonymized", "ts", "cat", "message", "seq"]
    assert [r["message"] for r in log.orderBy("seq").collect()] == ["1", "2", "3"]
