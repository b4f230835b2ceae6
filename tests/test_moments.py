"""Vector-valued aggregates against plain numpy."""

import math
import random

import numpy as np
import pytest

from sessionloom.operators import dictionary, features
from sessionloom.operators.moments import vector_aggregate, vector_scatter
from sessionloom.operators.pairs import distances


@pytest.mark.parametrize("how", ["sum", "mean", "max", "min"])
def test_vectors_of_several_keys(spark, how):
    random.seed(how)
    rows = []
    for i in range(500):
        key = (random.choice(["a", "b", None, "hot", "hot", "hot"]), random.choice([1, 2, None]))
        vector = [random.choice([None, random.uniform(-5, 5)]) for _ in range(random.randint(0, 4))]
        rows.append((*key, random.choice([None, vector, vector])))
    rows += [("empty", 1, []), ("null", 1, None), ("nulls", 1, [None, None])]
    df = spark.createDataFrame(rows, "x string, y int, v array<float>").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        got = {(r["x"], r["y"]): r["vector"] for r in vector_aggregate(df, ["x", "y"], "v", how).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want: dict = {}
    for x, y, v in rows:
        for d, value in enumerate(v or ()):
            if value is not None:
                want.setdefault((x, y), {}).setdefault(d, []).append(float(np.float32(value)))
    fold = {"sum": sum, "mean": lambda v: sum(v) / len(v), "max": max, "min": min}[how]
    assert set(got) == set(want)
    for key, dims in want.items():
        assert [None if v is None else round(v, 9) for v in got[key]] == [
            round(fold(dims[d]), 9) if d in dims else None for d in range(len(got[key]))]
    assert vector_aggregate(df.limit(0), ["x"], "v", how).count() == 0


def test_no_row_per_dimension(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 5.0])], "k int, v array<double>")
    out = features.combine_vectors(df, "k", "v", "mean")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and out.first()["vector"] == [2.0, 3.5]


def test_scatter(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), [float(x) for x in rng.normal(100, 1, 3)]) for g in rng.integers(0, 3, 300)]
    df = spark.createDataFrame(rows, "g int, v array<double>").repartition(6)
    for r in vector_scatter(df, "g", "v").collect():
        mine = np.array([v for g, v in rows if g == r["g"]])
        centred = mine - mine.mean(axis=0)
        assert r["n"] == len(mine) and np.allclose(r["mean"], mine.mean(axis=0))
        assert np.allclose(np.frombuffer(r["scatter"]).reshape(3, 3), centred.T @ centred)


def test_similarity_of_a_group_over_several_tiles(spark):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(40, 5))
    vectors[7] = 0
    df = spark.createDataFrame([(1, f"m{i:02d}", v.tolist()) for i, v in enumerate(vectors)]
                               + [(2, f"m{i:02d}", [0.3, 0.4, 1.7]) for i in range(40)], "id long, message string, embedding array<double>")
    found = {(tile, r["id"]): r for tile in (512, 7) for r in dictionary.group_similarity(df, tile=tile).collect()}
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    values = (unit @ unit.T)[np.triu_indices(40, 1)]
    for tile in (512, 7):
        row = found[tile, 1]
        assert math.isclose(row["mean_similarity"], values.mean(), abs_tol=1e-12)
        assert math.isclose(row["std_dev_similarity"], values.std(), abs_tol=1e-12)
        assert math.isclose(row["median_similarity"], np.median(values), abs_tol=1e-9)
        same = found[tile, 2]
        assert same["length"] == 40 and same["std_dev_similarity"] < 1e-12 and math.isclose(same["mean_similarity"], 1, abs_tol=1e-12)


def test_distances_of_near_rows():
    """Rows that are equal or nearly so keep the digits that a matrix product would lose."""
    rng = np.random.default_rng(5)
    a = rng.normal(size=(30, 8)) * 100
    b = np.concatenate([a[:10], a[10:20] + 1e-7, rng.normal(size=(10, 8)), np.zeros((1, 8))])
    want = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    assert np.allclose(distances(a, b), want, rtol=1e-11, atol=0)
    assert not distances(b, b).diagonal().any()


def test_tiles_of_similarities_are_large():
    """A point of a group of 60,000 is sent at most 30 times a pass."""
    assert 60_000 / dictionary.SIMILARITY_TILE < 30
