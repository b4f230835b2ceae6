"""Strips of packed points: components, silhouettes and middle ranks of groups over several tiles."""

import math
import time

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.operators import dictionary, strips
from sessionloom.operators.pairs import number_points


def frame(spark, groups, kind="id string, message string, embedding array<double>"):
    return spark.createDataFrame([(g, f"m{i:04d}", [float(x) for x in v]) for g, data in groups.items() for i, v in enumerate(data)], kind)


def plain_tune(data, grid):
    """Bound, number of clusters, score and labels, from all pairs."""
    tried = []
    for e in sorted(grid):
        labels = brute.components(data, e)
        score, kinds = brute.silhouette(data, labels), len(set(labels))
        tried.append((1.0 if kinds in (1, len(data)) else -round(score, 12), e, kinds, score, labels))
    return min(tried, key=lambda t: t[:2])[1:]


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(4, 3))
    mixed = np.concatenate([c + 0.15 * rng.normal(size=(n, 3)) for c, n in zip(centers, (30, 9, 20, 1))])
    chain = np.stack([np.arange(40) * 0.2, np.zeros(40), np.zeros(40)], axis=1)
    return {"mixed": rng.permutation(mixed), "chain": rng.permutation(chain), "alone": mixed[:1], "pair": mixed[:2], "copies": np.repeat(mixed[:3], 7, axis=0),
            None: rng.permutation(mixed[:25])}


@pytest.mark.parametrize("tile", [5, 8, 4096])
def test_tuned_bounds_of_strips(spark, groups, tile):
    grid = [0.7, 0.1, 0.25, 0.4, 1.5, 0.25]
    best, clusters = dictionary.tune_eps(frame(spark, groups), grid, tile=tile)
    rows = {r["id"]: r for r in best.collect()}
    found = {}
    for r in clusters.collect():
        assert found.setdefault((r["id"], r["message"]), r["cluster"]) == r["cluster"]
    assert len(rows) == len(groups) and len(found) == sum(map(len, groups.values()))
    for g, data in groups.items():
        eps, kinds, score, labels = plain_tune(data, grid)
        assert (rows[g]["eps"], rows[g]["clusters"]) == (eps, kinds) and math.isclose(rows[g]["score"], score, abs_tol=1e-9)
        assert [found[g, f"m{i:04d}"] for i in range(len(data))] == [f"m{x:04d}" for x in labels]


def test_rows_that_come_twice_do_not_multiply(spark, groups):
    """Rows of one key are points of one cluster; the result has the key once."""
    words = frame(spark, {"mixed": groups["mixed"][:30]})
    best, clusters = dictionary.tune_eps(words.unionByName(words).unionByName(words.limit(4)), [0.2, 0.4], tile=8)
    assert clusters.count() == 30 and best.count() == 1
    apart = spark.createDataFrame([("a", "k", [0.0]), ("a", "k", [9.0]), ("a", "l", [9.1]), ("a", "m", [30.0])], words.schema)
    _, clusters = dictionary.tune_eps(apart, [0.2], tile=2)
    assert sorted((r["message"], r["cluster"]) for r in clusters.collect()) == [("k", "k"), ("l", "k"), ("m", "m")]


def test_every_pair_of_tiles_meets_once():
    """In halves each pair of tiles is one step of one strip, for odd and even numbers of tiles."""
    for tiles in range(1, 9):
        met = [tuple(sorted((strip, (strip + step) % tiles))) for strip in range(tiles) for step in range(tiles // 2 + 1)
               if 2 * step != tiles or strip < step]
        assert sorted(met) == [(i, j) for i in range(tiles) for j in range(i, tiles)]


def test_points_are_sent_once_per_strip(spark):
    """Bytes of a tile per strip that it meets: rows that are exchanged do not grow with the bounds or with single points."""
    n, tile = 60, 10
    words = frame(spark, {"a": np.random.default_rng(1).normal(size=(n, 4))})
    tiles = strips.pack(number_points(words, "id", ["message"]), "id", "embedding", tile)
    about = spark.createDataFrame([("a", n)], "_g string, _total bigint")
    assert tiles.count() == 6
    assert strips._strips(tiles, about, tile, half=True).count() == 6 * 7 // 2
    assert strips._strips(tiles, about, tile, half=False).count() == 6 * 7


@pytest.mark.parametrize(("step", "held"), [(14, 1 << 22), (3, 5), (14, 50), (11, 1)])
def test_middle_ranks(spark, step, held):
    rng = np.random.default_rng(6)
    groups = {"any": rng.normal(size=(23, 4)), "odd": rng.normal(size=(11, 4)),
              "equal": np.ones((9, 4)), "sides": np.concatenate([np.ones((3, 4)), -np.ones((1, 4))]), "two": rng.normal(size=(2, 4))}
    groups = {g: v / np.linalg.norm(v, axis=1, keepdims=True) for g, v in groups.items()}
    points = number_points(frame(spark, groups), "id", ["message"])
    sizes = dictionary.group_sizes(points)
    found = {r["id"]: (r["_low"], r["_high"]) for r in strips.middle_ranks(
        points, sizes, "id", "embedding", dictionary._ranks, 44, size=4, step=step, held=held).collect()}
    for g, data in groups.items():
        ranks = np.sort(dictionary._ranks((data @ data.T)[np.triu_indices(len(data), 1)]))
        want = ranks[(len(ranks) - 1) // 2], ranks[len(ranks) // 2]
        assert np.abs(np.array(found[g]) - want).max() <= 16      # digits of products differ with the shape of the matrices


def test_largest_square_within_a_bound():
    for bound in (0.0, 0.1, 1.05, 1.2, 1.45, 1e-160, 1e150):
        square = strips._square_bound(bound)
        assert np.sqrt(square) <= bound < np.sqrt(np.nextafter(square, np.inf))
    assert strips._square_bound(-0.1) < 0 and strips._square_bound(math.inf) == math.inf


def test_tuning_a_larger_group_in_time(spark):
    """Ten bounds on 6,000 points: their distances are taken twice, not once per bound with a row per tile and point."""
    rng = np.random.default_rng(2)
    words = spark.range(6_000).select(F.lit("a").alias("id"), F.format_string("m%06d", "id").alias("message"),
                                      F.array(*[F.randn(seed=int(s)) for s in rng.integers(0, 1 << 30, 16)]).alias("embedding"))
    begin = time.time()
    best, _ = dictionary.tune_eps(words, [2.0 + 0.2 * i for i in range(10)])
    assert best.count() == 1 and time.time() - begin < 40


def test_lengths_are_taken_once_per_vector(spark, monkeypatch):
    """The length of a vector is outside the function of its elements, so that it is not taken again for each of them."""
    plans = []
    monkeypatch.setattr(dictionary, "materialize", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    words = frame(spark, {"a": np.eye(3), "zero": np.zeros((2, 3))})
    found = {r["id"]: r["mean_similarity"] for r in dictionary.group_similarity(words).collect()}
    assert found == {"a": 0.0, "zero": 0.0}
    inner = [line for line in plans[0].splitlines() if "try_divide" in line.lower() or "SQRT" in line]
    assert inner and all(line.index("SQRT") < line.lower().index("lambdafunction") for line in inner if "SQRT" in line)


def test_components_are_found_once(spark, groups, monkeypatch):
    """Numbering the points again does not run the pass over all pairs a second time to look for large groups."""
    counted = []
    plain = strips.nested_components

    def seen(*args, **kwargs):
        found = plain(*args, **kwargs)
        counted.append(found.semanticHash())
        return found

    from sessionloom.operators import ordered
    looked, hot = [], ordered.hot_groups
    monkeypatch.setattr(dictionary, "nested_components", seen)
    monkeypatch.setattr(ordered, "hot_groups", lambda df, *rest: looked.append("_roots" in df.columns) or hot(df, *rest))
    dictionary.tune_eps(frame(spark, {"a": groups["chain"]}), [0.1, 0.3], tile=8)
    assert counted and looked and not any(looked)
