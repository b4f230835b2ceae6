"""Building the command dictionary: one label for all spellings of a command."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.constants import GROUP_SIMILARITY
from sessionloom.functions.vectors import l2_distance, l2_norm
from sessionloom.operators.moments import vector_aggregate, vector_scatter
from sessionloom.operators.pairs import TILE, distances, matrix, number_points, plain_strings, tile_pairs
from sessionloom.operators.scale import broadcast_if_small, materialize, same_keys, small_table
from sessionloom.operators.strips import STRIP, middle_ranks, nested_components, nested_silhouettes

# Similarities are ranked as integers of this many bits.
_BITS = 44
# Points of a group whose similarities are taken at once; larger ones go by strips of twice as many, in each pass.
SIMILARITY_TILE = 2048


def group_sizes(words: DataFrame, group: str = "id") -> DataFrame:
    return words.groupBy(group).agg(F.count(F.lit(1)).alias("size"))


def single_member_labels(words: DataFrame, group: str = "id") -> tuple[DataFrame, DataFrame]:
    """Groups of one member, labelled with its translated text; and all other rows."""
    single = small_table(group_sizes(words, group).filter(F.col("size") == 1).select(group))
    labelled = words.join(single, group, "left_semi").withColumn("label", F.col("translated_message"))
    return labelled, words.join(single, group, "left_anti")


def _ranks(similarities: np.ndarray) -> np.ndarray:
    cells = np.clip(similarities, -1.0, 1.0)
    cells += 1.0
    cells /= 2.0
    cells *= (1 << _BITS) - 1
    return cells.astype(np.int64)


def group_similarity(words: DataFrame, group: str = "id", key: str = "message",
                     vector: str = "embedding", tile: int = SIMILARITY_TILE) -> DataFrame:
    """Size, and mean, median and population deviation of the pairwise cosine similarities.

    Similarities are taken to 2**-44 for the median.  A group that fits one tile is done at
    once.  In larger groups mean and deviation follow from the mean vector and the centred scatter matrix
    of the unit vectors, one pass over the rows, and the median from counting pairs, in two passes unless
    very many are equal, so no list of pairs exists anywhere.
    """
    # A zero vector stays zero, so its similarities are 0.
    # The length is bound once per vector; named inside, it would be taken anew for each of its elements.
    unit = F.transform(F.array(l2_norm(vector)), lambda length: F.transform(
        F.col(vector).cast("array<double>"), lambda x: F.coalesce(F.try_divide(x, length), F.lit(0.0))))[0]
    points = materialize(number_points(words.select(group, key, unit.alias("unit")), group, [key]))
    sizes = materialize(group_sizes(points, group).filter(F.col("size") >= 2))
    kind = points.schema[group].dataType.simpleString()

    def whole(table: pd.DataFrame) -> pd.DataFrame:
        a = matrix(table["unit"])
        values = (a @ a.T)[np.triu_indices(len(a), 1)]
        ranks = _ranks(values)
        # The same cells as in the search over several tiles, so that one definition holds for all sizes.
        cells = np.sort(ranks)[[(len(ranks) - 1) // 2, len(ranks) // 2]]
        middle = float(np.mean((cells + 0.5) / ((1 << _BITS) - 1) * 2.0 - 1.0))
        return plain_strings(pd.DataFrame({group: [table[group].iloc[0]], "length": [len(table)], "mean_similarity": [float(values.mean())],
                                           "median_similarity": [middle], "std_dev_similarity": [float(values.std())]}))

    def of(part: DataFrame) -> DataFrame:
        return points.alias("p").join(broadcast_if_small(part).alias("s"), same_keys("p", "s", [group]), "left_semi")

    small = of(sizes.filter(F.col("size") <= tile)).groupBy(group).applyInPandas(
        whole, f"{group} {kind}, length bigint, mean_similarity double, median_similarity double, std_dev_similarity double")
    large = sizes.filter(F.col("size") > tile)
    if large.isEmpty():
        return small
    large_points = of(large)
    # A unit vector has length 1, a zero vector 0: sums of their squares and of the squares' deviations.
    zeros = F.forall("unit", lambda x: x == 0).cast("int")
    lengths = large_points.groupBy(group).agg(F.sum(zeros).cast("bigint").alias("zeros"))

    def pair_moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, n, mean, scatter, zero in batch.itertuples(index=False, name=None):
                mean = np.asarray(mean, np.float64)
                scatter = np.frombuffer(scatter).reshape(len(mean), len(mean))
                square, ones, pairs = float(mean @ mean), n - zero, n * (n - 1)
                shift = (n * square - ones) / pairs                       # of the mean similarity from the squared mean vector
                spread = 2 * n * float(mean @ scatter @ mean) + float((scatter * scatter).sum())   # about it, over all (i, j) ...
                spread -= ones * (1 - square) ** 2 + zero * square**2     # ... but i = j
                rows.append((name, n, square + shift, float(np.sqrt(max(0.0, spread / pairs - shift * shift)))))
            yield plain_strings(pd.DataFrame(rows, columns=[group, "length", "mean_similarity", "std_dev_similarity"]))

    moments = (vector_scatter(large_points, group, "unit").join(lengths, group)
               .mapInPandas(pair_moments, f"{group} {kind}, length bigint, mean_similarity double, std_dev_similarity double"))
    medians = _large_medians(large_points, large, group, tile).withColumnRenamed("_median", "median_similarity")
    return small.unionByName(moments.join(medians, group).select(small.columns))


def _large_medians(points: DataFrame, large: DataFrame, group: str, tile: int) -> DataFrame:
    """Median of the pair similarities of groups of several tiles, by counting."""
    found = middle_ranks(points, large, group, "unit", _ranks, _BITS, size=2 * tile)
    low, high = ((F.col(c) + 0.5) / float((1 << _BITS) - 1) * 2.0 - 1.0 for c in ("_low", "_high"))
    return found.select(group, ((low + high) / 2).alias("_median"))


def centroid_label(words: DataFrame, keys: Sequence[str] = ("id",), order: str = "message",
                   vector: str = "embedding") -> DataFrame:
    """Label of each group: its only English message if there is exactly one, else the
    translated text of the member nearest to the mean vector (first in ``order`` on ties)."""
    keys = list(keys)
    mean = vector_aggregate(words, keys, vector, "mean", "_mean")
    joined = words.alias("w").join(small_table(mean).alias("m"), same_keys("w", "m", keys)).select(
        "w.*", "m._mean")
    english = F.col("message_language") == "en"
    return joined.groupBy(*keys).agg(
        F.count(F.when(english, 1)).alias("_english"),
        F.min(F.when(english, F.col("message"))).alias("_raw"),
        F.min_by("translated_message", F.struct(F.round(l2_distance(vector, "_mean"), 12), order)).alias("_nearest")
    ).select(*keys, F.when(F.col("_english") == 1, F.col("_raw")).otherwise(F.col("_nearest")).alias("label"))


def _spanning_forest(points: np.ndarray, longest: float) -> list[tuple[int, int, float]]:
    """Edges of a minimum spanning tree that are not longer than ``longest`` (Prim)."""
    n = len(points)
    far = distances(points, points)
    best = np.full(n, np.inf)
    source = np.zeros(n, dtype=np.int64)
    free = np.ones(n, dtype=bool)
    edges: list[tuple[int, int, float]] = []
    current = 0
    for _ in range(n - 1):
        free[current] = False
        reach = far[current]
        closer = free & (reach < best)
        best[closer] = reach[closer]
        source[closer] = current
        current = int(np.argmin(np.where(free, best, np.inf)))
        if best[current] <= longest:
            edges.append((int(source[current]), current, float(best[current])))
    return edges


def near_edges(points: DataFrame, group: str, key: str, vector: str, longest: float,
               tile: int = TILE) -> DataFrame:
    """Edges (a, b, distance) that connect exactly what all pairs within ``longest`` connect.

    Each tile pair gives a minimum spanning forest, so the edges of every bound up to
    ``longest`` are enough for the components at that bound, and their number grows with
    the points, not with the pairs.
    """
    types = {c: points.schema[c].dataType.simpleString() for c in (group, key)}

    def forest(name, left, right):
        rows = left if right is None else pd.concat([left, right])
        keys = rows[key].to_numpy()
        edges = _spanning_forest(matrix(rows[vector]), longest) if len(rows) > 1 else []
        return pd.DataFrame({group: [name] * len(edges), "a": [keys[e[0]] for e in edges],
                             "b": [keys[e[1]] for e in edges], "distance": [e[2] for e in edges]})

    return tile_pairs(points, group, forest,
                      f"{group} {types[group]}, a {types[key]}, b {types[key]}, distance double",
                      [key, vector], tile)


def components(nodes: DataFrame, edges: DataFrame, group: str, key: str) -> DataFrame:
    """Smallest connected key of every node.

    Each round gives all nodes of a label the smallest label across their edges, then lets
    labels follow their own label twice, so long chains shrink fast.  Labels only fall and
    never leave the component; when no edge joins two labels they are the smallest keys.
    """
    label = materialize(nodes.select(group, key, F.col(key).alias("root")))
    edges = materialize(edges.select(group, "a", "b"))
    while True:
        ends = (edges.join(label.select(group, F.col(key).alias("a"), F.col("root").alias("ra")), [group, "a"])
                .join(label.select(group, F.col(key).alias("b"), F.col("root").alias("rb")), [group, "b"])
                .filter(F.col("ra") != F.col("rb")))
        hooks = materialize(ends.groupBy(group, F.greatest("ra", "rb").alias("root")).agg(
            F.min(F.least("ra", "rb")).alias("_to")))
        if hooks.isEmpty():
            return label
        moved = label.join(hooks, [group, "root"], "left").select(
            group, key, F.coalesce("_to", "root").alias("root"))
        up = moved.select(group, F.col(key).alias("root"), F.col("root").alias("_up"))
        for _ in range(2):
            moved = moved.join(up, [group, "root"]).select(group, key, F.col("_up").alias("root"))
        label = materialize(moved)


def cluster_group(words: DataFrame, eps: float, group: str = "id", key: str = "message",
                  vector: str = "embedding", tile: int = TILE) -> DataFrame:
    """Density clusters with one-point cores: the components of "distance at most eps".

    The cluster is named by its smallest key.
    """
    points = materialize(number_points(words.select(group, key, vector), group, [key]))
    edges = near_edges(points, group, key, vector, eps, tile)
    return components(points, edges, group, key).withColumnRenamed("root", "cluster")


def silhouette(points: DataFrame, clusters: DataFrame, group: str = "id", key: str = "message",
               vector: str = "embedding", tile: int = TILE) -> DataFrame:
    """Mean silhouette of each group; 1 as a penalty if there is one cluster or only
    singletons (callers that maximise must treat it as the worst value).

    Points are tiled in cluster order.  A cluster inside one tile is reduced to its mean
    distance on the spot, and only its minimum leaves; clusters across a border leave sums.
    """
    full = points.alias("p").join(clusters.alias("c"), same_keys("p", "c", [group, key])).select(
        F.col(f"p.{group}").alias(group), F.col(f"p.{key}").alias(key), F.col(f"p.{vector}").alias(vector),
        F.col("c.cluster"))
    sizes = materialize(full.groupBy(group, "cluster").agg(F.count(F.lit(1)).alias("_size")))
    sized = full.join(broadcast_if_small(sizes), [group, "cluster"])
    numbered = materialize(number_points(sized, group, ["cluster", key]))
    gtype, ktype = (numbered.schema[c].dataType.simpleString() for c in (group, key))

    def one_way(name, rows, others):
        a, b = matrix(rows[vector]), matrix(others[vector])
        codes, starts = np.unique(others["cluster"].to_numpy(), return_inverse=True)
        counts, order = np.bincount(starts), np.argsort(starts, kind="stable")
        edges = np.cumsum(counts) - counts
        size_of = dict(zip(others["cluster"], others["_size"]))
        whole = np.array([size_of[c] == n for c, n in zip(codes, counts)])
        frames = []
        block = 64
        for at in range(0, len(a), block):
            part = rows.iloc[at:at + block]
            far = distances(a[at:at + block], b)
            sums = np.add.reduceat(far[:, order], edges, axis=1)
            mine = part["cluster"].to_numpy()[:, None] == codes[None, :]
            closed = whole[None, :] & ~mine
            nearest = np.where(closed, sums / counts[None, :], np.inf).min(axis=1)
            keep = np.isfinite(nearest)
            frames.append(pd.DataFrame({key: part[key].to_numpy()[keep], "cluster": None, "s": nearest[keep],
                                        "closed": True}))
            i, c = np.nonzero(~closed)
            frames.append(pd.DataFrame({key: part[key].to_numpy()[i], "cluster": codes[c],
                                        "s": sums[i, c], "closed": False}))
        out = pd.concat(frames)
        out[group] = name
        return out

    def both_ways(name, left, right):
        if right is None:
            return one_way(name, left, left)
        return pd.concat([one_way(name, left, right), one_way(name, right, left)])

    found = tile_pairs(numbered, group, both_ways,
                       f"{key} {ktype}, cluster {ktype}, s double, closed boolean, {group} {gtype}",
                       [key, vector, "cluster", "_size"], tile)
    sums = found.groupBy(group, key, "cluster", "closed").agg(
        F.sum("s").alias("s"), F.min("s").alias("least"))
    own = numbered.select(group, key, F.col("cluster").alias("_mine"), F.col("_size").alias("_own"))
    other = sizes.select(group, F.col("cluster"), F.col("_size"))
    per = (sums.join(own, [group, key]).join(broadcast_if_small(other), [group, "cluster"], "left")
           .groupBy(group, key, "_own").agg(
               F.max(F.when(F.col("cluster") == F.col("_mine"), F.col("s"))).alias("_inside"),
               F.min(F.when(F.col("closed"), F.col("least")).when(
                   F.col("cluster") != F.col("_mine"), F.col("s") / F.col("_size"))).alias("_outside")))
    a = F.col("_inside") / (F.col("_own") - 1)
    b = F.col("_outside")
    value = F.when((F.col("_own") == 1) | b.isNull() | (F.greatest(a, b) == 0), 0.0).otherwise(
        (b - a) / F.greatest(a, b))
    shape = sizes.groupBy(group).agg(F.count(F.lit(1)).alias("_clusters"), F.sum("_size").alias("_points"))
    scores = per.groupBy(group).agg(F.avg(value).alias("_score"))
    penalty = (F.col("_clusters") <= 1) | (F.col("_clusters") == F.col("_points"))
    return shape.join(scores, group, "left").select(
        group, F.col("_clusters").alias("clusters"), F.when(penalty, 1.0).otherwise(F.col("_score")).alias("score"),
        penalty.alias("penalty"))


EPS_GRID = tuple(round(0.05 + 0.05 * i, 2) for i in range(10))


def tune_eps(words: DataFrame, grid: Sequence[float] = EPS_GRID, group: str = "id",
             key: str = "message", vector: str = "embedding", tile: int = STRIP
             ) -> tuple[DataFrame, DataFrame]:
    """Best bound per group by silhouette, and the clusters at that bound.

    The components of all bounds come from one pass over the pairs of a group and their silhouettes from a second
    one: clusters of a larger bound are unions of those of a smaller one, so a distance is taken once for
    all of them.  A penalised bound is the worst choice; ties go to the smallest bound.
    """
    bounds = sorted({float(e) for e in grid})
    points = materialize(number_points(words.select(group, key, vector), group, [key]))
    rooted = nested_components(points, group, key, vector, bounds, tile).withColumn("_order", F.reverse("_roots"))
    ordered = materialize(number_points(rooted, group, ["_order", "_n"], "_m", source=points).drop("_order"))
    clusters = F.array(*[F.sum((F.col("_roots")[i] == F.col("_n")).cast("bigint")) for i in range(len(bounds))])
    shape = materialize(ordered.groupBy(group).agg(F.count(F.lit(1)).alias("_total"), clusters.alias("_clusters")))
    sums = nested_silhouettes(ordered, shape, group, vector, len(bounds), tile)
    scored = shape.alias("a").join(sums.alias("b"), same_keys("a", "b", [group]), "left").select("a.*", "b._sums")

    def at(level: int):
        count = F.col("_clusters")[level]
        penalty = (count <= 1) | (count == F.col("_total"))
        score = F.when(penalty, 1.0).otherwise(F.col("_sums")[level] / F.col("_total"))
        worth = F.when(penalty, -1.0).otherwise(F.round(score, 12))
        return F.struct((-worth).alias("_worse"), F.lit(bounds[level]).alias("eps"), count.alias("clusters"),
                        score.alias("score"), F.lit(level + 1).alias("_level"))

    best = materialize(scored.select(group, F.array_min(F.array(*map(at, range(len(bounds))))).alias("_b"))
                       .select(group, "_b.eps", "_b.clusters", "_b.score", "_b._level"))
    chosen = materialize(ordered.alias("p").join(broadcast_if_small(best).alias("b"), same_keys("p", "b", [group])).select(
        F.col(f"p.{group}").alias(group), F.col(f"p.{key}").alias(key), F.element_at("p._roots", F.col("b._level")).alias("_root")))
    names = chosen.groupBy(group, "_root").agg(F.min(key).alias("cluster"))
    named = chosen.alias("p").join(names.alias("c"), same_keys("p", "c", [group, "_root"])).select(
        F.col(f"p.{group}").alias(group), F.col(f"p.{key}").alias(key), "c.cluster")
    return best.drop("_level"), named.distinct()


def build_dictionary(words: DataFrame, similarity: float = GROUP_SIMILARITY,
                     grid: Sequence[float] = EPS_GRID, tile: int = STRIP) -> DataFrame:
    """Dictionary with one label per message.

    Single-member groups use their translated text.  Groups with a high median similarity
    share one label; other groups are clustered first and get a label per cluster.
    """
    single, rest = single_member_labels(words)
    stats = small_table(group_similarity(rest).select("id", "median_similarity"))
    rated = rest.join(stats, "id")
    alike = rated.filter(F.col("median_similarity") > similarity).drop("median_similarity")
    mixed = materialize(rated.filter(~(F.col("median_similarity") > similarity)).drop("median_similarity"))
    one = alike.join(small_table(centroid_label(alike)), "id")
    _, clusters = tune_eps(mixed, grid, tile=tile)
    split = mixed.join(clusters, ["id", "message"])
    many = split.join(small_table(centroid_label(split, ("id", "cluster"))), ["id", "cluster"]).drop("cluster")
    return single.unionByName(one).unionByName(many).drop("embedding")
