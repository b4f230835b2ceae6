"""Embedding near-duplicates: binary codes of randomly rotated vectors decide which pairs are computed.

Two vectors of one label are linked if their cosine, in double precision, reaches a threshold;
groups are the connected components of the links.

1. Vectors of a label with the same components are one class, so exact copies cost nothing from here on.
2. A class is coded by the signs of its unit vector after random rotations.  With the signs of the
   first goes a correction factor, the inner product of the vector and its code.
3. Cuts of the code are bands; classes that agree in one meet in a bucket.  A band is as wide as
   buckets of about ``BUCKET`` classes need, and there are as many as let a pair at the threshold
   share none with probability ``1 - RECALL`` at most.  A label of up to ``BUCKET`` classes is one bucket.
4. Buckets are worked on in tiles: pairs of blocks of at most ``BLOCK`` classes, so a bucket that holds
   most of the rows is many tasks.  In a tile the code of one side and the rotated vector of the
   other give an unbiased estimate of the inner product (code product divided by the correction
   factor) with a bound of its error.  Pairs whose upper bound is below the threshold end there;
   the cosine of all others is computed exactly.
5. A pair counts in the first band it agrees in.  What leaves a tile is a number per class and a
   star per group found, never the pairs.

Vectors that are null, zero, or hold null or non-finite components, and rows without a label, are
linked with nothing; neither are rows without an id, whose component is null and which are kept.
A shorter vector counts as 0 in the missing components.  Rows that agree in id, label and
vector are one.  Rows that only share an id are different vectors.  Other columns are not read.
An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.graph import star_forest
from sessionloom.llm.textbytes import U, mix
from sessionloom.operators.scale import broadcast_if_small, materialize

BUCKET = 512
BLOCK = 1024
RECALL = 0.9999       # of a pair that just reaches the threshold
EPSILON = 4.0         # the error bound in standard deviations, at least
SEED = 20

_rotations: dict[tuple[int, int], np.ndarray] = {}


def rotation(width: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same on every worker."""
    if (width, number) not in _rotations:
        q, r = np.linalg.qr(np.random.default_rng([SEED, width, number]).standard_normal((width, width)))
        _rotations[width, number] = q * np.sign(np.diag(r))
    return _rotations[width, number]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square overflows or vanishes."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def plan_bands(classes: int, similarity: float, bucket: int = BUCKET, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a band, number of bands) for a label of so many classes."""
    bits = max(0, math.ceil(math.log2(max(1, classes) / bucket)))
    agree = 1 - math.acos(similarity) / math.pi
    return (bits, math.ceil(math.log(1 - recall) / math.log(1 - agree**bits))) if bits else (0, 1)


def code(vectors: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``bits`` signs of each unit vector, packed, and the correction factor of the first rotation."""
    width = vectors.shape[1]
    turned = [vectors @ rotation(width, r).T for r in range(max(1, -(-bits // width)))]
    return np.packbits(np.hstack(turned) > 0, axis=1), np.abs(turned[0]).sum(axis=1) / math.sqrt(width)


def bounds(turned: np.ndarray, signs: np.ndarray, factor: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of rotated unit vectors and coded ones, and the bound of their errors.

    In few dimensions the bound is the largest error there can be.
    """
    width = turned.shape[1]
    estimate = turned @ (signs.T * (2.0 / math.sqrt(width)) - 1.0 / math.sqrt(width)) / factor
    share = min(1.0, epsilon / math.sqrt(max(1, width - 1)))
    return estimate, share * np.sqrt(np.maximum(0, 1 - factor**2)) / factor


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b)


def linked_pairs(a: dict, b: dict | None, band: int, bits: int, similarity: float, step: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the linked pairs of two sides (or of one, each pair once) that agree in no band before ``band``."""
    other = a if b is None else b
    width = a["unit"].shape[1]
    turned = a["unit"] @ rotation(width, 0).T
    for first in range(0, len(turned), step):
        estimate, error = bounds(turned[first:first + step], other["bits"][:, :width], other["factor"])
        i, j = np.nonzero(estimate + error >= similarity)
        i += first
        if b is None:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), 1 << 14):
            x, y = i[at:at + (1 << 14)], j[at:at + (1 << 14)]
            real = cosines(a["unit"][x], other["unit"][y]) >= similarity
            x, y = x[real], y[real]
            if band and len(x):
                differ = (a["bits"][x, :band * bits] != other["bits"][y, :band * bits]).reshape(len(x), band, bits).any(axis=2)
                new = differ.all(axis=1)
                x, y = x[new], y[new]
            if len(x):
                yield x, y


def _smallest(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest position of each one's connected component."""
    root = np.arange(n)
    while True:
        before = root.copy()
        for x, y in pairs:
            low = np.minimum(root[x], root[y])
            np.minimum.at(root, x, low)
            np.minimum.at(root, y, low)
        root = root[root]
        if (root == before).all():
            return root


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(pc.list_value_length(column))
    values = np.zeros((len(column), width))
    values[np.arange(width)[None, :] < lengths[:, None]] = np.asarray(column.flatten())
    return values


def link_vectors(df: DataFrame, similarity: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                 bucket: int = BUCKET, block: int = BLOCK, recall: float = RECALL) -> DataFrame:
    """For every vector ``key``, ``n_links``, ``component_id`` and ``kept``."""
    real = "float" if df.schema[vector].dataType.simpleString() == "array<float>" else "double"
    rows = materialize(df.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast(f"array<{real}>").alias("v")).distinct())
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    classes = materialize(rows.filter("sound").groupBy("label", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
                          .withColumn("class", F.monotonically_increasing_id()))
    sizes = classes.groupBy("label").agg(F.count(F.lit(1)).alias("classes"))
    width = classes.agg(F.max(F.size("v"))).first()[0] or 1

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column("classes").to_numpy()
            units = unit(_matrix(batch.column("v"), width)) if batch.num_rows else np.zeros((0, width))
            for n in np.unique(of):
                bits, bands = plan_bands(int(n), similarity, bucket, recall)
                mine = np.flatnonzero(of == n)
                packed, factor = code(units[mine], max(bits * bands, 1))
                cut = np.unpackbits(packed, axis=1)[:, :bits * bands].reshape(len(mine), bands, bits).astype(np.uint64)
                number = (cut << np.arange(bits, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
                salt = np.arange(bands, dtype=np.uint64)[None, :] * U(0x9E3779B97F4A7C15)
                with np.errstate(over="ignore"):
                    place = mix(mix(number) + salt).view(np.int64)
                take = pa.array(mine)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("class").take(take), batch.column("label").take(take), batch.column("copies").take(take), batch.column("v").take(take),
                     pa.array([p.tobytes() for p in packed], pa.binary()), pa.array(factor), pa.array(np.full(len(mine), bits, np.int32)),
                     pa.array(list(place), pa.list_(pa.int64()))],
                    names=["class", "label", "copies", "v", "code", "factor", "bits", "places"])

    kind = df.schema[label].dataType.simpleString()
    coded = materialize(classes.join(broadcast_if_small(sizes), "label").select("class", "label", "copies", "v", "classes").mapInArrow(
        encode, f"class long, label {kind}, copies long, v array<{real}>, code binary, factor double, bits int, places array<long>"))

    # Buckets of more than a block, by counts that are combined before the shuffle.
    large = (coded.select("label", F.posexplode("places").alias("band", "place")).groupBy("label", "band", "place")
             .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
             .select("label", "band", "place", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    members = coded.select("class", "label", "copies", "v", "code", "factor", "bits", F.posexplode("places").alias("band", "place"))
    members = members.join(broadcast_if_small(materialize(large)), ["label", "band", "place"])
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    tiles = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "label", "band", "place", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own",
        "class", "copies", "v", "code", "factor", "bits")

    def work(table: pa.Table) -> pa.Table:
        get = {name: table.column(name).to_numpy() for name in ("own", "class", "copies", "factor")}
        order = np.argsort(get["class"])
        get = {name: values[order] for name, values in get.items()}
        codes = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(table.num_rows, -1)[order]
        every = {"unit": unit(_matrix(table.column("v"), width))[order], "bits": np.unpackbits(codes, axis=1).astype(np.float32), "factor": get["factor"]}
        band, bits = table.column("band")[0].as_py(), table.column("bits")[0].as_py()
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        first = np.flatnonzero(get["own"] == low)
        second = None if low == high else np.flatnonzero(get["own"] == high)
        pick = lambda at: {name: values[at] for name, values in every.items()}
        links, pairs = np.zeros(table.num_rows, np.int64), []
        for x, y in linked_pairs(pick(first), None if second is None else pick(second), band, bits, similarity):
            x, y = first[x], (first if second is None else second)[y]
            np.add.at(links, x, get["copies"][y])
            np.add.at(links, y, get["copies"][x])
            pairs = [(np.arange(len(links)), _smallest(len(links), [*pairs, (x, y)]))]   # a star per group so far
        found = np.flatnonzero(links)
        root = pairs[0][1] if pairs else np.arange(0)
        return pa.table({"class": get["class"][found], "links": links[found], "root": get["class"][root[found]] if len(found) else np.zeros(0, np.int64)})

    found = materialize(tiles.groupBy("label", "band", "place", "low", "high").applyInArrow(work, "class long, links long, root long"))
    forest = star_forest(found.select(F.col("class").alias("a"), F.col("root").alias("b")))
    degree = found.groupBy("class").agg(F.sum("links").alias("links"))
    placed = (classes.join(degree, "class", "left").join(forest.select(F.col("a").alias("class"), F.col("b").alias("_root")), "class", "left")
              .withColumn("_root", F.coalesce("_root", "class")))
    least = placed.groupBy("_root").agg(F.min("rep").alias("_component"))
    placed = placed.join(least, "_root").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), "_component")
    sound_rows = rows.filter("sound").join(placed, ["label", "v"]).select("id", "n", "_component")
    others = rows.filter("NOT sound").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("_component"))
    return sound_rows.unionByName(others).select(
        F.col("id").alias(key), F.col("n").alias("n_links"), F.col("_component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("_component"), F.lit(True)).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (SELECT DISTINCT vec_id, label, embedding FROM embeddings),
sound AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM v
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = v.vec_id"""
