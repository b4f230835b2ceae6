"""Near-duplicate groups by MinHash: one permutation, optimal densification, stars in buckets.

A document's set holds the distinct shingles of five words (a shorter text is one shingle).
Two documents are linked if 100 * |intersection| >= 75 * |union|; groups are the connected
components of the links.

1. One hash per shingle fills ``BINS`` bins with minima; an empty bin takes the value of a bin
   drawn by its own sequence of hashes (optimal densification).  Four bins make a band; 32
   bands leave a pair of similarity 0.75 without a shared bucket with probability 5e-6.
2. Documents with the same set are one class, so exact copies cost nothing from here on.
3. Every bucket gives a star: edges from its smallest class to the others, so as many edges as
   members.  Edges whose set sizes exclude a link go; the rest is confirmed on the full sets,
   first the most frequent edge of every class, then those that would still join two components.
4. Documents in buckets that still hold several components are compared by an exact prefix
   filter: two sets of that similarity share a shingle among the rarest quarter of each.
   Shingles that no other component has are the rarest, so documents that only share a
   passage drop out; what is left is confirmed on the full sets.

Sets are sets of 64-bit hashes.  Null and empty texts have no shingles and no links.  Rows
that share an id are one document.  A null id has a null component, is linked with nothing and
is kept.  Other columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.llm.graph import star_forest
from sessionloom.llm.textbytes import LOWER, U, mix, prefix_sums, span_hashes, text_blocks, words
from sessionloom.operators.scale import broadcast_if_small, materialize

SHINGLE = 5
BINS = 128
ROWS = 4
_STEP = 0xD6E8FEB86659FD93
_EMPTY = np.iinfo(np.uint64).max


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text of a block."""
    data = LOWER[data]
    starts, ends, owner = words(data, offsets)
    with np.errstate(over="ignore"):
        h = span_hashes(prefix_sums(data), starts, ends)
        first = np.searchsorted(owner, np.arange(len(offsets)))
        weights = [U(pow(_STEP, i, 1 << 64)) for i in range(shingle)]
        rolled = np.zeros(max(0, len(h) - shingle + 1), dtype=U)
        for i in range(shingle):
            rolled += h[i:i + len(rolled)] * weights[i]
        rolled = mix(rolled)
        sets = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            n = b - a
            if n >= shingle:
                sets.append(np.unique(rolled[a:b - shingle + 1]))
            elif n:
                short = sum((h[a + i:a + i + 1] * weights[i] for i in range(n)), np.zeros(1, dtype=U))
                sets.append(mix(short + U(n * 0x632BE59BD9B4E019 % (1 << 64))))
            else:
                sets.append(np.zeros(0, dtype=U))
    return sets


def signatures(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """One-permutation minima of each set, densified; a row of empty marks for an empty set."""
    sizes = np.array([len(s) for s in sets])
    found = np.full(len(sets) * bins, _EMPTY, dtype=U)
    if not sizes.sum():
        return found.reshape(len(sets), bins)
    every = np.concatenate(sets)
    shift = U(bins.bit_length() - 1)
    owner = np.repeat(np.arange(len(sets)), sizes)
    np.minimum.at(found, owner * bins + (every & U(bins - 1)).astype(np.int64), every >> shift)
    found = found.reshape(len(sets), bins)
    filled = found != _EMPTY
    row, column = np.nonzero(~filled & (sizes > 0)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        with np.errstate(over="ignore"):
            drawn = mix(column.astype(U) * U(_STEP) + U(attempt * 0x9E3779B97F4A7C15 % (1 << 64)))
        donor = (drawn & U(bins - 1)).astype(np.int64)
        ok = filled[row, donor]
        found[row[ok], column[ok]] = found[row[ok], donor[ok]]
        row, column = row[~ok], column[~ok]
    return found


def _sketch(sets: list[np.ndarray]) -> dict[str, np.ndarray]:
    signs = signatures(sets)
    with np.errstate(over="ignore"):
        bands = np.zeros((len(sets), BINS // ROWS), dtype=U)
        for i in range(ROWS):
            bands = mix(bands + signs[:, i::ROWS] * U(_STEP)) + U(i)
        bands = mix(bands + np.arange(BINS // ROWS, dtype=U) * U(0xA0761D6478BD642F))
        ids = [(int(mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U)), int(mix(s + U(0x14057B7EF767814F)).sum(dtype=U))) for s in sets]
    return {"n": np.array([len(s) for s in sets], np.int64), "bands": bands.view(np.int64),
            "set": np.array(ids, dtype=U).reshape(len(sets), 2).view(np.int64)}


def _sketches(df: DataFrame, key: str, text: str) -> DataFrame:
    width = BINS // ROWS

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_blocks(batch.column("_text")):
                s = _sketch(shingle_sets(data, offsets))
                bands = pa.ListArray.from_arrays(np.arange(0, width * (last - first) + 1, width, dtype=np.int32), s["bands"].ravel())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(first, last - first), pa.array(s["n"]), pa.array(s["set"][:, 0].copy()),
                     pa.array(s["set"][:, 1].copy()), bands], names=["id", "n", "set1", "set2", "bands"])

    return df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("_text")).mapInArrow(
        compute, "id long, n long, set1 long, set2 long, bands array<long>")


def _sets(df: DataFrame, key: str, text: str) -> DataFrame:
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_blocks(batch.column("_text")):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(first, last - first), pa.array([s.tobytes() for s in shingle_sets(data, offsets)], pa.binary())],
                    names=["id", "members"])

    return df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("_text")).mapInArrow(compute, "id long, members binary")


def _confirm(edges: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The edges (a, b) whose full sets reach the similarity (in hundredths)."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_py(), U), np.frombuffer(y.as_py(), U)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(100 * shared >= similarity * (len(x) + len(y) - shared) and shared > 0)
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    pairs = (edges.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("members").alias("x")), "a")
             .join(sets.select(F.col("id").alias("b"), F.col("members").alias("y")), "b").select("a", "b", "x", "y"))
    return materialize(pairs.mapInArrow(compare, "a long, b long").distinct())


def _fits(a: str, b: str, similarity: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * similarity


def _across(edges: DataFrame, forest: DataFrame) -> DataFrame:
    """The edges whose ends lie in different components."""
    root = lambda end: forest.select(F.col("a").alias(end), F.col("b").alias(f"_{end}"))
    return (edges.join(root("a"), "a", "left").join(root("b"), "b", "left")
            .filter(F.coalesce("_a", "a") != F.coalesce("_b", "b")).drop("_a", "_b"))


def _open_pairs(shared: DataFrame, sets: DataFrame, forest: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) in different components that may be similar, of sets that share a bucket with another component."""
    root = forest.select(F.col("a").alias("rep"), F.col("b").alias("_root"))
    tagged = shared.join(root, "rep", "left").withColumn("root", F.coalesce("_root", "rep")).drop("_root")
    several = tagged.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    open_sets = tagged.join(several.select("bucket"), "bucket", "left_semi").select(F.col("rep").alias("id"), "root").distinct()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                members = np.frombuffer(batch.column("members")[row].as_py(), np.int64)
                n = len(members)
                same = lambda name: pa.array(np.full(n, batch.column(name)[row].as_py()), pa.int64())
                yield pa.RecordBatch.from_arrays([same("id"), same("root"), pa.array(np.full(n, n)), pa.array(members)],
                                                 names=["id", "root", "n", "shingle"])

    spelled = materialize(open_sets.join(sets, "id").mapInArrow(spread, "id long, root long, n long, shingle long"))
    across = spelled.groupBy("shingle").agg(F.count(F.lit(1)).alias("often"), F.min("root").alias("low"), F.max("root").alias("high"))
    common = spelled.join(across.filter("low < high").select("shingle", "often"), "shingle")
    # The prefix has n - ceil(similarity * n) + 1 shingles; those of one component only fill it first.
    held = common.groupBy("id").agg(F.count(F.lit(1)).alias("held"))
    room = F.col("n") - F.ceil(F.col("n") * similarity / 100) + 1 - (F.col("n") - F.col("held"))
    order = F.row_number().over(Window.partitionBy("id").orderBy("often", "shingle"))
    prefix = materialize(common.join(held, "id").withColumn("room", room).filter("room > 0").withColumn("_rank", order)
                         .filter("_rank <= room").select("id", "root", "n", "shingle", (F.col("held") - F.col("_rank")).alias("later")))
    left, right = prefix.alias("l"), prefix.alias("r")
    return (left.join(right, (F.col("l.shingle") == F.col("r.shingle")) & (F.col("l.id") < F.col("r.id"))
                      & (F.col("l.root") != F.col("r.root")) & _fits("l.n", "r.n", similarity)
                      # As if this were the first they share: a pair whose first does not get here is no link.
                      & ((F.least("l.later", "r.later") + 1) * (100 + similarity) >= (F.col("l.n") + F.col("r.n")) * similarity))
            .groupBy(F.col("l.id").alias("a"), F.col("r.id").alias("b"), (F.col("l.n") + F.col("r.n")).alias("n"))
            # What the prefixes share, and what can still follow the last of it in both sets.
            .agg((F.count(F.lit(1)) + F.min(F.least("l.later", "r.later"))).alias("most"))
            .filter(F.col("most") * (100 + similarity) >= F.col("n") * similarity).select("a", "b"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: int = 75) -> DataFrame:
    """For every row ``key``, ``n_shingles``, ``component_id`` and ``kept``."""
    sketches = materialize(_sketches(df, key, text))
    classes = materialize(
        sketches.filter("n > 0 AND id IS NOT NULL").groupBy("set1", "set2", "n")
        .agg(F.min("id").alias("rep"), F.any_value("bands").alias("bands")))

    members = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    centres = members.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("centre"), F.count(F.lit(1)).alias("size"))
    shared = materialize(members.join(centres.filter("size > 1").drop("size"), "bucket"))
    edges = materialize(
        shared.filter((F.col("rep") != F.col("centre.rep")) & _fits("n", "centre.n", similarity))
        .groupBy(F.col("centre.rep").alias("a"), F.col("rep").alias("b")).agg(F.count(F.lit(1)).alias("bands")))
    shared = shared.select("bucket", "rep")

    asked = broadcast_if_small(materialize(shared.select(F.col("rep").alias("id")).distinct()))
    sets = materialize(_sets(df.join(asked, df[key] == asked["id"], "left_semi"), key, text).distinct())

    best = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("bands"), "a"))
    ranked = edges.withColumn("_rank", best)
    forest = star_forest(_confirm(ranked.filter("_rank = 1"), sets, similarity))
    rest = _across(ranked.filter("_rank > 1"), forest)
    forest = star_forest(forest.unionByName(_confirm(rest, sets, similarity)))
    more = _open_pairs(shared, sets, forest, similarity).join(edges, ["a", "b"], "left_anti")
    forest = star_forest(forest.unionByName(_confirm(materialize(more), sets, similarity)))

    root = forest.select(F.col("a").alias("rep"), F.col("b").alias("_root"))
    group = classes.join(root, "rep", "left").select("set1", "set2", "n", F.coalesce("_root", "rep").alias("_group"))
    placed = sketches.select("id", "n", "set1", "set2").join(group, ["set1", "set2", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("_group", "id"))
    return placed.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"),
                         F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
