"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

Texts become lower-cased words (runs of letters and digits), words become hashes.  A mask is a
set of places in a span of eleven words; the hash of the words at these places is a seed, and
the places left out may hold anything.  Seeds of benchmark items are joined to those of all
documents.  Every alignment of a document with an item that a seed proposes is verified on the
whole item: a document is contaminated if thirteen neighbouring words of the item (all, if it
has eleven or twelve) agree with it in all but two places (but one), in the same order and distance, so
that replaced words do not hide a passage.

Items of which a window of thirteen words repeats are represented there by the smallest item,
so that phrases common to many items do not multiply the seeds.  Where such a window agrees, the
other items that have it are aligned with the document too and verified on the whole item, so
``n_items`` and ``matched`` cover every item, copies included.

Items with fewer than eleven words are too short to tell a leak from chance and match nothing.
Null and empty texts match nothing.  Rows are judged one by one, by id and text; ``drop_leaks``
can also drop every row of an id, null ids counting as one.  An empty benchmark leaves every
document clean; an empty table gives no rows.
Columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.repeats import text_key
from sessionloom.operators.scale import broadcast_if_small, materialize

SPAN = 11
# Places of a seed.  Whichever two words of thirteen are replaced, one of the six seeds of the
# window stays whole; the masks share no place, so that this holds for one word of eleven too.
MASKS = ((0, 2, 3, 5, 6), (1, 4, 7, 9, 10))
WINDOW = 13
AGREE = 11


def word_hashes(text: str) -> Column:
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(hashes: str, mask: int) -> Column:
    """The seeds of one mask at every place of a list of word hashes."""
    h = F.col(hashes)
    places = F.sequence(F.lit(0), F.size(h) - SPAN)
    return F.transform(places, lambda i: F.xxhash64(F.lit(mask), *(F.get(h, i + place) for place in MASKS[mask])))


def _exploded_seeds(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, ``at`` and ``seed`` for every seed of ``h``.

    Lists that are too short give a null, dropped after the generator: a filter before it would
    be rewritten in terms of the text, and hash the words again for every place of a mask."""
    seeds = F.when(F.size("h") >= SPAN, F.concat(*(_seeds("h", m) for m in range(len(MASKS)))))
    every = rows.select(*keep, (F.size("h") - SPAN + 1).alias("_n"), seeds.alias("_seeds"))
    return every.select(*keep, "_n", F.posexplode_outer("_seeds").alias("_at", "seed")).filter("seed IS NOT NULL").select(
        *keep, F.pmod("_at", F.col("_n")).alias("at"), "seed")


def _windows(items: DataFrame) -> DataFrame:
    """(item, q, window) for every window of words of ``items`` (item, h)."""
    size = F.least(F.size("h"), F.lit(WINDOW))
    return items.filter(F.size("h") >= SPAN).select("item", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.size("h") - size), lambda q: F.slice(F.col("h"), q + 1, size))).alias("q", "window"))


def benchmark_seeds(items: DataFrame) -> DataFrame:
    """(seed, item, at) of ``items`` (item, h), each window of words by its smallest item."""
    first = _windows(items).groupBy("window").agg(F.min(F.struct("item", "q")).alias("w")).select("w.item", "w.q", F.col("window").alias("h"))
    return _exploded_seeds(first, ["item", "q"]).select("seed", "item", (F.col("q") + F.col("at")).alias("at")).distinct()


def shared_windows(items: DataFrame) -> DataFrame:
    """(_first, other, move, _at): the windows ``_at`` of ``_first`` represent windows of ``other``, ``move`` places before."""
    windows = _windows(items)
    first = windows.groupBy("window").agg(F.min(F.struct("item", "q")).alias("w"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return (windows.join(first, "window").filter(F.struct("item", "q") != F.col("w"))
            .groupBy(F.col("w.item").alias("_first"), F.col("item").alias("other"), (F.col("w.q") - F.col("q")).alias("move"))
            .agg(F.collect_set("w.q").alias("_at")))


def _agreement(item: Column, document: Column, shift: Column) -> tuple[Column, Column]:
    """Agreeing words in every window of the item, and in the whole item, at this alignment."""
    same = F.transform(item, lambda w, i: F.coalesce((F.get(document, i + shift) == w).cast("int"), F.lit(0)))
    add = lambda a, x: a + x
    starts = F.sequence(F.lit(1), F.greatest(F.size(item) - (WINDOW - 1), F.lit(1)))
    return F.transform(starts, lambda s: F.aggregate(F.slice(same, s, WINDOW), F.lit(0), add)), F.aggregate(same, F.lit(0), add)


def _verified(documents: DataFrame, hits: DataFrame, items: DataFrame) -> DataFrame:
    """Those alignments ``hits`` (_key, _t, item, shift) that hold, with the windows ``at`` that agree and ``matched``."""
    proposed = materialize(hits.groupBy("_key", "_t").agg(F.collect_list(F.struct("item", "shift")).alias("hits"))).withColumnsRenamed(
        {"_key": "_hit", "_t": "_hit_t"})
    aligned = (documents.join(broadcast_if_small(proposed), F.col("_key").eqNullSafe(F.col("_hit")) & (F.col("_t") == F.col("_hit_t")))
               .select("_key", "_t", word_hashes("_text").alias("d"), "hits")
               .select("_key", "_t", "d", F.explode("hits").alias("hit")).select("_key", "_t", "d", "hit.item", "hit.shift")
               .join(broadcast_if_small(items), "item"))
    agreeing, matched = _agreement(F.col("h"), F.col("d"), F.col("shift"))
    need = F.when(F.size("h") >= WINDOW, AGREE).otherwise(F.ceil(F.size("h") * F.lit(AGREE / WINDOW)))
    at = F.filter(F.transform(agreeing, lambda n, q: F.when(n >= need, q)), lambda q: q.isNotNull())
    return aligned.select("_key", "_t", "item", "shift", at.alias("at"), matched.alias("matched")).filter(F.size("at") > 0)


def find_leaks(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
               item_text: str = "text", every_item: bool = True) -> DataFrame:
    """The contaminated (``key``, ``text_key``): ``item_id`` (smallest), ``n_items``, ``matched`` (most agreeing words).

    Without ``every_item`` the last two cover only the items that represent a window."""
    items = materialize(benchmark.select(F.col(item).cast("long").alias("item"), word_hashes(item_text).alias("h"))
                        .filter(F.col("item").isNotNull()).distinct())
    seeds = broadcast_if_small(materialize(benchmark_seeds(items)))
    documents = df.select(F.col(key).alias("_key"), text_key(text).alias("_t"), F.col(text).alias("_text"))
    own = _exploded_seeds(documents.select("_key", "_t", word_hashes("_text").alias("h")), ["_key", "_t"])
    hits = (own.join(seeds.withColumnRenamed("at", "_at"), "seed")
            .select("_key", "_t", "item", (F.col("at") - F.col("_at")).alias("shift")).distinct())
    found = _verified(documents, hits, items)
    shared = materialize(shared_windows(items)) if every_item else None
    if shared is not None and not shared.isEmpty():
        found = materialize(found)
        more = (found.join(broadcast_if_small(shared), F.col("item") == F.col("_first")).filter(F.arrays_overlap("at", "_at"))
                .select("_key", "_t", F.col("other").alias("item"), (F.col("shift") + F.col("move")).alias("shift")).distinct())
        found = found.unionByName(_verified(documents, more, items))
    return found.groupBy("_key", "_t").agg(
        F.min("item").alias("item_id"), F.count_distinct("item").alias("n_items"), F.max("matched").alias("matched")).withColumnsRenamed(
        {"_key": key, "_t": "text_key"})


def _same_row(key: str, text: str) -> Column:
    return F.col(key).eqNullSafe(F.col("_leak")) & (text_key(text) == F.col("_leak_t"))


def mark_leaks(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **names: str) -> DataFrame:
    """For every row ``key``, ``contaminated``, ``item_id``, ``n_items`` and ``matched``."""
    leaks = materialize(find_leaks(df, benchmark, key, text, **names)).withColumnsRenamed(
        {key: "_leak", "text_key": "_leak_t"}).withColumn("contaminated", F.lit(True))
    rows = df.select(key, text).join(broadcast_if_small(leaks), _same_row(key, text), "left")
    return rows.select(key, F.coalesce("contaminated", F.lit(False)).alias("contaminated"), "item_id",
                       F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("matched", F.lit(0)).alias("matched"))


def drop_leaks(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", by_row: bool = False, **names: str) -> DataFrame:
    """``df`` without the contaminated rows, or without every row of an id that has one."""
    leaks = materialize(find_leaks(df, benchmark, key, text, every_item=False, **names).select(
        F.col(key).alias("_leak"), F.col("text_key").alias("_leak_t")))
    if by_row:
        return df.join(broadcast_if_small(leaks), _same_row(key, text), "left_anti")
    return df.join(broadcast_if_small(leaks), F.col(key).eqNullSafe(F.col("_leak")), "left_anti")
