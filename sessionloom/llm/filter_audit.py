"""Interaction of filters: what each one removes in every order they can be applied in.

A document fails some of the filters; ``failures`` gives these as the bits of ``mask`` (bit i
for the i-th filter).  The states of the subset lattice are the sets of filters applied so far,
and an edge applies one more.  What an edge removes depends on its state and filter only, so

* counts of documents per (part, mask) are all that is gathered: combined before the shuffle,
  at most 2^filters rows per part;
* every edge gets its numbers from these counts;
* counting paths forward (orders that reach a state) and backward (orders that leave it)
  gives the number of orders that use an edge, the weight of its removals in the Shapley sum;
* the steps of every order are read from the edges they pass.

Null texts count as empty, a null part is the empty string.  "Identical to a smaller id" looks
at the whole table, by SHA-256; rows without an id are never smaller nor larger than others, rows that
share id and text are no copies of each other.  Several label rows of an id count as one that has
all their marks.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.operators.scale import materialize

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS = 200
MIN_DISTINCT = 50     # percent of words
MAX_CAPITALS = 3      # percent of code points
MARKS = "[#$%&*|]"


def text_failures(text: Column) -> list[Column]:
    """Failure of the filters that look at one text: length, repetition, capitals, marks."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return [F.size(words) < MIN_WORDS,
            100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * F.size(words),
            100 * F.regexp_count(text, F.lit("[A-Z]")) > MAX_CAPITALS * F.length(text),
            text.rlike(MARKS)]


def failures(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """For every row ``key``, ``part`` and ``mask``, the bits of the filters A to E that it fails."""
    whole = F.coalesce(F.col(text), F.lit(""))
    own = sum((failed.cast("int") * (1 << i) for i, failed in enumerate(text_failures(whole))), F.lit(0))
    rows = materialize(docs.select(F.col(key).alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), own.alias("own"),
                                   F.unhex(F.sha2(whole, 256)).alias("digest")))
    # Joined by digest and id, not by digest alone: the copies of a text meet in no one task.
    firsts = rows.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    repeated = F.col("first").isNull() & F.col("id").isNotNull()
    return rows.join(firsts, ["digest", "id"], "left").select(
        F.col("id").alias(key), "part", (F.col("own") + repeated.cast("int") * 16).alias("mask"))


def edge_weights(n: int) -> dict[tuple[int, int], int]:
    """(state, filter) -> number of orders of ``n`` filters that apply the filter in that state."""
    states = range(1 << n)
    reach, leave = [0] * (1 << n), [0] * (1 << n)
    reach[0] = leave[-1] = 1
    edges = [(s, f) for s in states for f in range(n) if not s >> f & 1]
    for s, f in edges:                      # a state comes after all its subsets
        reach[s | 1 << f] += reach[s]
    for s, f in reversed(edges):
        leave[s] += leave[s | 1 << f]
    return {(s, f): reach[s] * leave[s | 1 << f] for s, f in edges}


def audit(masks: DataFrame, filters: Sequence[str] = FILTERS, flags: Sequence[str] = ()) -> DataFrame:
    """One row per part, order of the filters and step, from rows (``part``, ``mask``, boolean ``flags``).

    Of the filter of the step: ``kept`` after it, ``removed`` by it, ``redundant`` (fails it, removed
    earlier), ``unique_fails`` (fails no other), one ``<flag>_lost`` per flag (removed by it, flag
    set) and ``shapley``, what it removes summed over all orders.
    """
    spark, n = masks.sparkSession, len(filters)
    counts = masks.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("docs"), *(F.sum(F.coalesce(F.col(f).cast("long"), F.lit(0))).alias(f) for f in flags))
    edge = F.explode(F.array(*(F.struct(F.lit(s).alias("state"), F.lit(f).alias("filter"), F.lit(w).cast("long").alias("weight"))
                               for (s, f), w in edge_weights(n).items()))).alias("edge")
    met = counts.select("*", edge).select("part", "mask", "docs", *flags, "edge.*")
    before = F.col("mask").bitwiseAND(F.col("state")) != 0
    bit = F.call_function("shiftleft", F.lit(1), F.col("filter"))
    fails = F.col("mask").bitwiseAND(bit) != 0
    added = lambda value, condition: F.sum(F.when(condition, value).otherwise(0))
    edges = met.groupBy("part", "state", "filter", "weight").agg(
        added(F.col("docs"), ~before & ~fails).alias("kept"), added(F.col("docs"), ~before & fails).alias("removed"),
        added(F.col("docs"), before & fails).alias("redundant"), added(F.col("docs"), F.col("mask") == bit).alias("unique_fails"),
        *(added(F.col(f), ~before & fails).alias(f"{f}_lost") for f in flags))
    edges = edges.withColumn("shapley", F.sum(F.col("removed") * F.col("weight")).over(Window.partitionBy("part", "filter")))

    steps = []
    for order in permutations(range(n)):
        state = 0
        for step, f in enumerate(order):
            steps.append(("".join(filters[i] for i in order), step + 1, state, f))
            state |= 1 << f
    # As many rows as orders times filters, whatever the input: 600 for five filters.
    steps = spark.createDataFrame(steps, "filter_order string, step int, state int, filter int").coalesce(1)
    return edges.join(F.broadcast(steps), ["state", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *(f"{f}_lost" for f in flags), "shapley")


def audit_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """``audit`` of the filters A to E over documents, with what is lost of good and of toxic ones."""
    marks = (labels.filter(F.col(key).isNotNull() & ((F.col("quality") == 1) | (F.col("toxic") == 1))).groupBy(key)
             .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")))
    return audit(failures(docs, key).join(marks, key, "left"), flags=("good", "toxic"))


ORACLE = """
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS mask
  FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
o AS (
  SELECT v.f || w.f || x.f || y.f || z.f AS filter_order, [v.b, w.b, x.b, y.b, z.b] AS bits
  FROM f v, f w, f x, f y, f z WHERE v.b + w.b + x.b + y.b + z.b = 31 AND (v.b | w.b | x.b | y.b | z.b) = 31),
s AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::BIGINT AS before
  FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM o)),
r AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r"""
