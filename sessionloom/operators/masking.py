"""Prediction targets on session sequences held as arrays.  0 is the padding item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.hashing import hashed_int, uniform, uniform_int
from sessionloom.operators.ordered import global_number, sessionwise
from sessionloom.operators.sampling import log_uniform_id

PAD = 0


def _items(values) -> Column:
    return F.col(values) if isinstance(values, str) else values


def _length(items: Column) -> Column:
    return F.size(F.filter(items, lambda x: x != PAD))


def next_item_targets(values) -> Column:
    """The list shifted left by one, with a 0 at the end; where it is 0 there is no label."""
    items = _items(values)
    pad = F.array(F.lit(PAD).cast("bigint"))
    return F.when(F.size(items) == 0, items).otherwise(
        F.concat(F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0))), pad))


def label_mask(labels) -> Column:
    return F.transform(_items(labels), lambda x: x != PAD)


def last_item_target(values, items=None) -> Column:
    """Only the last real next-item label, 0 elsewhere.

    ``items`` names the item list that decides the place when ``values`` is a side list.
    """
    labels = next_item_targets(values)
    place = _length(next_item_targets(values if items is None else items)) - 1
    return F.transform(labels, lambda x, i: F.when(i == place, x).otherwise(F.lit(PAD).cast("bigint")))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row: a column that a function of list
    elements names would be put into it by the optimizer and computed for every element."""
    return F.get(F.transform(F.array(value), use), 0)


def _pick(positions: Column, *key) -> Column:
    """One of the positions, by the hash of the key; null if there are none."""
    return F.get(positions, F.pmod(hashed_int(*key), F.greatest(F.size(positions), F.lit(1)).cast("bigint")).cast("int"))


def _marked(flags: Column) -> Column:
    numbered = F.transform(flags, lambda f, i: F.when(f, i))
    return F.filter(numbered, lambda i: i.isNotNull())


def _leave_one(df: DataFrame, values: str, key: Column, seed: int) -> DataFrame:
    """If every real item is masked, one of them is shown again."""
    real = _length(F.col(values))
    df = df.withColumn("_at", _marked(F.col("_mask")))
    shown = F.when(F.size("_at") == real, _pick(F.col("_at"), key, "show", seed))
    return df.withColumn("_mask", _once(F.coalesce(shown.cast("int"), F.lit(-1)), lambda at: F.transform(
        "_mask", lambda m, i: m & (i != at))))


def _labels(df: DataFrame, values: str, out: str) -> DataFrame:
    label = F.zip_with(values, "_mask", lambda x, m: F.when(m, x).otherwise(F.lit(PAD).cast("bigint")))
    return df.withColumn(out, label)


def mlm_targets(df: DataFrame, session: str, values: str, p: float = 0.15, seed: int = 1,
                mode: str = "train", out: str = "labels") -> DataFrame:
    """Masked-item labels.

    Training masks each real item with probability ``p`` and one more at random, and shows
    one again if all are masked.  Evaluation masks the last item.  Inference adds one slot
    after the last item, labelled with that item.
    """
    items, key = F.col(values), F.col(session)
    length = _length(items)
    zero = F.lit(PAD).cast("bigint")
    if mode == "eval":
        return df.withColumn(out, F.transform(items, lambda x, i: F.when(i == length - 1, x).otherwise(zero)))
    if mode == "inference":
        longer = F.concat(items, F.array(zero))
        return df.withColumn(out, F.transform(longer, lambda x, i: F.when(
            (i == length) & (length > 0), F.get(items, length - 1)).otherwise(zero)))
    real = _marked(F.transform(items, lambda x: x != PAD))
    forced = F.coalesce(_once(real, lambda at: _pick(at, key, "force", seed)).cast("int"), F.lit(-1))
    df = df.withColumn("_mask", _once(forced, lambda at: F.transform(items, lambda x, i: (x != PAD) & (
        (uniform(key, i, seed) < p) | (i == at)))))
    df = _leave_one(df, values, key, seed)
    return _labels(df, values, out).drop("_mask", "_at")


def span_targets(df: DataFrame, session: str, values: str, p: float = 1 / 6, max_span: int = 5,
                 seed: int = 1, out: str = "labels") -> DataFrame:
    """Labels on random spans.

    From the start of the session on: draw a span length, reserve a context of
    ``int(length / p)`` rows, and mask the span at a random place inside it.  At least one
    item is masked, and one is shown again if all are.
    """
    items, key = F.col(values), F.col(session)

    def draw(step: Column) -> Column:
        def place(span: Column) -> Column:
            context = F.floor(span / p)
            offset = uniform_int(F.lit(0), context - span, key, step, "place", seed)
            return F.struct(span.alias("span"), context.alias("context"), offset.alias("offset"))

        return _once(uniform_int(1, max_span, key, step, "span", seed), place)

    empty = F.array().cast("array<struct<start:bigint,stop:bigint>>")

    def spans(length: Column) -> Column:
        steps = F.sequence(F.lit(1), F.greatest(F.ceil(length * p).cast("int") + 1, F.lit(1)))
        return F.aggregate(
            F.transform(steps, draw), F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("spans")),
            lambda acc, d: F.struct(
                (acc["at"] + d["context"]).alias("at"),
                F.when(acc["at"] < length, F.array_append(acc["spans"], F.struct(
                    (acc["at"] + d["offset"]).alias("start"),
                    (acc["at"] + d["offset"] + d["span"]).alias("stop")))).otherwise(acc["spans"]).alias("spans")))["spans"]

    flags = _once(_once(_length(items), spans), _flags)
    df = df.withColumn("_mask", _once(flags, lambda inside: F.transform(items, lambda x, i: (x != PAD) & F.coalesce(
        F.get(inside, i), F.lit(False)))))
    real = _marked(F.transform(items, lambda x: x != PAD))
    forced = F.when(~F.exists("_mask", lambda m: m), _once(real, lambda at: _pick(at, key, "force", seed)).cast("int"))
    df = df.withColumn("_mask", _once(forced, lambda at: F.transform("_mask", lambda m, i: m | F.coalesce(i == at, F.lit(False)))))
    df = _leave_one(df, values, key, seed)
    return _labels(df, values, out).drop("_mask", "_at")


def _flags(spans: Column) -> Column:
    """Whether each row lies in a span, up to the end of the last one; spans ascend and do not overlap."""
    def run(span: Column, i: Column) -> Column:
        before = span["start"] - F.coalesce(F.get(spans, i - 1)["stop"], F.lit(0))
        return F.concat(F.array_repeat(F.lit(False), before.cast("int")), F.array_repeat(F.lit(True), (span["stop"] - span["start"]).cast("int")))

    return F.flatten(F.transform(spans, run))


def corrupt_items(df: DataFrame, session: str, values: str, labels: str, max_id: int | Column,
                  min_id: int = 1, seed: int = 1) -> DataFrame:
    """Replace labelled items by sampled ids; ``is_replaced`` marks the places that changed."""
    places = F.arrays_zip(F.col(values).alias("x"), F.col(labels).alias("l"))
    drawn = F.transform(places, lambda p, i: F.when(
        p["l"] != PAD, log_uniform_id(uniform(F.col(session), i, "corrupt", seed), max_id, min_id)
    ).otherwise(p["x"]))
    return df.withColumn("corrupted", drawn).withColumn(
        "is_replaced", F.zip_with("corrupted", values, lambda c, x: c != x))


def swap_noise(df: DataFrame, key: str, value: str, p: float = 0.1, seed: int = 1, out: str | None = None) -> DataFrame:
    """Replace each non-padding value with probability ``p`` by one drawn from the same column.

    The replaced rows, in key order, take the first values of one random permutation of the
    whole column, without repetition.
    """
    k = F.col(key)
    marked = df.withColumns({
        "_swap": (F.col(value) != PAD) & (uniform(k, "swap", seed) < p),
        "_shuffle": F.md5(F.concat_ws("|", k.cast("string"), F.lit("order"), F.lit(str(seed))))})
    donors = global_number(marked.filter(F.col(value) != PAD).select("_shuffle", key, F.col(value).alias("_new")),
                           ("_shuffle", key), "_nth")
    takers = global_number(marked.filter("_swap").select(key), (key,), "_nth")
    swaps = takers.join(donors.select("_nth", "_new"), "_nth").select(key, "_new")
    return (marked.join(swaps, key, "left")
            .withColumn(out or value, F.coalesce("_new", value))
            .drop("_swap", "_shuffle", "_new"))
