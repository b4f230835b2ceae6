"""Train/validation/test splits.  The draw of a row depends on its key and a seed only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.hashing import hashed_int, uniform
from sessionloom.operators.ordered import global_number
from sessionloom.operators.scale import materialize, small_table


def split_random(df: DataFrame, key: str, test: float = 0.1, val: float = 0.1, seed: int = 1,
                 part: str | None = None, out: str = "split") -> DataFrame:
    """Label rows train, valid or test; ``part`` draws anew inside each time partition."""
    train = 1 - val - test
    if train < 0:
        raise ValueError("train_size cannot be negative.")
    r = uniform(*([F.col(part)] if part else []), F.col(key), seed)
    label = F.when(r <= train, "train").when(r <= train + val, "valid").when(r > 1 - test, "test")
    return df.withColumn(out, label)


def split_by_time(df: DataFrame, part: str, key: str, test: float = 0.1, val: float = 0.1, seed: int = 1) -> DataFrame:
    """Random splits inside each time partition."""
    return split_random(df, key, test, val, seed, part)


def walk_forward(df: DataFrame, part: str, start: int, end: int, split: str | None = None,
                 out: str = "window") -> DataFrame:
    """Rows of each step ``t``: train rows of ``t`` and valid rows of ``t + 1``.

    With ``split``, only rows labelled with that role count.  One pass: a row belongs to at
    most two steps.
    """
    t = F.col(part)
    roles = F.array(
        F.struct(t.alias(out), F.lit("train").alias("role")),
        F.struct((t - 1).alias(out), F.lit("valid").alias("role")))
    rows = (df.filter((t >= start) & (t <= end + 1)).select("*", F.explode(roles).alias("_r"))
            .select(*df.columns, f"_r.{out}", "_r.role")
            .filter((F.col(out) >= start) & (F.col(out) <= end)))
    return rows.filter(F.col("role") == F.col(split)) if split else rows


def split_balanced(df: DataFrame, session: str, item: str, train: float = 0.85, val: float = 0.15,
                   seed: int = 1, allow_overlap: bool = True) -> DataFrame:
    """(session, split): every item occurs in train and in val.

    Each item gives one random session to train and another to val (its only session to
    both).  The other sessions are shuffled and cut by ratio; truncation may leave a few
    out.  A session may land in both splits unless ``allow_overlap`` is off: then it stays
    in train and the promise may break.

    The smallest and the second smallest hash of an item's sessions are combinable minima,
    so an item in every session is not gathered anywhere.
    """
    pairs = df.select(session, item)
    draw = F.struct(hashed_int(F.col(item), F.col(session), "pick", seed).alias("h"), F.col(session).alias("s"))
    best = small_table(pairs.groupBy(item).agg(F.min(draw).alias("_first")))
    # The second pick is the minimum over the item's other sessions.
    rest = pairs.join(best, item).filter(F.col(session) != F.col("_first.s"))
    second = rest.groupBy(item).agg(F.min(draw).alias("_second"))
    picks = materialize(best.join(second, item, "left").select(
        F.col("_first.s").alias("t"), F.coalesce("_second.s", "_first.s").alias("v")))
    chosen = materialize(picks.select(F.col("t").alias(session), F.lit("train").alias("split"))
                         .unionByName(picks.select(F.col("v").alias(session), F.lit("val").alias("split"))).distinct())
    every = df.select(session).distinct()
    free = materialize(every.join(chosen.select(session).distinct(), session, "left_anti")
                       .withColumn("_h", F.md5(F.concat_ws("|", F.col(session).cast("string"), F.lit("rest"), F.lit(str(seed))))))
    total = free.count()
    n_train, n_val = int(train * total), int(val * total)
    numbered = global_number(free, ["_h", session], "_n")
    label = F.when(F.col("_n") <= n_train, "train").when(F.col("_n") <= n_train + n_val, "val")
    cut = numbered.select(session, label.alias("split")).filter(F.col("split").isNotNull())
    out = chosen.unionByName(cut)
    if not allow_overlap:
        out = out.groupBy(session).agg(F.min("split").alias("split"))
    return out
