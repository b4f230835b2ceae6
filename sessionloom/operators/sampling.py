"""Negative sampling and synthetic data; every draw is a hash of its key."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions.hashing import normal, uniform, uniform_int
from sessionloom.operators.sessions import aggregate_sessions


def _bound(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def log_uniform_id(u: Column, max_id, min_id=0) -> Column:
    """Id in [min_id, max_id) for a uniform number: inverse of the log-uniform distribution.

    The cumulative probability up to offset ``j`` is ``ln(j + 2) / ln(n + 1)``.
    """
    n = _bound(max_id) - _bound(min_id)
    offset = F.floor(F.exp(u * F.ln(n + F.lit(1.0)))) - 1
    return (_bound(min_id) + F.least(F.greatest(offset, F.lit(0)), n - 1)).cast("bigint")


def log_uniform_probs(ids: DataFrame, max_id, min_id=0, n_samples: int = 1, item: str = "item_id") -> DataFrame:
    """Probability of each id, and of being drawn at least once in ``n_samples`` draws."""
    j = F.col(item) - _bound(min_id)
    n = _bound(max_id) - _bound(min_id)
    p = F.when(j >= 0, (F.ln(j + F.lit(2.0)) - F.ln(j + F.lit(1.0))) / F.ln(n + F.lit(1.0))).otherwise(0.0)
    return ids.withColumn("probability", p).withColumn(
        "sampled_once", -F.expm1(F.lit(float(n_samples)) * F.log1p(-F.col("probability"))))


def log_uniform_sample(draws: DataFrame, key: str, max_id, n_samples: int, min_id=0, seed: int = 1) -> DataFrame:
    """Distinct negatives from one draw per row of ``draws``; the ``n_samples`` smallest stay.

    Callers pass twice as many draws as samples.
    """
    drawn = draws.select(log_uniform_id(uniform(F.col(key), "negative", seed), max_id, min_id).alias("item_id"))
    return drawn.distinct().orderBy("item_id").limit(n_samples)


def negatives(spark: SparkSession, max_id: int, n_samples: int, min_id: int = 0, seed: int = 1) -> DataFrame:
    """Negatives for one batch: twice ``n_samples`` draws, made distinct."""
    if max_id <= 0 or n_samples <= 0:
        raise ValueError("max_id and n_samples must be positive")
    return log_uniform_sample(spark.range(2 * n_samples), "id", max_id, n_samples, min_id, seed)


@dataclass(frozen=True)
class Feature:
    """One column of a generated table."""

    name: str
    tags: Sequence[str] = field(default_factory=tuple)
    max_int: int | None = None
    low: float = 0.0
    high: float = 1.0
    is_list: bool = False
    max_length: int = 20


# Columns and domains of the sample e-commerce table.
ECOMMERCE = (
    Feature("session_id", ("session_id",), 5000),
    Feature("item_id", ("item_id",), 10000, is_list=True),
    Feature("category", ("item",), 100, is_list=True),
    Feature("item_recency", ("item",), is_list=True),
    Feature("day", ("session",), 11),
    Feature("purchase", ("session", "binary"), 3),
    Feature("price", ("session",)),
)


def _tagged(schema: Sequence[Feature], tag: str) -> list[Feature]:
    return [f for f in schema if tag in f.tags]


def generate_interactions(rows: DataFrame, key: str, schema: Sequence[Feature] = ECOMMERCE,
                          seed: int = 1) -> DataFrame:
    """One synthetic interaction per row of ``rows``; ``spark.range(n)`` gives ``n`` of them.

    Sessions are uniform, items log-normal, session features constant inside a session, and
    an integer item feature is the equal-width class of the item id.
    """
    session, item = _tagged(schema, "session_id")[0], _tagged(schema, "item_id")[0]
    k = F.col(key)
    out = rows.select(
        k.alias("row"), uniform_int(1, session.max_int - 1, k, "session", seed).alias(session.name),
        F.least(F.greatest(F.floor(F.exp(3.0 + normal(k, "item", seed))), F.lit(1)),
                F.lit(item.max_int)).cast("bigint").alias(item.name))
    owner = F.col(session.name)
    for f in _tagged(schema, "session"):
        if "binary" in f.tags:
            value = uniform_int(0, 1, owner, f.name, seed)
        elif f.max_int:
            value = uniform_int(1, f.max_int - 1, owner, f.name, seed)
        else:
            value = f.low + (f.high - f.low) * uniform(owner, f.name, seed)
        out = out.withColumn(f.name, value)
    spread = out.agg(F.struct(F.min(item.name).alias("low"), F.max(item.name).alias("high"))).scalar()
    out = out.withColumn("_items", spread)
    for f in _tagged(schema, "item"):
        if f.max_int:
            # Equal-width classes, closed on the right, as many as max_int - 1.
            share = (F.col(item.name) - F.col("_items.low")) / F.greatest(
                F.col("_items.high") - F.col("_items.low"), F.lit(1))
            value = F.greatest(F.ceil(share * (f.max_int - 1)), F.lit(1)).cast("bigint")
        else:
            value = f.low + (f.high - f.low) * uniform(F.col("row"), f.name, seed)
        out = out.withColumn(f.name, value)
    return out.drop("_items")


def generate_sessions(rows: DataFrame, key: str, schema: Sequence[Feature] = ECOMMERCE, seed: int = 1,
                      maximum_length: int = 20, minimum_length: int = 2) -> DataFrame:
    """Synthetic interactions packed into session rows."""
    flat = generate_interactions(rows, key, schema, seed)
    session, item = _tagged(schema, "session_id")[0], _tagged(schema, "item_id")[0]
    lists = [item.name, *[f.name for f in _tagged(schema, "item")]]
    return aggregate_sessions(flat, session.name, lists, [f.name for f in _tagged(schema, "session")],
                              ("row",), maximum_length, minimum_length)


def _drawn(f: Feature, row: Column, seed: int):
    def value(i):
        return (uniform_int(1, f.max_int - 1, row, i, f.name, seed) if f.max_int
                else uniform(row, i, f.name, seed))
    return value


def random_from_schema(rows: DataFrame, key: str, schema: Sequence[Feature] = ECOMMERCE,
                       min_length: int = 5, max_length: int | None = None, seed: int = 0) -> DataFrame:
    """Random row per row of ``rows``: integers in [1, max), floats in [0, 1), lists of one
    common random length (or of the feature's own maximum without ``max_length``)."""
    k = F.col(key)
    length = uniform_int(min_length, max_length, k, "length", seed) if max_length else None
    out = rows.select(k.alias("row"))
    row = F.col("row")
    if length is not None:
        out = rows.select(k.alias("row"), length.cast("int").alias("_length"))
    for f in schema:
        value = _drawn(f, row, seed)
        if f.is_list:
            n = F.col("_length") if length is not None else F.lit(f.max_length)
            out = out.withColumn(f.name, F.transform(F.sequence(F.lit(1), n), value))
        else:
            out = out.withColumn(f.name, value(F.lit(0)))
    return out.drop("_length")
