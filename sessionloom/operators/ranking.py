"""Top-k ranking and ranking metrics on prediction tables (session, item, score, relevant)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.operators.ordered import sessionwise


def topk(scores: DataFrame, k: int, session: str = "session", item: str = "item",
         score: str = "score") -> DataFrame:
    """The ``k`` best rows of each session with their rank; equal scores go by item.

    Spark cuts to ``k`` rows per session and task before the shuffle, so a session with a
    huge candidate list sends few rows.
    """
    order = Window.partitionBy(session).orderBy(F.desc(score), F.asc(item))
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def rank_display(predictions: DataFrame, session: str = "session", item: str = "item",
                 score: str = "score") -> DataFrame:
    """All predictions in shown order, 1-based."""
    ordered = predictions.withColumn("_falling", -F.col(score))
    return sessionwise(ordered, lambda t: t.numbered("rank"), session, ("_falling", item)).withColumn(
        "rank", F.col("rank").cast("int")).drop("_falling")


def _hits(k: int) -> Column:
    return F.sum(F.when(F.col("rank") <= k, F.col("relevant")).otherwise(0.0))


def _precision(k: int) -> Column:
    return _hits(k) / k


def _recall(k: int) -> Column:
    total = F.first("_total")
    return F.when(total > 0, _hits(k) / total).otherwise(0.0)


def _average_precision(k: int) -> Column:
    gain = F.col("_running") / F.col("rank") * F.col("relevant")
    return F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)) / F.least(
        F.greatest(F.first("_total"), F.lit(1.0)), F.lit(float(k)))


def _dcg(k: int) -> Column:
    return F.sum(F.when(F.col("rank") <= k, F.col("relevant") / F.log2(F.col("rank") + 1)).otherwise(0.0))


def _ndcg(k: int) -> Column:
    ideal = F.sum(F.when(F.col("_ideal") <= k, F.col("relevant") / F.log2(F.col("_ideal") + 1)).otherwise(0.0))
    return F.when(ideal > 0, _dcg(k) / ideal).otherwise(0.0)


def _mrr(k: int) -> Column:
    return F.max(F.when(F.col("rank") <= k, F.col("relevant") / F.col("rank")).otherwise(0.0))


METRICS: dict[str, Callable[[int], Column]] = {
    "precision": _precision, "recall": _recall, "map": _average_precision,
    "dcg": _dcg, "ndcg": _ndcg, "mrr": _mrr,
}
# Other names of the metrics.
METRIC_NAMES = {"precision_at": "precision", "recall_at": "recall", "avg_precision_at": "map",
                "avg_precision": "map", "dcg_at": "dcg", "ndcg_at": "ndcg", "mrr_at": "mrr"}


def session_metrics(predictions: DataFrame, ks: Sequence[int] = (3, 5, 10),
                    names: Sequence[str] = tuple(METRICS), session: str = "session",
                    item: str = "item", score: str = "score", relevant: str = "relevant") -> DataFrame:
    """Metrics ``<name>_<k>`` per session.

    The ideal order behind ndcg is taken from the retrieved top ``max(ks)`` only.  Windows
    run over at most ``max(ks)`` rows of a session, all on one partitioning.
    """
    if not ks or min(ks) < 1:
        raise ValueError("cut-offs must be positive")
    missing = {session, item, score, relevant} - set(predictions.columns)
    if missing:
        raise ValueError(f"predictions lack columns: {sorted(missing)}")
    names = [METRIC_NAMES.get(n, n) for n in names]
    table = predictions.select(F.col(session).alias("session"), F.col(item).alias("item"),
                               F.col(score).alias("score"), F.col(relevant).cast("double").alias("relevant"))
    totals = table.groupBy("session").agg(F.sum("relevant").alias("_total"))
    best = topk(table, max(ks))
    by_rank = Window.partitionBy("session").orderBy("rank")
    if "map" in names:
        best = best.withColumn("_running", F.sum("relevant").over(by_rank))
    if "ndcg" in names:
        best = best.withColumn("_ideal", F.row_number().over(
            Window.partitionBy("session").orderBy(F.desc("relevant"), "rank")))
    return (best.join(totals, "session").groupBy("session")
            .agg(*[METRICS[n](k).alias(f"{n}_{k}") for n in names for k in ks])
            .withColumnRenamed("session", session))


def evaluate(predictions: DataFrame, ks: Sequence[int] = (3, 5, 10),
             names: Sequence[str] = tuple(METRICS), **columns: str) -> DataFrame:
    """Mean of every metric over all sessions, as one row."""
    per = session_metrics(predictions, ks, names, **columns)
    keys = [f"{METRIC_NAMES.get(n, n)}_{k}" for n in names for k in ks]
    return per.agg(*[F.avg(c).alias(c) for c in keys])


def log_predictions(predictions: DataFrame, k: int, dataset_type: str, ks: Sequence[int] = (3, 5, 10),
                    session: str = "session") -> DataFrame:
    """One row per session: label, top items and scores, metrics and the kind of dataset."""
    top = topk(predictions, k).groupBy(session).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]).alias("pred_items"),
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("pred_scores"))
    label = predictions.groupBy(session).agg(
        F.min(F.when(F.col("relevant") > 0, F.col("item"))).alias("label"))
    return (top.join(label, session).join(session_metrics(predictions, ks, session=session), session)
            .withColumn("dataset_type", F.lit(dataset_type)))


def binary_metrics(df: DataFrame, prediction: str, target: str) -> DataFrame:
    """Precision, recall and accuracy after rounding half to even (0.5 becomes 0)."""
    guess, truth = F.bround(F.col(prediction), 0) == 1, F.col(target) == 1

    def n(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    both = n(guess & truth)
    return df.agg(
        F.when(n(guess) > 0, both / n(guess)).otherwise(0.0).alias("precision"),
        F.when(n(truth) > 0, both / n(truth)).otherwise(0.0).alias("recall"),
        (n(guess == truth) / F.count(F.lit(1))).alias("accuracy"))


def mse(df: DataFrame, prediction: str, target: str) -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(prediction) - F.col(target), 2)).alias("mse"))
