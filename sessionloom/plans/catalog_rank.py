"""Queries on predictions: ranking, metrics, retrieval, live output."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sessionloom.functions import messages as M
from sessionloom.operators import features, lookups, ranking, retrieval
from sessionloom.operators.scale import materialize
from sessionloom.plans import views as V
from sessionloom.plans.registry import query
from sessionloom.plans.sqltext import ITEMS, LIVE_RESULT, MERGED, with_
from sessionloom.streaming.live import LiveTable, live_filter, live_history, live_predict

# --- lookups of item codes ------------------------------------------------------------


@query("encode_items", with_(MERGED, """
SELECT session, seq, coalesce(v.item_id, -1) AS item FROM merged m LEFT JOIN (
  SELECT item, row_number() OVER (ORDER BY count(*) DESC, item) AS item_id FROM merged GROUP BY item) v
ON v.item = CASE WHEN m.item = 'Tool: T0' THEN 'Tool: New' ELSE m.item END"""))
def _(spark, sf):
    rows = materialize(V.merged_log(spark, sf)).withColumnRenamed("message_content", "item")
    known = rows.withColumnRenamed("item", "message_content")
    words = features.build_vocabulary(known, known.withColumn("cat", F.lit("Tool")))
    # One item gets a name that the vocabulary does not have.
    rows = rows.withColumn("item", F.when(F.col("item") == "Tool: T0", "Tool: New").otherwise(F.col("item")))
    return lookups.encode_items(rows, words, "item", -1).select("session", "seq", "item")


def _codes(spark, sf):
    """Part keys coded by frequency, and part names as vocabulary, five ids higher, so that some are unknown."""
    codes = features.categorify_table(V.basket0(spark, sf), "item")
    names = V.table(spark, sf, "part").select(
        (F.col("p_partkey") + 5).alias("item_id"), F.concat(F.lit("End Event: "), F.col("p_name")).alias("item"))
    return codes, names


_CODES = """codes AS (SELECT l_partkey AS value, row_number() OVER (ORDER BY count(*) DESC, l_partkey) + 2 AS code FROM lineitem GROUP BY 1)"""


@query("decode_items", f"""WITH {_CODES}
SELECT o_orderkey, coalesce(p_name, 'Unknown') AS name FROM orders
LEFT JOIN codes ON code = o_custkey LEFT JOIN part ON p_partkey + 5 = value""")
def _(spark, sf):
    codes, names = _codes(spark, sf)
    rows = V.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("code"))
    return lookups.decode_items(rows, codes, names).select("o_orderkey", "name")


@query("decode_lists", """
SELECT l_orderkey AS session, string_agg(coalesce(p_name, 'not found(' || l_partkey || ')'), ';'
  ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS names
FROM lineitem LEFT JOIN part ON p_partkey + 5 = l_partkey GROUP BY 1""")
def _(spark, sf):
    names = V.table(spark, sf, "part").select((F.col("p_partkey") + 5).alias("id"), F.col("p_name").alias("name"))
    rows = lookups.decode_lists(V.sequences(spark, sf), names, "items")
    return rows.select("session", F.array_join("names", ";").alias("names"))


# --- ranking and metrics --------------------------------------------------------------

_PREDS = """preds AS (SELECT l_orderkey AS session, l_partkey AS item, max(l_extendedprice * (1 - l_discount)) AS score,
  max(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS relevant FROM lineitem GROUP BY 1, 2),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY session ORDER BY score DESC, item) AS INT) AS rank,
  sum(relevant) OVER (PARTITION BY session) AS total FROM preds),
top AS (SELECT *, sum(relevant) OVER (PARTITION BY session ORDER BY rank) AS hits,
  row_number() OVER (PARTITION BY session ORDER BY relevant DESC, rank) AS ideal FROM ranked WHERE rank <= 10)"""


def _metric_sql(name: str, k: int) -> str:
    inside = f"rank <= {k}"
    dcg = f"sum(CASE WHEN {inside} THEN relevant / log2(rank + 1) ELSE 0 END)"
    return {
        "precision": f"sum(CASE WHEN {inside} THEN relevant ELSE 0 END) / {k}.0",
        "recall": f"CASE WHEN max(total) > 0 THEN sum(CASE WHEN {inside} THEN relevant ELSE 0 END) / max(total) ELSE 0 END",
        "map": f"sum(CASE WHEN {inside} THEN hits / rank * relevant ELSE 0 END) / least(greatest(max(total), 1), {k})",
        "dcg": dcg,
        "ndcg": f"CASE WHEN max(relevant) > 0 THEN {dcg} / sum(CASE WHEN ideal <= {k} THEN relevant / log2(ideal + 1) ELSE 0 END) ELSE 0 END",
        "mrr": f"max(CASE WHEN {inside} THEN relevant / rank ELSE 0 END)",
    }[name]


def _metric_query(name: str):
    ks = (3, 5, 10)
    columns = ", ".join(f"round({_metric_sql(name, k)}, 9) AS {name}_{k}" for k in ks)

    @query(name, f"WITH {_PREDS} SELECT session, {columns} FROM top GROUP BY session")
    def run(spark, sf):
        out = ranking.session_metrics(V.preds0(spark, sf), ks, [name])
        return out.select("session", *[F.round(f"{name}_{k}", 9).alias(f"{name}_{k}") for k in ks])


@query("topk", f"WITH {_PREDS} SELECT session, item, round(score, 6) AS score, rank FROM ranked WHERE rank <= 3")
def _(spark, sf):
    return ranking.topk(V.preds0(spark, sf), 3).select("session", "item", F.round("score", 6).alias("score"), "rank")


for _name in ranking.METRICS:
    _metric_query(_name)

_ALL = [(n, k) for n in ranking.METRICS for k in (3, 5, 10)]


@query("evaluate", f"""WITH {_PREDS}, per AS (SELECT session, {', '.join(f'{_metric_sql(n, k)} AS {n}_{k}' for n, k in _ALL)} FROM top GROUP BY session)
SELECT {', '.join(f'round(avg({n}_{k}), 9) AS {n}_{k}' for n, k in _ALL)} FROM per""")
def _(spark, sf):
    out = ranking.evaluate(V.preds0(spark, sf))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query("rank_display", f"WITH {_PREDS} SELECT session, item, rank FROM ranked")
def _(spark, sf):
    return ranking.rank_display(V.preds0(spark, sf)).select("session", "item", "rank")


@query("log_predictions", f"""WITH {_PREDS}
SELECT session, string_agg(item, ',' ORDER BY rank) FILTER (WHERE rank <= 5) AS items,
  min(item) FILTER (WHERE relevant > 0) AS label, round({_metric_sql('recall', 5)}, 9) AS recall_5,
  'eval' AS dataset_type FROM ranked GROUP BY session""")
def _(spark, sf):
    out = ranking.log_predictions(V.preds0(spark, sf), 5, "eval")
    return out.select("session", F.array_join("pred_items", ",").alias("items"), "label",
                      F.round("recall_5", 9).alias("recall_5"), "dataset_type")


@query("binary_metrics", """
WITH p AS (SELECT l_discount * 10 > 0.5 AS guess, l_returnflag = 'N' AS truth FROM lineitem)
SELECT round(count(*) FILTER (WHERE guess AND truth) / count(*) FILTER (WHERE guess), 9) AS "precision",
  round(count(*) FILTER (WHERE guess AND truth) / count(*) FILTER (WHERE truth), 9) AS recall,
  round(count(*) FILTER (WHERE guess = truth) / count(*), 9) AS accuracy FROM p""")
def _(spark, sf):
    rows = V.table(spark, sf, "lineitem").select(
        F.least(F.col("l_discount") * 10, F.lit(1.0)).alias("p"), F.when(F.col("l_returnflag") == "N", 1).otherwise(0).alias("y"))
    out = ranking.binary_metrics(rows, "p", "y")
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query("mse", "SELECT round(avg(pow(l_extendedprice / 1000 - l_quantity, 2)), 6) AS mse FROM lineitem")
def _(spark, sf):
    rows = V.table(spark, sf, "lineitem").select((F.col("l_extendedprice") / 1000).alias("p"), F.col("l_quantity").alias("y"))
    return ranking.mse(rows, "p", "y").select(F.round("mse", 6).alias("mse"))


# --- retrieval ------------------------------------------------------------------------

_SCORES = """scores AS (SELECT a.vec_id AS session, b.vec_id AS item,
  list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / 0.5 AS score FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
best AS (SELECT *, CAST(row_number() OVER (PARTITION BY session ORDER BY score DESC, item) AS INT) AS rank FROM scores)"""


@query("score_by_vectors", f"WITH {_SCORES} SELECT session, item, round(score, 9) AS score, rank FROM best WHERE rank <= 5")
def _(spark, sf):
    rows = V.table(spark, sf, "embeddings")
    out = retrieval.score_by_vectors(
        rows.select(F.col("vec_id").alias("session"), F.col("embedding").alias("vector")),
        rows.select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector")), 5, temperature=0.5, skip_self=True)
    return out.withColumn("score", F.round("score", 9))


@query("retrieve_docs", f"""WITH {_SCORES}
SELECT session AS query, string_agg(item, ',' ORDER BY rank) AS docs,
  string_agg('label ' || e.label, chr(10) ORDER BY rank) AS context
FROM best JOIN embeddings e ON e.vec_id = item WHERE rank <= 3 GROUP BY session""")
def _(spark, sf):
    rows = V.table(spark, sf, "embeddings")
    docs = rows.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"),
                       F.concat(F.lit("label "), F.col("label").cast("string")).alias("text"))
    queries = rows.select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    out = retrieval.retrieve_docs(queries, docs, 3, skip_self=True)
    return out.select("query", F.array_join("docs", ",").alias("docs"), "context")


@query("pack_batches", """WITH RECURSIVE numbered AS (
  SELECT doc_id, n_chars // 4 AS t, row_number() OVER (ORDER BY doc_id) AS n FROM documents),
walk AS (
  SELECT n, t AS filled, CAST(1 AS BIGINT) AS batch FROM numbered WHERE n = 1
  UNION ALL
  SELECT d.n, CASE WHEN w.filled + d.t > 5000 THEN d.t ELSE w.filled + d.t END, w.batch + CASE WHEN w.filled + d.t > 5000 THEN 1 ELSE 0 END
  FROM walk w JOIN numbered d ON d.n = w.n + 1)
SELECT doc_id, batch FROM walk JOIN numbered USING (n)""")
def _(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", F.floor(F.col("n_chars") / 4).alias("tokens"))
    return retrieval.pack_batches(docs, 5000).select("doc_id", "batch")


def _next_line(batch):
    """A toy model: the item after the last one of the list scores best, among ten items."""
    last = np.array([v[-1] if len(v) else 0 for v in batch["lines"]])
    return -np.abs(np.arange(10)[None, :] - (last[:, None] + 1)).astype(float)


@query("predict", """
WITH ends AS (SELECT l_orderkey AS session, max(l_linenumber) AS last FROM lineitem GROUP BY 1),
scores AS (SELECT session, i AS item, CAST(-abs(i - (last + 1)) AS DOUBLE) AS score FROM ends, (SELECT unnest(range(10)) AS i) s)
SELECT session, item, score, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY session ORDER BY score DESC, item) AS rank FROM scores) x WHERE rank <= 5""")
def _(spark, sf):
    return retrieval.predict(V.sequences(spark, sf), _next_line, 5, values="lines", top_k=10)


def _describe(command: str, context: str):
    kind, name = command.split(": ", 1)
    if name == "T0":
        raise ValueError("no answer")
    return f"{name} is a {kind}", kind, str(len(context))


@query("augment_commands", with_(ITEMS, """
SELECT item AS message_content, CASE WHEN item <> 'Tool: T0' THEN split_part(item, ': ', 2) || ' is a ' || split_part(item, ': ', 1) END AS summary,
  CASE WHEN item <> 'Tool: T0' THEN split_part(item, ': ', 1) END AS classification,
  CASE WHEN item <> 'Tool: T0' THEN length(min(message))::VARCHAR END AS target,
  CASE WHEN item = 'Tool: T0' THEN 'ValueError: no answer' END AS error FROM items GROUP BY item"""))
def _(spark, sf):
    commands = V.items(spark, sf).select(F.col("item").alias("message_content"), F.col("message").alias("context"))
    return retrieval.augment_commands(commands, _describe)


# --- live path ------------------------------------------------------------------------


def _live_inputs(spark, sf):
    # Every step writes a part of the log and looks up in the side tables: all of them are computed once.
    raw = materialize(V.log0(spark, sf, spread=True))
    log = raw.withColumn("ts", F.date_format("ts", "MM/dd/yyyy HH:mm:ss '0.'SSSSSS '+0000'"))
    kept = materialize(V.modeling_log(spark, sf, raw))
    item = kept.withColumn("item", M.strip_command_ids("message"))
    info = V.side0(item).select("message_content", "classification", "target")
    words = item.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    vocabulary = words.select("item", F.length("item").cast("bigint").alias("item_id"))
    return log, *(materialize(side) for side in (V.dict0(kept), V.pairs0(spark), vocabulary, info))


@query("live_filter", with_(LIVE_RESULT, "SELECT * FROM live_result"))
def _(spark, sf):
    return live_filter(*_live_inputs(spark, sf), patterns=V.PATTERNS).select(
        "session", "timestamp", "seq", "cat", "item_id", "merge_count", "timestamp_interval", "classification", "target")


@query("live_table", with_(LIVE_RESULT, "SELECT session, timestamp, seq, cat, item_id, merge_count FROM live_result"))
def _(spark, sf):
    """The log in three micro-batches through the live table on disk; sessions run through all of them."""
    log, dictionary, pairs, vocabulary, info = _live_inputs(spark, sf)
    path = V.scratch(spark)
    rows = log.select("ts", "session", "cat", "message", "seq")
    live = LiveTable(spark, f"{path}/out", lambda rows: live_filter(
        rows, dictionary, pairs, vocabulary, info, V.PATTERNS), fanout=2)
    for part in range(3):
        rows.filter(F.col("seq") % 3 == part).write.mode("append").json(f"{path}/in")
        live.watch(f"{path}/in", f"{path}/state").awaitTermination()
    return live.current().select("session", "timestamp", "seq", "cat", "item_id", "merge_count")


@query("live_tail", with_(LIVE_RESULT, "SELECT session, timestamp, seq, cat, item_id, merge_count FROM live_result"))
def _(spark, sf):
    """The log as files that are followed by their bytes, in three steps; sessions run through all of them."""
    log, dictionary, pairs, vocabulary, info = _live_inputs(spark, sf)
    path = V.scratch(spark)
    live = LiveTable(spark, f"{path}/out", lambda rows: live_filter(rows, dictionary, pairs, vocabulary, info, V.PATTERNS))
    for part in range(3):
        log.filter(F.col("seq") % 3 == part).select("ts", "session", "cat", "message", "seq").write.mode("append").json(f"{path}/in")
        live.sync(f"{path}/in")
    return live.current().select("session", "timestamp", "seq", "cat", "item_id", "merge_count")


@query("live_state", with_(LIVE_RESULT, "SELECT session, timestamp, seq, cat, item_id, merge_count FROM live_result"))
def _(spark, sf):
    """The log in two steps, with the rows of the sessions in the state store."""
    log, dictionary, pairs, vocabulary, info = _live_inputs(spark, sf)
    path = V.scratch(spark)
    live = LiveTable(spark, f"{path}/out", lambda rows: live_filter(rows, dictionary, pairs, vocabulary, info, V.PATTERNS))
    for part in range(2):
        log.filter(F.col("seq") % 2 == part).select("ts", "session", "cat", "message", "seq").write.mode("append").json(f"{path}/in")
        live.sync(f"{path}/in", stateful=True)
    return live.current().select("session", "timestamp", "seq", "cat", "item_id", "merge_count")


@query("live_history", """
SELECT l_orderkey AS session, row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS position, l_partkey AS item FROM lineitem""")
def _(spark, sf):
    return live_history(V.basket0(spark, sf), item="item", order=V.BASKET_ORDER)


@query("live_predict", f"""WITH {_PREDS}, sizes AS (SELECT l_orderkey AS session, count(*) AS n FROM lineitem GROUP BY 1)
SELECT session, rank, item::VARCHAR AS item FROM ranked JOIN sizes USING (session) WHERE n > 5 AND rank <= 5
UNION ALL SELECT session, 1, 'No enough data for inference!' FROM sizes WHERE n <= 5""")
def _(spark, sf):
    out = live_predict(V.basket0(spark, sf), V.preds0(spark, sf))
    return out.select("session", "rank", "item")
