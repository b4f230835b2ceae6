"""Queries on training data: features, targets, splits, sampling, dictionary building."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.functions import vectors
from sessionloom.operators import dictionary, features, filters, lookups, masking, sampling, sessions, splits, stats
from sessionloom.plans import views as V
from sessionloom.plans.registry import query
from sessionloom.plans.sqltext import MERGED, hashed, uniform, with_
from sessionloom.sources import readers, writers

_ROWS = """rows0 AS (
  SELECT l_orderkey AS session, l_partkey AS item, l_linenumber, l_quantity, l_returnflag, l_linestatus,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos,
    count(*) OVER (PARTITION BY l_orderkey) AS n
  FROM lineitem)"""

# --- encoding and session rows --------------------------------------------------------


@query("categorify_table", """
SELECT l_partkey AS value, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, l_partkey) + 2 AS code
FROM lineitem GROUP BY l_partkey""")
def _(spark, sf):
    return features.categorify_table(V.basket0(spark, sf), "item").withColumnRenamed("item", "value")


@query("categorify", """
SELECT o_orderkey, code FROM orders JOIN (
  SELECT o_orderpriority, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) + 2 AS code
  FROM orders GROUP BY 1) c USING (o_orderpriority)""")
def _(spark, sf):
    return features.categorify(V.cust0(spark, sf), "item", out="code").select("o_orderkey", "code")


@query("normalize", """
SELECT l_orderkey, l_linenumber, l_partkey,
  round((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem), 6) AS quantity_norm,
  round((l_discount - (SELECT avg(l_discount) FROM lineitem)) / (SELECT stddev_pop(l_discount) FROM lineitem), 6) AS discount_norm
FROM lineitem""")
def _(spark, sf):
    out = features.normalize(V.table(spark, sf, "lineitem"), {"l_quantity": "quantity_norm", "l_discount": "discount_norm"})
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("quantity_norm", 6).alias("quantity_norm"),
                      F.round("discount_norm", 6).alias("discount_norm"))


@query("prepare_interactions", with_(MERGED, """
SELECT session AS session_id, item AS item_id, ts AS timestamp, merge_count, cat,
  ts - coalesce(lag(ts) OVER (PARTITION BY session ORDER BY ts, seq), ts) AS timestamp_interval, seq FROM merged"""))
def _(spark, sf):
    return features.prepare_interactions(V.merged_log(spark, sf), session="session", source=V.log0(spark, sf))


@query("groupby_lists", f"""WITH {_ROWS}
SELECT session, string_agg(item, ',' ORDER BY pos) AS items, count(*) AS item_count,
  min_by(l_returnflag, pos) AS first_flag FROM rows0 GROUP BY session""")
def _(spark, sf):
    out = sessions.groupby_lists(V.basket0(spark, sf), order=V.BASKET_ORDER, lists=["item"],
                                 firsts=["l_returnflag"], counts=["item"])
    return out.select("session", F.array_join("item-list", ",").alias("items"), F.col("item-count").alias("item_count"),
                      F.col("l_returnflag-first").alias("first_flag"))


@query("session_features", f"""WITH {_ROWS},
item_codes AS (SELECT item, row_number() OVER (ORDER BY count(*) DESC, item) + 2 AS code FROM rows0 GROUP BY item),
flag_codes AS (SELECT l_returnflag, row_number() OVER (ORDER BY count(*) DESC, l_returnflag) + 2 AS code FROM rows0 GROUP BY 1),
facts AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM rows0)
SELECT session, n AS item_count, CAST(pos AS INT) AS pos, i.code AS item, f.code AS flag, l_quantity AS quantity,
  round((l_quantity - m) / s, 6) AS quantity_norm
FROM rows0 JOIN item_codes i USING (item) JOIN flag_codes f USING (l_returnflag), facts WHERE n > 5""")
def _(spark, sf):
    out = features.session_features(
        V.basket0(spark, sf), "session", V.BASKET_ORDER, ("item", "l_returnflag"),
        {"l_quantity": "quantity_norm"}, ("l_quantity",))
    counts = out.select("session", F.col("item-count").alias("item_count"))
    rows = V.exploded(out, "session", "item-list", "l_returnflag-list", "l_quantity-list", "quantity_norm-list")
    return rows.toDF("session", "pos", "item", "flag", "quantity", "quantity_norm").withColumn(
        "quantity_norm", F.round("quantity_norm", 6)).join(counts, "session")


@query("list_tail", f"""WITH {_ROWS}
SELECT session, string_agg(item, ',' ORDER BY pos) AS tail FROM rows0 WHERE pos >= n - 3 GROUP BY session""")
def _(spark, sf):
    return V.sequences(spark, sf).select("session", F.array_join(sessions.list_tail("items", 3), ",").alias("tail"))


@query("min_length_sessions", f"""WITH {_ROWS} SELECT DISTINCT session, n FROM rows0 WHERE n > 5""")
def _(spark, sf):
    counts = V.basket0(spark, sf).groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    return filters.min_length_sessions(counts, "n")


@query("aggregate_sessions", f"""WITH {_ROWS}
SELECT session, string_agg(item, ',' ORDER BY pos) FILTER (WHERE pos < 4) AS items, min_by(l_returnflag, pos) AS first_flag
FROM rows0 GROUP BY session HAVING count(*) >= 2""")
def _(spark, sf):
    out = sessions.aggregate_sessions(V.basket0(spark, sf), "session", ["item"], ["l_returnflag"], V.BASKET_ORDER, 4, 2)
    return out.select("session", F.array_join("item-list_trim", ",").alias("items"),
                      F.col("l_returnflag-first").alias("first_flag"))


@query("class_weights", """
WITH sizes AS (SELECT row_number() OVER (ORDER BY count(*) DESC, l_partkey) + 2 AS code, count(*) AS size FROM lineitem GROUP BY l_partkey),
raw AS (SELECT code, (SELECT sum(size) FROM sizes) / (((SELECT count(*) FROM sizes) + 3) * size) AS w FROM sizes)
SELECT code, round(w / (SELECT sum(w) FROM raw), 12) AS weight FROM raw
UNION ALL SELECT * FROM (VALUES (0, 1e-8), (1, 1e-8), (2, 1e-8)) v""")
def _(spark, sf):
    return stats.class_weights(features.categorify_table(V.basket0(spark, sf), "item")).withColumn("weight", F.round("weight", 12))


# --- targets --------------------------------------------------------------------------


@query("next_item_targets", f"""WITH {_ROWS}
SELECT session, CAST(pos AS INT) AS pos, coalesce(lead(item) OVER (PARTITION BY session ORDER BY pos), 0) AS label,
  pos < n - 1 AS has_label FROM rows0""")
def _(spark, sf):
    rows = V.sequences(spark, sf).withColumn("label", masking.next_item_targets("items"))
    # Part 0 exists in the data and reads as padding; the flag is taken from the line list.
    rows = rows.withColumn("has_label", masking.label_mask(masking.next_item_targets("lines")))
    return V.exploded(rows, "session", "label", "has_label")


@query("last_item_target", f"""WITH {_ROWS}
SELECT session, CAST(pos AS INT) AS pos, CASE WHEN pos = n - 2 THEN lead(l_linenumber) OVER w ELSE 0 END::BIGINT AS label,
  CASE WHEN pos = n - 2 THEN lead(item) OVER w ELSE 0 END AS side
FROM rows0 WINDOW w AS (PARTITION BY session ORDER BY pos)""")
def _(spark, sf):
    rows = V.sequences(spark, sf).withColumns({
        "label": masking.last_item_target("lines"), "side": masking.last_item_target("items", "lines")})
    return V.exploded(rows, "session", "label", "side")


_MLM = _ROWS + f""",
drawn AS (SELECT *, {uniform("session", "pos", "1")} < 0.15 OR pos = {hashed("session", "'force'", "1")} % n AS m FROM rows0),
placed AS (SELECT *, count(*) FILTER (WHERE m) OVER (PARTITION BY session) AS masked FROM drawn)"""


@query("mlm_targets", f"""WITH {_MLM}
SELECT session, CAST(pos AS INT) AS pos, CASE WHEN m AND NOT (masked = n AND pos = {hashed("session", "'show'", "1")} % n)
  THEN l_linenumber ELSE 0 END::BIGINT AS label FROM placed""")
def _(spark, sf):
    rows = masking.mlm_targets(V.sequences(spark, sf), "session", "lines").withColumnRenamed("labels", "label")
    return V.exploded(rows, "session", "label")


@query("mlm_targets_eval", f"""WITH {_ROWS}
SELECT session, CAST(pos AS INT) AS pos, CASE WHEN pos = n - 1 THEN l_linenumber ELSE 0 END::BIGINT AS label FROM rows0""")
def _(spark, sf):
    rows = masking.mlm_targets(V.sequences(spark, sf), "session", "lines", mode="eval", out="label")
    return V.exploded(rows, "session", "label")


@query("mlm_targets_inference", f"""WITH {_ROWS}
SELECT session, CAST(pos AS INT) AS pos, CAST(0 AS BIGINT) AS label FROM rows0
UNION ALL SELECT session, CAST(n AS INT), l_linenumber::BIGINT FROM rows0 WHERE pos = n - 1""")
def _(spark, sf):
    rows = masking.mlm_targets(V.sequences(spark, sf), "session", "lines", mode="inference", out="label")
    return V.exploded(rows, "session", "label")


@query("span_targets", f"""WITH {_ROWS},
sizes AS (SELECT DISTINCT session, n FROM rows0),
steps AS (SELECT session, n, k, 1 + {hashed("session", "k", "'span'", "1")} % 5 AS span
  FROM (SELECT session, n, unnest(range(1, CAST(ceil(n / 6.0) AS BIGINT) + 2)) AS k FROM sizes) s),
placed AS (SELECT *, coalesce(sum(6 * span) OVER (PARTITION BY session ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
  {hashed("session", "k", "'place'", "1")} % (5 * span + 1) AS shift FROM steps),
spans AS (SELECT session, start + shift AS lo, start + shift + span AS hi FROM placed WHERE start < n),
hit AS (SELECT *, EXISTS (SELECT 1 FROM spans s WHERE s.session = rows0.session AND pos >= lo AND pos < hi) AS h FROM rows0),
forced AS (SELECT *, h OR (count(*) FILTER (WHERE h) OVER (PARTITION BY session) = 0
  AND pos = {hashed("session", "'force'", "1")} % n) AS m FROM hit),
counted AS (SELECT *, count(*) FILTER (WHERE m) OVER (PARTITION BY session) AS masked FROM forced)
SELECT session, CAST(pos AS INT) AS pos, CASE WHEN m AND NOT (masked = n AND pos = {hashed("session", "'show'", "1")} % n)
  THEN l_linenumber ELSE 0 END::BIGINT AS label FROM counted""")
def _(spark, sf):
    rows = masking.span_targets(V.sequences(spark, sf), "session", "lines", out="label")
    return V.exploded(rows, "session", "label")


@query("corrupt_items", f"""WITH {_MLM},
labels AS (SELECT session, pos, l_linenumber AS x, m AND NOT (masked = n AND pos = {hashed("session", "'show'", "1")} % n) AS hit FROM placed),
swapped AS (SELECT session, pos, x, CASE WHEN hit THEN CAST(1 + least(greatest(
  floor(exp({uniform("session", "pos", "'corrupt'", "1")} * ln(7.0))) - 1, 0), 5) AS BIGINT) ELSE x END AS y FROM labels)
SELECT session, CAST(pos AS INT) AS pos, y AS corrupted, y <> x AS is_replaced FROM swapped""")
def _(spark, sf):
    rows = masking.mlm_targets(V.sequences(spark, sf), "session", "lines")
    rows = masking.corrupt_items(rows, "session", "lines", "labels", max_id=7, min_id=1)
    return V.exploded(rows, "session", "corrupted", "is_replaced")


@query("swap_noise", f"""
WITH v AS (SELECT o_orderkey AS key, CAST(substr(o_orderpriority, 1, 1) AS INT) AS value,
  {uniform("o_orderkey", "'swap'", "1")} < 0.1 AS taken, md5(concat_ws('|', o_orderkey, 'order', '1')) AS shuffle FROM orders),
donors AS (SELECT value, row_number() OVER (ORDER BY shuffle, key) AS nth FROM v),
takers AS (SELECT key, row_number() OVER (ORDER BY key) AS nth FROM v WHERE taken)
SELECT v.key, coalesce(d.value, v.value) AS value FROM v LEFT JOIN takers t ON t.key = v.key
LEFT JOIN donors d ON d.nth = t.nth""")
def _(spark, sf):
    rows = V.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("key"), F.substring("o_orderpriority", 1, 1).cast("int").alias("value"))
    return masking.swap_noise(rows, "key", "value")


@query("pad_sequences", f"""WITH {_ROWS}, slots AS (SELECT DISTINCT session, s.p FROM rows0, (SELECT unnest(range(6)) AS p) s)
SELECT slots.session, CAST(p AS INT) AS pos, coalesce(r.item, 0) AS padded
FROM slots LEFT JOIN rows0 r ON r.session = slots.session AND r.pos = slots.p""")
def _(spark, sf):
    rows = V.sequences(spark, sf).withColumn("padded", features.pad_sequences("items", 6))
    return V.exploded(rows, "session", "padded")


@query("pad_to_batch", f"""WITH {_ROWS}, sizes AS (SELECT DISTINCT session, n, session // 64 AS batch FROM rows0),
lens AS (SELECT batch, least(max(n), 8) AS len FROM sizes GROUP BY batch)
SELECT sizes.session, CAST(s.p AS INT) AS pos, coalesce(r.item, 0) AS padded
FROM sizes JOIN lens USING (batch) JOIN (SELECT unnest(range(8)) AS p) s ON s.p < len
LEFT JOIN rows0 r ON r.session = sizes.session AND r.pos = s.p""")
def _(spark, sf):
    rows = V.sequences(spark, sf).withColumn("batch", F.floor(F.col("session") / 64))
    return V.exploded(features.pad_to_batch(rows, "batch", "items", 8), "session", "padded")


@query("ragged_values", f"""WITH {_ROWS}
SELECT row_number() OVER (ORDER BY session, pos) - 1 AS position, item AS value FROM rows0""")
def _(spark, sf):
    return features.to_values_offsets(V.sequences(spark, sf), "session", "items")[0]


@query("ragged_offsets", f"""WITH {_ROWS}, sizes AS (SELECT session, count(*) AS n FROM rows0 GROUP BY session)
SELECT row_number() OVER (ORDER BY session) AS row, CAST(sum(n) OVER (ORDER BY session) AS BIGINT) AS "offset" FROM sizes
UNION ALL SELECT 0, 0""")
def _(spark, sf):
    return features.to_values_offsets(V.sequences(spark, sf), "session", "items")[1]


# --- vectors --------------------------------------------------------------------------


@query("truncate_l2", """
SELECT vec_id, x.d - 1 AS dim, round(v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)), 9) AS value FROM (
  SELECT vec_id, unnest(embedding[1:16]::DOUBLE[]) AS v, generate_subscripts(embedding[1:16], 1) AS d FROM embeddings) x""")
def _(spark, sf):
    cut = V.table(spark, sf, "embeddings").select("vec_id", vectors.truncate_l2("embedding", 16).alias("v"))
    return cut.select("vec_id", F.posexplode("v").alias("dim", "value")).select(
        "vec_id", F.col("dim").cast("bigint").alias("dim"), F.round("value", 9).alias("value"))


_TABLE = """WITH codes AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) + 2 AS code FROM embeddings GROUP BY label),
firsts AS (SELECT label, arg_min(embedding, vec_id) AS e FROM embeddings GROUP BY label),
flat AS (SELECT code, generate_subscripts(e[1:8], 1) - 1 AS dim, unnest(e[1:8]::DOUBLE[]) AS v FROM firsts JOIN codes USING (label)),
vectors AS (SELECT code, dim, v / sqrt(sum(v * v) OVER (PARTITION BY code)) AS v FROM flat
  UNION ALL SELECT c, d, 0.0 FROM (SELECT unnest([0, 1, 2]) AS c) a, (SELECT unnest(range(8)) AS d) b)"""


def _code_vectors(spark, sf):
    rows = V.table(spark, sf, "embeddings").select(F.col("label").alias("item"), "embedding", F.col("vec_id").alias("seq"))
    return features.embedding_table(rows, features.categorify_table(rows, "item"), 8)


@query("embedding_table", _TABLE + " SELECT code, CAST(dim AS INT) AS dim, round(v, 9) AS value FROM vectors")
def _(spark, sf):
    return _code_vectors(spark, sf).select("code", F.posexplode("vector").alias("dim", "value")).withColumn(
        "value", F.round("value", 9))


@query("lookup_embeddings", _TABLE + f""", {_ROWS}
SELECT session, CAST(pos AS INT) AS pos, round(coalesce(sum(v * (dim + 1)), 0), 6) AS checksum
FROM rows0 LEFT JOIN vectors ON code = l_linenumber GROUP BY session, pos""")
def _(spark, sf):
    rows = lookups.lookup_embeddings(V.sequences(spark, sf).select("session", "lines"), _code_vectors(spark, sf), "lines", 8)
    weights = F.array(*[F.lit(float(i + 1)) for i in range(8)])
    return rows.select("session", F.posexplode("vectors").alias("pos", "v")).select(
        "session", "pos", F.round(vectors.dot("v", weights), 6).alias("checksum"))


@query("combine_vectors", """
SELECT label, CAST(d - 1 AS INT) AS dim, round(sum(v), 6) AS total, round(avg(v), 6) AS mean, max(v) AS most, min(v) AS least FROM (
  SELECT label, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS d FROM embeddings) x GROUP BY label, d""")
def _(spark, sf):
    rows = V.table(spark, sf, "embeddings")
    out = None
    for how, name in (("sum", "total"), ("mean", "mean"), ("max", "most"), ("min", "least")):
        part = features.combine_vectors(rows, "label", "embedding", how).select("label", F.posexplode("vector").alias("dim", name))
        out = part if out is None else out.join(part, ["label", "dim"])
    return out.withColumns({"total": F.round("total", 6), "mean": F.round("mean", 6)})


@query("aggregate_features", """
SELECT vec_id, CAST(d AS INT) AS dim, a[d] AS joined_low, b[d] AS joined_high, a[d] AS stacked_low, b[d] AS stacked_high,
  round(a[d] + b[d], 6) AS added, round(a[d] * b[d], 6) AS multiplied
FROM (SELECT vec_id, embedding[1:32]::DOUBLE[] AS a, embedding[33:64]::DOUBLE[] AS b FROM embeddings) x,
  (SELECT unnest(generate_series(1, 32)) AS d) g""")
def _(spark, sf):
    rows = V.table(spark, sf, "embeddings").select(
        "vec_id", F.slice("embedding", 1, 32).cast("array<double>").alias("a"),
        F.slice("embedding", 33, 32).cast("array<double>").alias("b"))
    for how, out in (("concat", "c"), ("stack", "s"), ("element-wise-sum", "e")):
        rows = features.aggregate_features(rows, ["b", "a"], how, out=out)
    rows = features.aggregate_features(rows, ["a", "b"], "element-wise-sum-item-multi", item="a", out="m")
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(32))).alias("dim"))
    at = F.col("dim") - 1
    return rows.select("vec_id", "dim", F.get("c", at).alias("joined_low"), F.get("c", at + 32).alias("joined_high"),
                       F.get(F.col("s")[0], at).alias("stacked_low"), F.get(F.col("s")[1], at).alias("stacked_high"),
                       F.round(F.get("e", at), 6).alias("added"), F.round(F.get("m", at), 6).alias("multiplied"))


@query("one_hot", """
SELECT vec_id, CAST(p AS INT) AS pos, CASE WHEN p = label THEN 1 ELSE 0 END AS hot FROM embeddings, (SELECT unnest(range(10)) AS p) s""")
def _(spark, sf):
    return V.table(spark, sf, "embeddings").select("vec_id", F.posexplode(vectors.one_hot("label", 10)).alias("pos", "hot"))


# --- splits and sampling --------------------------------------------------------------


@query("split_random", f"""
SELECT o_orderkey, CASE WHEN r <= 0.8 THEN 'train' WHEN r <= 0.9 THEN 'valid' WHEN r > 0.9 THEN 'test' END AS split
FROM (SELECT o_orderkey, {uniform("o_orderkey", "1")} AS r FROM orders) x""")
def _(spark, sf):
    return splits.split_random(V.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


_TIMED = f"""timed AS (SELECT o_orderkey, y, CASE WHEN r <= 0.8 THEN 'train' WHEN r <= 0.9 THEN 'valid' ELSE 'test' END AS split
FROM (SELECT o_orderkey, year(o_orderdate)::INT AS y, {uniform("year(o_orderdate)", "o_orderkey", "1")} AS r FROM orders) x)"""


def _by_year(spark, sf):
    rows = V.table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    return splits.split_by_time(rows, "y", "o_orderkey")


@query("split_by_time", f"WITH {_TIMED} SELECT o_orderkey, y, split FROM timed")
def _(spark, sf):
    path = V.scratch(spark)
    writers.write_splits(_by_year(spark, sf), path, "y")
    return spark.read.parquet(path)


@query("walk_forward", f"""WITH {_TIMED}
SELECT "window", role, count(*) AS n FROM (
  SELECT y AS "window", 'train' AS role FROM timed WHERE split = 'train'
  UNION ALL SELECT y - 1, 'valid' FROM timed WHERE split = 'valid') x
WHERE "window" BETWEEN 1994 AND 1996 GROUP BY 1, 2""")
def _(spark, sf):
    steps = splits.walk_forward(_by_year(spark, sf), "y", 1994, 1996, "split")
    return steps.groupBy("window", "role").agg(F.count(F.lit(1)).alias("n"))


@query("split_balanced", f"""
WITH pairs AS (SELECT DISTINCT o_custkey AS session, o_orderpriority || '-' || (o_orderkey // 40) AS item FROM orders),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY {hashed("item", "session", "'pick'", "1")}, session) AS nth,
  count(*) OVER (PARTITION BY item) AS n FROM pairs),
chosen AS (SELECT DISTINCT session, 'train' AS split FROM ranked WHERE nth = 1
  UNION SELECT DISTINCT session, 'val' FROM ranked WHERE nth = 2 OR (nth = 1 AND n = 1)),
rest AS (SELECT session, row_number() OVER (ORDER BY md5(concat_ws('|', session, 'rest', '1')), session) AS nth, count(*) OVER () AS total
  FROM (SELECT DISTINCT session FROM pairs) s WHERE session NOT IN (SELECT session FROM chosen))
SELECT * FROM chosen UNION ALL
SELECT session, CASE WHEN nth <= floor(0.85 * total) THEN 'train' ELSE 'val' END FROM rest
WHERE nth <= floor(0.85 * total) + floor(0.15 * total)""")
def _(spark, sf):
    rows = V.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("session"),
        F.concat("o_orderpriority", F.lit("-"), F.floor(F.col("o_orderkey") / 40).cast("string")).alias("item"))
    return splits.split_balanced(rows, "session", "item")


# Chunk draws by recursion: position, chunk number, rows left.
@query("split_sessions_random", f"""WITH RECURSIVE sizes AS (SELECT o_custkey AS session, count(*) AS n FROM orders GROUP BY 1),
cuts AS (
  SELECT session, n, 1 AS chunk, CAST(0 AS BIGINT) AS start,
    CASE WHEN n <= greatest(6, 5) THEN n ELSE 3 + {hashed("session", "1", "1")} % 4 END AS size FROM sizes WHERE n >= 3
  UNION ALL
  SELECT session, n, chunk + 1, start + size,
    CASE WHEN n - start - size <= greatest(6, 5) THEN n - start - size ELSE 3 + {hashed("session", "chunk + 1", "1")} % 4 END
  FROM cuts WHERE n - start - size >= 3),
numbered AS (SELECT o_orderkey, o_custkey AS session, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS p FROM orders)
SELECT o_orderkey, coalesce(session || '-' || max(chunk), session::VARCHAR) AS session_part FROM (
  SELECT o.o_orderkey, o.session, c.chunk FROM numbered o LEFT JOIN cuts c ON c.session = o.session AND c.start <= o.p) x
GROUP BY o_orderkey, session""")
def _(spark, sf):
    out = sessions.split_random(V.cust0(spark, sf), min_items=3, max_items=6, order=V.CUST_ORDER)
    return out.select("o_orderkey", "session_part")


@query("log_uniform_probs", """
WITH m AS (SELECT max(p_partkey) + 1 AS n FROM part)
SELECT item_id, round(p, 10) AS probability, round(1 - pow(1 - p, 100), 9) AS sampled_once FROM (
  SELECT p_partkey AS item_id, (ln(p_partkey + 2.0) - ln(p_partkey + 1.0)) / ln(n + 1.0) AS p FROM part, m) x""")
def _(spark, sf):
    parts = V.table(spark, sf, "part")
    most = parts.agg(F.max("p_partkey") + 1).scalar()
    out = sampling.log_uniform_probs(parts.select(F.col("p_partkey").alias("item_id")), most, 0, 100)
    return out.select("item_id", F.round("probability", 10).alias("probability"), F.round("sampled_once", 9).alias("sampled_once"))


@query("log_uniform_sample", f"""
SELECT DISTINCT CAST(least(greatest(floor(exp({uniform("o_orderkey", "'negative'", "1")} * ln(n + 1.0))) - 1, 0), n - 1) AS BIGINT) AS item_id
FROM orders, (SELECT max(p_partkey) + 1 AS n FROM part) m ORDER BY item_id LIMIT 100""")
def _(spark, sf):
    most = V.table(spark, sf, "part").agg(F.max("p_partkey") + 1).scalar()
    return sampling.log_uniform_sample(V.table(spark, sf, "orders"), "o_orderkey", most, 100)


# The synthetic rows in SQL: the same hashes, and Box-Muller for the normal number.
_GENERATED = f"""drawn AS (SELECT key AS row, 1 + {hashed("key", "'session'", "1")} % 4999 AS session_id,
  CAST(least(greatest(floor(exp(3.0 + sqrt(-2.0 * ln(({hashed("key", "'item'", "1", "'a'")} + 1) / 4294967297.0))
    * cos(2.0 * pi() * {uniform("key", "'item'", "1", "'b'")}))), 1), 10000) AS BIGINT) AS item_id FROM keys),
generated AS (SELECT row, session_id, item_id, 1 + {hashed("session_id", "'day'", "1")} % 10 AS day,
  {hashed("session_id", "'purchase'", "1")} % 2 AS purchase, round({uniform("session_id", "'price'", "1")}, 9) AS price,
  CAST(greatest(ceil((item_id - lo) / (hi - lo) * 99), 1) AS BIGINT) AS category, round({uniform("row", "'item_recency'", "1")}, 9) AS item_recency
  FROM drawn, (SELECT min(item_id) AS lo, max(item_id) AS hi FROM drawn) b)"""


@query("generate_interactions", f"WITH keys AS (SELECT o_orderkey AS key FROM orders), {_GENERATED} SELECT * FROM generated")
def _(spark, sf):
    out = sampling.generate_interactions(V.table(spark, sf, "orders"), "o_orderkey")
    return out.withColumns({"price": F.round("price", 9), "item_recency": F.round("item_recency", 9)})


@query("generate_sessions", f"""WITH keys AS (SELECT DISTINCT l_orderkey AS key FROM lineitem), {_GENERATED},
placed AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY row) AS p FROM generated)
SELECT session_id, string_agg(item_id, ',' ORDER BY p) AS items, min(day) AS day FROM placed WHERE p <= 20
GROUP BY session_id HAVING count(*) >= 2""")
def _(spark, sf):
    out = sampling.generate_sessions(V.table(spark, sf, "lineitem").select("l_orderkey").distinct(), "l_orderkey")
    return out.select("session_id", F.array_join("item_id-list_trim", ",").alias("items"), F.col("day-first").alias("day"))


@query("random_from_schema", f"""
WITH sized AS (SELECT c_custkey AS row, 5 + {hashed("c_custkey", "'length'", "0")} % 16 AS n FROM customer),
flat AS (SELECT row, n, i, 1 + {hashed("row", "i", "'item_id'", "0")} % 9999 AS item FROM (SELECT row, n, unnest(range(1, n + 1)) AS i FROM sized) s)
SELECT row, CAST(n AS INT) AS length, string_agg(item, ',' ORDER BY i) AS items, round({uniform("row", "0", "'price'", "0")}, 9) AS price
FROM flat GROUP BY row, n""")
def _(spark, sf):
    out = sampling.random_from_schema(V.table(spark, sf, "customer"), "c_custkey", max_length=20)
    return out.select("row", F.size("item_id").alias("length"), F.array_join("item_id", ",").alias("items"), F.round("price", 9).alias("price"))


# --- dictionary -----------------------------------------------------------------------

_WORDS = """words0 AS (SELECT CASE WHEN vec_id % 97 = 0 THEN 'x' || vec_id ELSE label::VARCHAR END AS id,
  printf('m%06d', vec_id) AS message, 'en ' || printf('m%06d', vec_id) AS translated_message,
  CASE WHEN vec_id % 50 = 0 THEN 'en' ELSE 'de' END AS message_language, embedding::DOUBLE[] AS e FROM embeddings)"""
_PAIRS = _WORDS + """,
pairs AS (SELECT a.id, a.message AS a, b.message AS b, list_cosine_similarity(a.e, b.e) AS sim, list_distance(a.e, b.e) AS dist
  FROM words0 a JOIN words0 b ON a.id = b.id AND a.message < b.message)"""
EPS = 1.2


@query("single_member_labels", f"""WITH {_WORDS}
SELECT id, message, translated_message AS label FROM words0 WHERE id IN (SELECT id FROM words0 GROUP BY id HAVING count(*) = 1)""")
def _(spark, sf):
    return dictionary.single_member_labels(V.words0(spark, sf))[0].select("id", "message", "label")


@query("group_similarity", f"""WITH {_PAIRS}
SELECT p.id, w.n AS length, round(avg(sim), 9) AS mean_similarity, round(median(sim), 9) AS median_similarity,
  round(stddev_pop(sim), 9) AS std_dev_similarity
FROM pairs p JOIN (SELECT id, count(*) AS n FROM words0 GROUP BY id) w ON w.id = p.id GROUP BY p.id, w.n""")
def _(spark, sf):
    out = dictionary.group_similarity(V.words0(spark, sf))
    return out.select("id", "length", *[F.round(c, 9).alias(c) for c in (
        "mean_similarity", "median_similarity", "std_dev_similarity")])


@query("centroid_label", f"""WITH {_WORDS},
flat AS (SELECT id, message, unnest(e) AS v, generate_subscripts(e, 1) AS d FROM words0),
mean AS (SELECT id, d, avg(v) AS m FROM flat GROUP BY id, d),
dist AS (SELECT f.id, f.message, sqrt(sum((v - m) * (v - m))) AS far FROM flat f JOIN mean USING (id, d) GROUP BY f.id, f.message)
SELECT w.id, CASE WHEN count(*) FILTER (WHERE message_language = 'en') = 1 THEN min(w.message) FILTER (WHERE message_language = 'en')
  ELSE arg_min(translated_message, (round(far, 12), w.message)) END AS label
FROM words0 w JOIN dist d ON d.id = w.id AND d.message = w.message GROUP BY w.id""")
def _(spark, sf):
    return dictionary.centroid_label(V.words0(spark, sf))


_REACH = _PAIRS + f""",
edges AS (SELECT id, a, b FROM pairs WHERE dist <= {EPS} UNION ALL SELECT id, b, a FROM pairs WHERE dist <= {EPS}),
reach AS (SELECT id, message AS a, message AS b FROM words0
  UNION SELECT r.id, r.a, e.b FROM reach r JOIN edges e ON e.id = r.id AND e.a = r.b),
clusters AS (SELECT id, a AS message, min(b) AS cluster FROM reach GROUP BY id, a)"""


@query("cluster_group", with_(_REACH, "SELECT id, message, cluster FROM clusters"))
def _(spark, sf):
    return dictionary.cluster_group(V.words0(spark, sf), EPS)


@query("silhouette", with_(_REACH + """,
sides AS (SELECT id, a, b, dist FROM pairs UNION ALL SELECT id, b, a, dist FROM pairs),
sizes AS (SELECT id, cluster, count(*) AS n FROM clusters GROUP BY 1, 2),
per AS (SELECT s.id, s.a, ca.cluster = cb.cluster AS own, sum(dist) / (z.n - CASE WHEN ca.cluster = cb.cluster THEN 1 ELSE 0 END) AS far
  FROM sides s JOIN clusters ca ON ca.id = s.id AND ca.message = s.a JOIN clusters cb ON cb.id = s.id AND cb.message = s.b
  JOIN sizes z ON z.id = s.id AND z.cluster = cb.cluster GROUP BY s.id, s.a, ca.cluster, cb.cluster, z.n),
ab AS (SELECT id, a, max(far) FILTER (WHERE own) AS x, min(far) FILTER (WHERE NOT own) AS y FROM per GROUP BY 1, 2),
scores AS (SELECT c.id, avg(CASE WHEN x IS NULL OR y IS NULL THEN 0 ELSE (y - x) / greatest(x, y) END) AS s
  FROM clusters c LEFT JOIN ab ON ab.id = c.id AND ab.a = c.message GROUP BY c.id)
""", """
SELECT id, count(*) AS clusters, round(CASE WHEN count(*) = 1 OR count(*) = sum(n) THEN 1.0 ELSE any_value(s) END, 9) AS score
FROM sizes JOIN scores USING (id) GROUP BY id"""))
def _(spark, sf):
    words = V.words0(spark, sf)
    out = dictionary.silhouette(words, dictionary.cluster_group(words, EPS))
    return out.select("id", "clusters", F.round("score", 9).alias("score"))


# The same closure and silhouette for every bound of a grid.
_TUNED = _PAIRS + """,
grid AS (SELECT 1.0::DOUBLE + 0.05::DOUBLE * i AS eps FROM (SELECT unnest(range(10)) AS i) g),
edges AS (SELECT id, eps, a, b FROM pairs, grid WHERE dist <= eps UNION ALL SELECT id, eps, b, a FROM pairs, grid WHERE dist <= eps),
reach AS (SELECT id, eps, message AS a, message AS b FROM words0, grid
  UNION SELECT r.id, r.eps, r.a, e.b FROM reach r JOIN edges e ON e.id = r.id AND e.eps = r.eps AND e.a = r.b),
clusters AS (SELECT id, eps, a AS message, min(b) AS cluster FROM reach GROUP BY id, eps, a),
sides AS (SELECT id, a, b, dist FROM pairs UNION ALL SELECT id, b, a, dist FROM pairs),
sizes AS (SELECT id, eps, cluster, count(*) AS n FROM clusters GROUP BY 1, 2, 3),
per AS (SELECT s.id, ca.eps, s.a, ca.cluster = cb.cluster AS own, sum(dist) / (z.n - CASE WHEN ca.cluster = cb.cluster THEN 1 ELSE 0 END) AS far
  FROM sides s JOIN clusters ca ON ca.id = s.id AND ca.message = s.a
  JOIN clusters cb ON cb.id = s.id AND cb.eps = ca.eps AND cb.message = s.b
  JOIN sizes z ON z.id = s.id AND z.eps = ca.eps AND z.cluster = cb.cluster GROUP BY s.id, ca.eps, s.a, ca.cluster, cb.cluster, z.n),
ab AS (SELECT id, eps, a, max(far) FILTER (WHERE own) AS x, min(far) FILTER (WHERE NOT own) AS y FROM per GROUP BY 1, 2, 3),
means AS (SELECT c.id, c.eps, avg(CASE WHEN x IS NULL OR y IS NULL THEN 0 ELSE (y - x) / greatest(x, y) END) AS s
  FROM clusters c LEFT JOIN ab ON ab.id = c.id AND ab.eps = c.eps AND ab.a = c.message GROUP BY c.id, c.eps),
scored AS (SELECT id, eps, count(*) AS clusters, count(*) = 1 OR count(*) = sum(n) AS penalty, any_value(s) AS s
  FROM sizes JOIN means USING (id, eps) GROUP BY id, eps),
best AS (SELECT id, eps, clusters, CASE WHEN penalty THEN 1.0 ELSE s END AS score FROM scored
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY CASE WHEN penalty THEN -1.0 ELSE round(s, 12) END DESC, eps) = 1)"""
_GRID = [1.0 + 0.05 * i for i in range(10)]


@query("tune_eps", with_(_TUNED, "SELECT id, eps, clusters, round(score, 9) AS score FROM best"))
def _(spark, sf):
    best, _ = dictionary.tune_eps(V.words0(spark, sf), _GRID)
    return best.withColumn("score", F.round("score", 9))


@query("build_dictionary", with_(_TUNED + """,
medians AS (SELECT id, median(sim) AS m FROM pairs GROUP BY id),
parts AS (SELECT w.*, CASE WHEN m IS NULL OR m > 0.82 THEN '' ELSE c.cluster END AS part
  FROM words0 w LEFT JOIN medians USING (id) JOIN best b ON b.id = w.id JOIN clusters c ON c.id = w.id AND c.eps = b.eps AND c.message = w.message),
flat AS (SELECT id, part, message, unnest(e) AS v, generate_subscripts(e, 1) AS d FROM parts),
mean AS (SELECT id, part, d, avg(v) AS m FROM flat GROUP BY id, part, d),
dist AS (SELECT f.id, f.part, f.message, sqrt(sum((v - m) * (v - m))) AS far FROM flat f JOIN mean USING (id, part, d) GROUP BY 1, 2, 3),
labels AS (SELECT p.id, p.part, count(*) AS n,
  CASE WHEN count(*) > 1 OR p.part <> '' THEN CASE WHEN count(*) FILTER (WHERE message_language = 'en') = 1
    THEN min(p.message) FILTER (WHERE message_language = 'en') ELSE arg_min(translated_message, (round(far, 12), p.message)) END
  ELSE min(translated_message) END AS label
  FROM parts p JOIN dist d ON d.id = p.id AND d.part = p.part AND d.message = p.message GROUP BY p.id, p.part)""", """
SELECT p.id, p.message, p.translated_message, p.message_language, l.label FROM parts p JOIN labels l ON l.id = p.id AND l.part = p.part"""))
def _(spark, sf):
    out = dictionary.build_dictionary(V.words0(spark, sf), grid=_GRID)
    return out.select("id", "message", "translated_message", "message_language", "label")


# --- sources and sinks ----------------------------------------------------------------


@query("session_chunks", """
SELECT l_orderkey AS session, l_partkey AS item, l_linenumber, (dense_rank() OVER (ORDER BY l_orderkey) - 1) // 100 AS chunk FROM lineitem""")
def _(spark, sf):
    path = V.scratch(spark)
    writers.write_session_chunks(V.basket0(spark, sf), path, 100)
    return spark.read.parquet(path).select("session", "item", "l_linenumber", F.col("chunk").cast("bigint").alias("chunk"))


@query("read_logs", "SELECT event_id, user_id, event_type FROM events")
def _(spark, sf):
    path = V.scratch(spark)
    writers.write_parquet(V.table(spark, sf, "events"), f"{path}/a/part")
    return readers.read_logs(spark, path, ("event_id", "user_id", "event_type"))


@query("read_json_log", "SELECT CAST(user_id AS VARCHAR) AS session, event_type AS cat, props AS message FROM events")
def _(spark, sf):
    path = V.scratch(spark)
    V.table(spark, sf, "events").select(
        F.col("ts").cast("string").alias("ts"), F.col("user_id").cast("string").alias("session"),
        F.col("event_type").alias("cat"), F.col("props").alias("message")).write.json(path)
    return readers.read_json_log(spark, path).select("session", "cat", "message")


@query("read_csv_by_name", """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN o_orderpriority END AS o_orderpriority FROM orders""")
def _(spark, sf):
    """Three groups of files: two orders of the columns, and one without the second."""
    path = V.scratch(spark)
    rows = V.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    for i, columns in enumerate((["o_orderkey", "o_orderpriority"], ["o_orderpriority", "o_orderkey"], ["o_orderkey"])):
        rows.filter(F.col("o_orderkey") % 3 == i).select(columns).write.mode("append").option("header", True).csv(path)
    return readers.read_csv_logs(spark, path, by_name=True).select("o_orderkey", "o_orderpriority")


@query("read_csv_logs", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority FROM orders")
def _(spark, sf):
    path = V.scratch(spark)
    V.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority").write.option("header", True).csv(path)
    return readers.read_csv_logs(spark, path)


@query("read_clicks_csv", """
WITH c AS (SELECT user_id AS session_id, date_trunc('second', ts) AS ts, length(event_type)::BIGINT AS item_id, event_type AS category, event_id FROM events),
k AS (SELECT *, lag(item_id) OVER (PARTITION BY session_id ORDER BY ts, item_id, category) AS last FROM c),
kept AS (SELECT * FROM k WHERE last IS NULL OR last <> item_id)
SELECT session_id, item_id, category, CAST(epoch(ts) AS BIGINT) AS at, CAST(epoch(min(ts) OVER (PARTITION BY item_id)) AS BIGINT) AS first_at FROM kept""")
def _(spark, sf):
    path = V.scratch(spark)
    V.table(spark, sf, "events").select(
        "user_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.length("event_type"), "event_type").write.csv(path)
    clicks = readers.read_clicks_csv(spark, path)
    return clicks.select("session_id", "item_id", "category", F.unix_seconds("timestamp").alias("at"),
                         F.unix_seconds("item_ts_first").alias("first_at"))


@query("vocab_json", """
SELECT o_orderpriority AS item, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) + 2 AS item_id FROM orders GROUP BY 1""")
def _(spark, sf):
    path = V.scratch(spark)
    words = features.categorify_table(V.cust0(spark, sf), "item").select(F.col("value").alias("item"), F.col("code").alias("item_id"))
    writers.write_vocab_json(words, path)
    return readers.read_vocab(spark, path)


@query("read_docs", "SELECT lang, CAST(sum(length(text) + 1) AS BIGINT) AS chars FROM documents GROUP BY lang")
def _(spark, sf):
    path = V.scratch(spark)
    V.table(spark, sf, "documents").select("text", "lang").write.partitionBy("lang").text(path)
    docs = readers.read_docs(spark, path, "*.txt")
    # The writer ends every text with a line feed.
    return docs.groupBy(F.regexp_extract("path", "lang=([a-z]+)", 1).alias("lang")).agg(F.sum(F.length("text")).alias("chars"))


@query("write_training", f"""WITH {_ROWS}
SELECT session::VARCHAR AS session_id, CAST(n AS INT) AS item_count, string_agg(item, ',' ORDER BY pos) AS items FROM rows0 GROUP BY session, n""")
def _(spark, sf):
    path = V.scratch(spark)
    rows = sessions.groupby_lists(V.basket0(spark, sf), order=V.BASKET_ORDER, lists=["item"], counts=["item"]).select(
        F.col("session").alias("session_id"), F.col("item-count").alias("item_id-count"), F.col("item-list").alias("item_id-list"))
    writers.write_training(rows, path)
    return spark.read.parquet(path).select("session_id", F.col("item_id-count").alias("item_count"),
                                           F.array_join("item_id-list", ",").alias("items"))


@query("partitioned_time_write", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year FROM orders")
def _(spark, sf):
    path = V.scratch(spark)
    writers.partitioned_time_write(V.table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year")), path, "year")
    return spark.read.parquet(path)


@query("stats_csv", 'SELECT event_type, CAST(count(*) AS VARCHAR) AS "count" FROM events GROUP BY event_type')
def _(spark, sf):
    path = V.scratch(spark)
    writers.write_stats_csv(stats.category_counts(V.table(spark, sf, "events"), "event_type"), path)
    return readers.read_csv_logs(spark, path)
