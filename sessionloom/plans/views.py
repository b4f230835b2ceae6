"""Named inputs on the shared tables, for the query catalogue and the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions import messages as M
from sessionloom.operators.filters import prefilter
from sessionloom.operators.lookups import last_wins, translate
from sessionloom.operators.redundancy import label_rows
from sessionloom.operators.scale import materialize
from sessionloom.operators.sessions import undo_redo

# The log view, as expressions that Spark and DuckDB both understand: sessions are users,
# message kinds come from the event type, and ``k`` from the properties.
LOG_K = "CAST(substr(props, 7, length(props) - 7) AS INT)"
LOG_CAT = """CASE WHEN event_type = 'click' THEN 'Tool' WHEN event_type = 'view' THEN 'Menu'
       WHEN event_type = 'signup' AND k % 4 = 3 THEN 'System' ELSE 'UNDO' END"""
LOG_MESSAGE = """CASE event_type
    WHEN 'click' THEN CASE WHEN k % 10 = 0 THEN 'Tool: Zoom (-242)'
      ELSE 'Tool: T' || CAST(k % 4 AS STRING) || ' (-' || CAST(20 + k % 4 AS STRING) || ')' END
    WHEN 'view' THEN CASE WHEN k % 10 = 0 THEN 'Menu: Undo (-26) (0)'
      ELSE 'Menu: M' || CAST(k % 3 AS STRING) || ' - (' || CAST(30 + k % 3 AS STRING)
           || ')(MAX-' || CAST(k AS STRING) || ')' END
    WHEN 'purchase' THEN 'End Event: E' || CAST(event_id % 3 AS STRING)
           || ' (' || CAST(50 + event_id % 3 AS STRING) || ')'
    WHEN 'error' THEN CASE WHEN k % 2 = 0 THEN 'Undo Event: E' ELSE 'Undo and Remove Action: E' END
           || CAST(event_id % 3 AS STRING) || ' (' || CAST(50 + event_id % 3 AS STRING) || ')'
    ELSE CASE k % 4 WHEN 0 THEN 'Redo Event: E' WHEN 1 THEN 'End Event: E'
                    WHEN 2 THEN 'Event: E' ELSE 'End Event: E' END
           || CAST(event_id % 3 AS STRING) || ' (' || CAST(50 + event_id % 3 AS STRING) || ')'
  END"""
LOG_SELECT = f"""
SELECT CAST(user_id AS STRING) AS session, ts, event_id AS seq, {LOG_CAT} AS cat, {LOG_MESSAGE} AS message
FROM (SELECT *, {LOG_K} AS k FROM events) e
"""

PATTERNS = [["Tool: T1", "End Event: E0"], ["Tool: T2", "End Event: E1", "Tool: T2"]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log0(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """The raw log.  Category and message are computed once per row: behind ``inline`` no
    later filter is pushed down with a copy of their long expressions.

    ``spread``: rows are dealt out first, as a file of few row groups is read by as few tasks."""
    events = table(spark, sf_dir, "events")
    if spread:
        events = events.select("event_id", "ts", "user_id", "event_type", "props").repartition("event_id", "user_id", "ts")
    return events.selectExpr("*", f"{LOG_K} AS k").selectExpr(
        "CAST(user_id AS STRING) AS session", "ts", "event_id AS seq",
        f"inline(array(struct({LOG_CAT} AS cat, {LOG_MESSAGE} AS message)))")


def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefilter(log0(spark, sf_dir))


def modeling_log(spark: SparkSession, sf_dir: str, raw: DataFrame | None = None) -> DataFrame:
    """The filtered log with undone work removed; ``raw`` is the raw log where it has been computed already."""
    raw = log0(spark, sf_dir) if raw is None else raw
    return undo_redo(prefilter(raw), source=raw)


def dictionary_rows(log: DataFrame) -> DataFrame:
    """A dictionary on the messages of the log: one is missing, one has a label that cannot
    be printed, and one is listed twice."""
    words = log.select("message").distinct()
    label = F.when(F.col("message").startswith("Menu: M2"), F.concat("message", F.lit("é"))).otherwise(F.col("message"))
    main = words.filter(~F.col("message").startswith("Tool: T3")).select(
        "message", label.alias("label"), F.lit(2).alias("seq"))
    old = words.filter(F.col("message").startswith("End Event: E0")).select(
        "message", F.concat(F.lit("old "), F.col("message")).alias("label"), F.lit(1).alias("seq"))
    return main.unionByName(old)


def dict0(log: DataFrame) -> DataFrame:
    return last_wins(dictionary_rows(log), "message", "label", "seq")


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled, translated rows with printable text."""
    # The log feeds the dictionary and is then translated by it: written once in between.
    log = materialize(label_rows(modeling_log(spark, sf_dir), source=log0(spark, sf_dir)))
    return translate(log, dict0(log)).filter(M.is_printable("message_eng"))


def pairs0(spark: SparkSession) -> DataFrame:
    """Known command/event pairs; commands T2 and T3 have none."""
    return spark.createDataFrame(
        [("Tool: T0 (-20)", "End Event: E0 (50)"), ("Tool: T1 (-21)", "End Event: E1 (51)"),
         ("Menu: M0 - (30)", "End Event: E0 (50)")], "command string, event string")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modeling log with the command text as item."""
    return modeling_log(spark, sf_dir).withColumn("item", M.strip_command_ids("message"))


def merged_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collapsed log in the column layout of the workflow step."""
    from sessionloom.operators.sessions import collapse_runs

    rows = modeling_log(spark, sf_dir).withColumns({
        "message_eng": F.col("message"), "message_content": M.strip_command_ids("message"),
        "localization_id": M.extract_command_ids("message")})
    return collapse_runs(rows, "message_content", source=log0(spark, sf_dir))


def side0(log: DataFrame, item: str = "item") -> DataFrame:
    """Side information on the items of a log; one item is missing, one class is null."""
    words = log.select(F.col(item).alias("message_content")).distinct()
    kind = F.element_at(F.split("message_content", ":"), 1)
    return words.filter(F.col("message_content") != "Tool: T3").select(
        "message_content", F.concat(F.lit("about "), F.col("message_content")).alias("summary"),
        F.when(F.col("message_content") != "Tool: T2", kind).alias("classification"),
        F.substring("message_content", -2, 2).alias("target"))


def runs0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("item"))


BASKET_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def basket0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as sessions of parts."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("session"), F.col("l_partkey").alias("item"), *BASKET_ORDER,
        "l_quantity", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")


def cust0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("session"), F.col("o_orderpriority").alias("item"), "o_orderdate", "o_orderkey")


CUST_ORDER = ("o_orderdate", "o_orderkey")


def words0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as spellings of commands: the label is the command id; some spellings are the
    only one of their command."""
    name = F.concat(F.lit("m"), F.format_string("%06d", "vec_id"))
    alone = F.concat(F.lit("x"), F.col("vec_id").cast("string"))
    return table(spark, sf_dir, "embeddings").select(
        F.when(F.col("vec_id") % 97 == 0, alone).otherwise(F.col("label").cast("string")).alias("id"),
        name.alias("message"), F.concat(F.lit("en "), name).alias("translated_message"),
        F.when(F.col("vec_id") % 50 == 0, "en").otherwise("de").alias("message_language"),
        F.col("embedding"))


def preds0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored candidates: each order line proposes its part, scored by discounted price, and
    is relevant if it was not returned."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("session"), F.col("l_partkey").alias("item")).agg(
        F.max(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("score"),
        F.max(F.when(F.col("l_returnflag") == "N", 1).otherwise(0)).alias("relevant"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lists of parts and of line numbers, in basket order."""
    from sessionloom.operators.sessions import groupby_lists

    lists = groupby_lists(basket0(spark, sf_dir), order=BASKET_ORDER, lists=["item", "l_linenumber"])
    return lists.select("session", F.col("item-list").alias("items"),
                        F.col("l_linenumber-list").cast("array<bigint>").alias("lines"))


def exploded(df: DataFrame, key: str, *lists: str) -> DataFrame:
    """Lists as rows (key, pos, one column per list)."""
    zipped = F.arrays_zip(*[F.col(c).alias(f"c{i}") for i, c in enumerate(lists)])
    return df.select(key, F.posexplode(zipped).alias("pos", "z")).select(
        key, "pos", *[F.col(f"z.c{i}").alias(c) for i, c in enumerate(lists)])


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder, for write-and-read queries."""
    import uuid

    from sessionloom.session import ensure_checkpoint_dir

    return f"{ensure_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"
