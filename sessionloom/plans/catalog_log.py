"""Queries on the log: filters, sessions, statistics, alignment, redundancy, workflows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.functions import messages as M
from sessionloom.operators import filters, lookups, redundancy, sessions, stats, workflows
from sessionloom.operators.features import build_vocabulary
from sessionloom.operators.scale import materialize
from sessionloom.plans import views as V
from sessionloom.plans.registry import query
from sessionloom.plans.sqltext import ALIGNED, DICT, ITEMS, KEPT, LIVE_NOISE, LOG, MERGED, NEAR, PRE, replaced, with_
from sessionloom.sources import readers


# --- filters and message functions ----------------------------------------------------


@query("keep_categories", with_(LOG, """
SELECT cat, count(*) AS n FROM log0 WHERE cat IN ('UNDO', 'Menu', 'Tool') GROUP BY cat"""))
def _(spark, sf):
    return filters.keep_categories(V.log0(spark, sf)).groupBy("cat").agg(F.count(F.lit(1)).alias("n"))


@query("prefilter_log", with_(PRE, "SELECT session, ts, seq, cat, message FROM pre"))
def _(spark, sf):
    return V.filtered(spark, sf)


@query("prefilter_live_rules", with_(LOG, """
SELECT session, seq, cat, regexp_replace(message, '\\(MAX-\\d+\\)', '', 'g') AS message FROM log0
WHERE regexp_matches(cat, 'UNDO|Tool|Menu')
  AND NOT """ + LIVE_NOISE))
def _(spark, sf):
    rows = V.log0(spark, sf).withColumn("ts", F.date_format("ts", "MM/dd/yyyy HH:mm:ss 0.000000 +0000"))
    return filters.prefilter_live(rows).select("session", "seq", "cat", "message")


@query("live_timestamps", """
SELECT event_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS seconds FROM events""")
def _(spark, sf):
    text = F.date_format("ts", "M/d/yyyy HH:mm:ss '0.'SSSSSS '+0000'")
    return V.table(spark, sf, "events").select("event_id", M.live_ts_to_unix(text).alias("seconds"))


@query("command_parts", with_(LOG, """
SELECT seq, message, nullif(regexp_extract(message, ': (.+)$', 1), '') AS command,
  CASE WHEN ids = '' THEN '' WHEN starts_with(message, 'Tool:') THEN 'T: ' || ids
       WHEN starts_with(message, 'Menu:') THEN 'M: ' || ids
       WHEN starts_with(message, 'End Event:') THEN 'E: ' || ids ELSE ids END AS ids,
  split_part(message, ':', 1) AS category,
  regexp_replace(message, ' (\\(-?\\d+\\))+$', '') AS content,
  replace(message, 'End Event: ', '') AS shown,
  regexp_full_match(message, '[\\x20-\\x7e\\t\\n\\r\\x0b\\x0c]*') AS printable
FROM (SELECT *, array_to_string(regexp_extract_all(message, '\\((-?\\d+)\\)', 1), ' ') AS ids FROM log0) x"""))
def _(spark, sf):
    return V.log0(spark, sf).select(
        "seq", "message", M.extract_command("message").alias("command"),
        M.extract_command_ids("message").alias("ids"), M.extract_category("message").alias("category"),
        M.strip_command_ids("message").alias("content"), M.display_name("message").alias("shown"),
        M.is_printable("message").alias("printable"))


@query("text_checks", """
SELECT doc_id, regexp_full_match(text, '[\\x20-\\x7e\\t\\n\\r\\x0b\\x0c]*') AS printable,
  regexp_full_match(text, '[\\x00-\\x7f]*') AS ascii, length(replace(text, '''', '')) AS unquoted
FROM documents""")
def _(spark, sf):
    return V.table(spark, sf, "documents").select(
        "doc_id", M.is_printable("text").alias("printable"), M.is_ascii("text").alias("ascii"),
        F.length(M.normalize_quotes("text")).cast("bigint").alias("unquoted"))


@query("drop_prefixes", with_(LOG, """
SELECT seq, message FROM log0 WHERE NOT (starts_with(message, 'Event:') OR starts_with(message, 'Menu: Undo'))"""))
def _(spark, sf):
    return filters.drop_prefixes(V.log0(spark, sf)).select("seq", "message")


@query("drop_suffixes", with_(LOG, """
SELECT seq, message FROM log0 WHERE starts_with(message, 'Menu:') OR NOT ends_with(message, '(-242)')"""))
def _(spark, sf):
    return filters.drop_suffixes(V.log0(spark, sf)).select("seq", "message")


@query("drop_exact", with_(PRE, """
SELECT message, count(*) AS n FROM pre WHERE message NOT IN ('Tool: T1 (-21)', 'Menu: M0 - (30)') GROUP BY message"""))
def _(spark, sf):
    kept = filters.drop_exact(V.filtered(spark, sf), ("Tool: T1 (-21)", "Menu: M0 - (30)"))
    return kept.groupBy("message").agg(F.count(F.lit(1)).alias("n"))


@query("drop_infrequent_le", """
SELECT * FROM (SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice FROM lineitem) l WHERE l_partkey IN (
  SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(*) > 25)""")
def _(spark, sf):
    lines = V.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")
    return filters.drop_infrequent(lines, "l_partkey", 25, inclusive=True)


@query("drop_infrequent_lt", """
SELECT * FROM (SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice FROM lineitem) l WHERE l_partkey IN (
  SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(*) >= 25)""")
def _(spark, sf):
    lines = V.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")
    return filters.drop_infrequent(lines, "l_partkey", 25, inclusive=False)


@query("drop_empty_ids", with_(LOG, """
SELECT seq, message, CASE WHEN starts_with(message, 'Tool:') THEN 'T: ' WHEN starts_with(message, 'Menu:') THEN 'M: '
  WHEN starts_with(message, 'End Event:') THEN 'E: ' ELSE '' END || ids AS id
FROM (SELECT *, array_to_string(regexp_extract_all(message, '\\((-?\\d+)\\)', 1), ' ') AS ids FROM log0) x
WHERE ids <> ''"""))
def _(spark, sf):
    return filters.drop_empty_ids(V.log0(spark, sf)).select("seq", "message", "id")


@query("slice_rows", """
SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 64 OFFSET 100""")
def _(spark, sf):
    return filters.slice_rows(V.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), 100, 164, ["o_orderkey"])


@query("session_rows", with_(KEPT, "SELECT session, ts, seq, cat, message FROM kept WHERE session = '7'"))
def _(spark, sf):
    return filters.session_rows(V.modeling_log(spark, sf), "7")


@query("select_by_tag", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem")
def _(spark, sf):
    tagged = filters.with_tags(V.table(spark, sf, "lineitem"), {
        "l_orderkey": ["session_id"], "l_partkey": ["item_id", "item"], "l_suppkey": ["item"],
        "l_quantity": ["continuous"]})
    return filters.select_by_tag(tagged, ["session_id", "item"])


@query("filter_features", "SELECT l_orderkey, l_quantity FROM lineitem")
def _(spark, sf):
    return filters.filter_features(V.table(spark, sf, "lineitem"), ["l_quantity", "l_orderkey"])


@query("merge_features", """
SELECT p_partkey AS item, s.quantity, s.score, p.size FROM
 (SELECT p_partkey, p_size AS size FROM part) p
 JOIN (SELECT l_partkey, sum(l_quantity) AS quantity, count(*) AS score FROM lineitem GROUP BY 1) s
 ON p_partkey = l_partkey""")
def _(spark, sf):
    first = V.table(spark, sf, "part").select(F.col("p_partkey").alias("item"), F.col("p_size").alias("size"),
                                               F.lit(0).alias("score"))
    second = V.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("item")).agg(
        F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("score"))
    return filters.merge_features([first, second], "item")


# --- sessions -------------------------------------------------------------------------


@query("undo_redo", with_(KEPT, "SELECT session, ts, seq, cat, message FROM kept"))
def _(spark, sf):
    return V.modeling_log(spark, sf)


@query("flagship_top_commands", with_(MERGED, """
SELECT cat, item, n, rank FROM (
  SELECT cat, item, count(*) AS n, row_number() OVER (PARTITION BY cat ORDER BY count(*) DESC, item) AS rank
  FROM merged GROUP BY cat, item) x WHERE rank <= 50"""))
def flagship(spark, sf):
    raw = V.log0(spark, sf)
    runs = sessions.sessionwise(
        filters.prefilter(raw),
        lambda t: sessions.collapse_runs_step(
            sessions.undo_redo_step(t).with_columns(item=M.strip_command_ids("message"))), source=raw)
    return stats.top_commands(runs, 50, ["cat"], "item", strip_marker=False).withColumnRenamed("count", "n")


@query("collapse_runs", """
SELECT session, max(ts) AS ts, max(seq) AS seq, item, count(*) AS merge_count FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY session ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT user_id AS session, ts, event_id AS seq, event_type AS item,
      CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS fresh
    FROM events) a) b GROUP BY session, run, item""")
def _(spark, sf):
    return sessions.collapse_runs(V.runs0(spark, sf))


@query("drop_repeats", """
SELECT session, ts, seq, item FROM (
  SELECT user_id AS session, ts, event_id AS seq, event_type AS item,
    lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM events) a
WHERE last IS NULL OR last <> item""")
def _(spark, sf):
    return sessions.drop_repeats(V.runs0(spark, sf))


@query("time_intervals", """
SELECT session, seq, sec, sec - coalesce(lag(sec) OVER (PARTITION BY session ORDER BY sec, seq), sec) AS timestamp_interval
FROM (SELECT user_id AS session, event_id AS seq, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS sec FROM events) a""")
def _(spark, sf):
    rows = V.runs0(spark, sf).select("session", "seq", M.to_unix_seconds("ts").alias("sec"))
    return sessions.time_intervals(rows, ts="sec", order=("sec", "seq"))


@query("first_seen", """
SELECT event_id AS seq, event_type AS item, min(ts) OVER (PARTITION BY event_type) AS item_ts_first FROM events""")
def _(spark, sf):
    return stats.first_seen(V.runs0(spark, sf)).select("seq", "item", "item_ts_first")


@query("split_fixed", """
SELECT o_orderkey, session, CASE WHEN n < 3 THEN CAST(session AS VARCHAR)
  ELSE session || '-' || least(CAST(ceil(rn / 8.0) AS BIGINT), n // 8 + CASE WHEN n % 8 >= 3 THEN 1 ELSE 0 END) END AS session_part
FROM (SELECT o_orderkey, o_custkey AS session,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn,
        count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) a""")
def _(spark, sf):
    parts = sessions.split_fixed(V.cust0(spark, sf), min_items=3, max_items=8, order=V.CUST_ORDER)
    return parts.select("o_orderkey", "session", "session_part")


# --- statistics -----------------------------------------------------------------------


@query("message_counts", with_(LOG, """
SELECT regexp_replace(message, '\\(MAX-\\d+\\)', '', 'g') AS message, count(*) AS "count" FROM log0 GROUP BY 1"""))
def _(spark, sf):
    return stats.message_counts(V.log0(spark, sf), strip_marker=True)


@query("session_lengths", with_(LOG, "SELECT session, count(*) AS length FROM log0 GROUP BY session"))
def _(spark, sf):
    return stats.session_lengths(V.log0(spark, sf))


@query("session_length_totals", with_(LOG, """
SELECT count(DISTINCT session) AS sessions, count(*) AS rows,
  round(count(*) / count(DISTINCT session), 6) AS avg_length FROM log0"""))
def _(spark, sf):
    return stats.session_length_totals(V.log0(spark, sf)).withColumn("avg_length", F.round("avg_length", 6))


_STATS = PRE + """,
before AS (SELECT session, max(s) - min(s) AS seconds_before, count(*) AS rows_before FROM (
  SELECT session, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS s FROM log0) x GROUP BY session),
after AS (SELECT session, max(ts) - min(ts) AS seconds_after, count(*) AS rows_after FROM pre GROUP BY session)"""


@query("session_stats", with_(_STATS, """
SELECT session, seconds_before, rows_before, seconds_after, rows_after FROM before LEFT JOIN after USING (session)"""))
def _(spark, sf):
    raw = V.log0(spark, sf).withColumn("ts", M.to_unix_seconds("ts"))
    return stats.session_stats_both(raw, V.filtered(spark, sf))


@query("session_stats_summary", with_(_STATS, """
SELECT round(avg(rows_after), 6) AS mean_rows, round(avg(seconds_after) / 60, 6) AS mean_minutes FROM after"""))
def _(spark, sf):
    out = stats.session_stats_summary(stats.session_stats(V.filtered(spark, sf)))
    return out.select(F.round("mean_rows", 6).alias("mean_rows"), F.round("mean_minutes", 6).alias("mean_minutes"))


@query("session_length_histogram", with_(_STATS, """
SELECT bin, count(*) AS rows FROM (
  SELECT CAST(least(floor((rows_after - lo) / ((hi - lo) / 100.0)), 99) AS INT) AS bin
  FROM after, (SELECT min(rows_after) AS lo, max(rows_after) AS hi FROM after) b) c GROUP BY bin"""))
def _(spark, sf):
    return stats.histogram(stats.session_stats(V.filtered(spark, sf)), "rows", 100)


@query("session_minutes_histogram", with_(_STATS, """
SELECT bin, count(*) AS rows FROM (
  SELECT CAST(least(floor((m - lo) / ((hi - lo) / 100.0)), 99) AS INT) AS bin
  FROM (SELECT seconds_after / 60.0::DOUBLE AS m FROM after) a,
    (SELECT min(seconds_after) / 60.0::DOUBLE AS lo, max(seconds_after) / 60.0::DOUBLE AS hi FROM after) b) c GROUP BY bin"""))
def _(spark, sf):
    minutes = stats.session_stats(V.filtered(spark, sf)).withColumn("minutes", F.col("seconds") / 60)
    return stats.histogram(minutes, "minutes", 100)


@query("category_counts", with_(LOG, """SELECT cat, count(*) AS "count" FROM log0 GROUP BY cat"""))
def _(spark, sf):
    return stats.category_counts(V.log0(spark, sf))


_COUNTED = LOG + """,
counted AS (SELECT cat, regexp_replace(message, '\\(MAX-\\d+\\)', '', 'g') AS message, count(*) AS n FROM log0 GROUP BY 1, 2)"""


@query("top_commands", with_(_COUNTED, """
SELECT message, sum(n)::BIGINT AS "count", CAST(row_number() OVER (ORDER BY sum(n) DESC, message) AS INT) AS rank
FROM counted GROUP BY message QUALIFY row_number() OVER (ORDER BY sum(n) DESC, message) <= 10"""))
def _(spark, sf):
    return stats.top_commands(V.log0(spark, sf), 10)


@query("top_by_category", with_(_COUNTED, """
SELECT cat, message, n AS "count", CAST(row_number() OVER (PARTITION BY cat ORDER BY n DESC, message) AS INT) AS rank
FROM counted QUALIFY row_number() OVER (PARTITION BY cat ORDER BY n DESC, message) <= 3"""))
def _(spark, sf):
    return stats.top_commands(V.log0(spark, sf), 3, ["cat"])


@query("hourly_activity", """
SELECT strftime(ts, '%Y-%m-%d %H') AS hour, count(*) AS "count" FROM events GROUP BY 1""")
def _(spark, sf):
    return stats.hourly_activity(V.table(spark, sf, "events"))


_RARE = """rare AS (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(*) < 20),
minority AS (SELECT * FROM lineitem WHERE l_orderkey IN (
  SELECT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM rare)))"""


@query("minority_sessions", f"WITH {_RARE} SELECT l_orderkey AS session, l_partkey AS item, l_linenumber FROM minority")
def _(spark, sf):
    return stats.minority_sessions(V.basket0(spark, sf), below=20).select("session", "item", "l_linenumber")


@query("minority_counts", f"""WITH {_RARE} SELECT (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS sessions,
  (SELECT count(DISTINCT l_orderkey) FROM minority) AS minority_sessions""")
def _(spark, sf):
    rows = V.basket0(spark, sf)
    return stats.minority_counts(rows, stats.minority_sessions(rows, below=20))


@query("minority_coverage", f"""WITH {_RARE}
SELECT 'train' AS split, count(DISTINCT l_orderkey) AS minority_sessions FROM minority WHERE l_returnflag <> 'N'
UNION ALL SELECT 'val', count(DISTINCT l_orderkey) FROM minority WHERE l_returnflag = 'N'""")
def _(spark, sf):
    rows = V.basket0(spark, sf)
    parts = {"train": rows.filter("l_returnflag <> 'N'"), "val": rows.filter("l_returnflag = 'N'")}
    return stats.minority_coverage(parts, stats.minority_sessions(rows, below=20))


# --- alignment and lookups ------------------------------------------------------------


@query("read_dictionary", with_(DICT, "SELECT message, label FROM dict0"))
def _(spark, sf):
    path = V.scratch(spark)
    V.dictionary_rows(materialize(V.modeling_log(spark, sf))).write.option("header", True).csv(path)
    return readers.read_dictionary(spark, path)


@query("translate_drop", with_(ALIGNED, "SELECT session, ts, seq, cat, message, label, message_eng FROM aligned"))
def _(spark, sf):
    return V.aligned(spark, sf).select("session", "ts", "seq", "cat", "message", "label", "message_eng")


@query("translate_keep", with_(DICT, """
SELECT k.session, k.seq, coalesce(d.label, k.message) AS message_eng
FROM kept k LEFT JOIN dict0 d ON d.message = k.message
WHERE regexp_full_match(coalesce(d.label, k.message), '[\\x00-\\x7f]*')"""))
def _(spark, sf):
    log = materialize(V.modeling_log(spark, sf))
    rows = lookups.translate(log, V.dict0(log), keep_unmapped=True).filter(M.is_ascii("message_eng"))
    return rows.select("session", "seq", "message_eng")


_SIDE = ITEMS + """,
side0 AS (SELECT DISTINCT item AS message_content, 'about ' || item AS summary,
  CASE WHEN item <> 'Tool: T2' THEN split_part(item, ':', 1) END AS classification, right(item, 2) AS target
  FROM items WHERE item <> 'Tool: T3')"""


@query("side_info", with_(_SIDE, """
SELECT i.session, i.seq, i.item, s.summary AS description, s.classification, s.target
FROM items i LEFT JOIN side0 s ON s.message_content = i.item"""))
def _(spark, sf):
    rows = materialize(V.items(spark, sf))
    return lookups.attach_side_info(rows, V.side0(rows), "item").select(
        "session", "seq", "item", "description", "classification", "target")


@query("find_missing", with_(_SIDE, """
SELECT i.session, i.seq, i.item FROM items i LEFT JOIN side0 s ON s.message_content = i.item
WHERE s.classification IS NULL OR s.target IS NULL"""))
def _(spark, sf):
    rows = materialize(V.items(spark, sf))
    return filters.find_missing(lookups.attach_side_info(rows, V.side0(rows), "item")).select("session", "seq", "item")


@query("drop_null_rows", with_(_SIDE, """
SELECT i.session, i.seq, s.classification FROM items i JOIN side0 s ON s.message_content = i.item
WHERE s.classification IS NOT NULL"""))
def _(spark, sf):
    rows = materialize(V.items(spark, sf))
    side = lookups.attach_side_info(rows, V.side0(rows), "item")
    return filters.drop_null_rows(side, ["classification", "target"]).select("session", "seq", "classification")


@query("semi_join", """
SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25)""")
def _(spark, sf):
    keys = V.table(spark, sf, "part").filter("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    return lookups.semi(V.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), keys, "l_partkey")


@query("anti_rare", """
SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(*) < 20)""")
def _(spark, sf):
    lines = V.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    return lookups.anti(lines, stats.rare_items(lines, "l_partkey", 20), "l_partkey")


# --- redundancy -----------------------------------------------------------------------


@query("following_low_level", with_(NEAR, """
SELECT c.session, c.label, c.message_eng, coalesce(n.events, '') AS events FROM commands c LEFT JOIN (
  SELECT session, label, string_agg(event, ';' ORDER BY later DESC, "at") AS events FROM near GROUP BY 1, 2) n
USING (session, label)"""))
def _(spark, sf):
    near = redundancy.following_low_level(V.aligned(spark, sf))
    return near.select("session", "label", "message_eng", F.array_join("events", ";").alias("events"))


@query("pair_support", with_(NEAR, "SELECT command, event, sup1, sup2 FROM support"))
def _(spark, sf):
    return redundancy.pair_support(redundancy.following_low_level(V.aligned(spark, sf)))


@query("pair_confidence", with_(NEAR, """
SELECT command, event, sup1 AS sup1_group_sum, sup2 AS sup2_sum, round(sup2 / sup1, 9) AS confidence FROM support
WHERE sup2 / sup1 > 0.1 AND event <> 'End Event: E2 (52)' AND (sup1 >= 300 OR sup2 / sup1 > 0.4)"""))
def _(spark, sf):
    support = redundancy.pair_support(redundancy.following_low_level(V.aligned(spark, sf)))
    pairs = redundancy.pair_confidence(support, generic=("End Event: E2 (52)",), rare_support=300)
    return pairs.withColumn("confidence", F.round("confidence", 9))


@query("pair_confidence_files", with_(NEAR, """
SELECT command, event, sup1_group_sum, sup2_sum, round(sup2_sum / sup1_group_sum, 9) AS confidence FROM (
  SELECT command, event, CAST(sum(sup2) AS BIGINT) AS sup2_sum FROM (
    SELECT command, event, session::BIGINT % 3 AS file, count(DISTINCT (session, label)) AS sup2 FROM near GROUP BY ALL) a GROUP BY ALL) x
JOIN (SELECT command, CAST(sum(sup1) AS BIGINT) AS sup1_group_sum FROM (
    SELECT message_eng AS command, session::BIGINT % 3 AS file, count(*) AS sup1 FROM commands GROUP BY ALL) b
  SEMI JOIN (SELECT command, session::BIGINT % 3 AS file FROM near) n USING (command, file) GROUP BY command) y USING (command)
WHERE sup2_sum / sup1_group_sum > 0.1 AND event <> 'End Event: E2 (52)' AND (sup1_group_sum >= 300 OR sup2_sum / sup1_group_sum > 0.4)"""))
def _(spark, sf):
    """Support counted per file of sessions and put together."""
    near = materialize(redundancy.following_low_level(V.aligned(spark, sf)))
    files = [redundancy.pair_support(near.filter(F.col("session").cast("bigint") % 3 == i)).withColumn("file_index", F.lit(i)) for i in range(3)]
    pairs = redundancy.pair_confidence(files[0].unionByName(files[1]).unionByName(files[2]), generic=("End Event: E2 (52)",), rare_support=300)
    return pairs.withColumn("confidence", F.round("confidence", 9))


@query("join_sums_back", """
SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag, sum(l_quantity) OVER (PARTITION BY l_partkey, l_returnflag) AS quantity
FROM lineitem""")
def _(spark, sf):
    lines = V.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_quantity")
    return lookups.join_sums_back(lines, "l_partkey", "l_returnflag", "l_quantity", "quantity").drop("l_quantity")


@query("replace_low_level", with_(ALIGNED + replaced("aligned", "e.label BETWEEN c.label - 10 AND c.label + 30"), """
SELECT session, ts, seq, cat, label, message_eng FROM replaced"""))
def _(spark, sf):
    rows = redundancy.replace_low_level(V.aligned(spark, sf), V.pairs0(spark))
    return rows.select("session", "ts", "seq", "cat", "label", "message_eng")


# --- workflows ------------------------------------------------------------------------

# Each pattern is one text replacement from left to right in the session's item list, where
# every item is wrapped in ~ signs.
_FLOW = ITEMS + """,
texts AS (SELECT session, string_agg('~' || item || '~', '' ORDER BY ts, seq) AS t FROM items GROUP BY session),
flows AS (SELECT session, replace(replace(t, '~Tool: T1~~End Event: E0~', '~Tool: T1,End Event: E0~'),
  '~Tool: T2~~End Event: E1~~Tool: T2~', '~Tool: T2,End Event: E1,Tool: T2~') AS t FROM texts)"""


@query("merge_workflows", with_(_FLOW, """
SELECT session, replace(substr(t, 2, length(t) - 2), '~~', '; ') AS sequence FROM flows"""))
def _(spark, sf):
    merged = workflows.merge_workflows(V.items(spark, sf), "item", V.PATTERNS, source=V.log0(spark, sf))
    lists = sessions.groupby_lists(merged, lists=["item"])
    return lists.select("session", F.array_join("item-list", "; ").alias("sequence"))


_MERGED_FLOW = MERGED + """,
ordered AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, seq) AS p,
  lead(item) OVER w AS i1, lead(item, 2) OVER w AS i2 FROM merged WINDOW w AS (PARTITION BY session ORDER BY ts, seq)),
one AS (SELECT *, (item = 'Tool: T1' AND i1 = 'End Event: E0') IS TRUE AS s1,
  (item = 'Tool: T2' AND i1 = 'End Event: E1' AND i2 = 'Tool: T2') IS TRUE AS f2 FROM ordered),
chains AS (SELECT session, p, row_number() OVER (PARTITION BY session ORDER BY p) AS nth,
  CASE WHEN p - lag(p) OVER (PARTITION BY session ORDER BY p) < 3 THEN 0 ELSE 1 END AS fresh FROM one WHERE f2),
links AS (SELECT *, sum(fresh) OVER (PARTITION BY session ORDER BY p) AS chain FROM chains),
two AS (SELECT session, p FROM (SELECT *, row_number() OVER (PARTITION BY session, chain ORDER BY p) AS k FROM links) l WHERE k % 2 = 1),
starts AS (SELECT session, p, 2 AS size FROM one WHERE s1 UNION ALL SELECT session, p, 3 FROM two),
owned AS (SELECT o.*, s.p AS start FROM ordered o LEFT JOIN starts s ON s.session = o.session AND o.p >= s.p AND o.p < s.p + s.size),
flow_rows AS (SELECT session, coalesce(start, p) AS pos, max(ts) AS ts, CASE WHEN count(*) > 1 THEN 'workflow' ELSE any_value(cat) END AS cat,
  string_agg(message, ', ' ORDER BY p) AS message, string_agg(item, ', ' ORDER BY p) AS message_content,
  string_agg(CASE WHEN starts_with(message, 'Tool:') THEN 'T: ' WHEN starts_with(message, 'Menu:') THEN 'M: ' ELSE 'E: ' END
    || array_to_string(regexp_extract_all(message, '\\((-?\\d+)\\)', 1), ' '), ', ' ORDER BY p) AS localization_id,
  CASE WHEN count(*) > 1 THEN 1 ELSE any_value(merge_count) END AS merge_count
  FROM owned GROUP BY session, coalesce(start, p))"""


@query("workflow_rows", with_(_MERGED_FLOW, """
SELECT session, ts, cat, message, message_content, localization_id, merge_count FROM flow_rows"""))
def _(spark, sf):
    flows = workflows.workflow_rows(V.merged_log(spark, sf), V.PATTERNS, source=V.log0(spark, sf))
    return flows.select("session", "ts", "cat", "message", "message_content", "localization_id", "merge_count")


@query("merge_first_match", with_(_FLOW.replace("flows AS", "unused AS") + """,
pass AS (SELECT session, regexp_replace(t, '(~Tool: T1~~End Event: E0~)|(~Tool: T2~~End Event: E1~~Tool: T2~)',
  '<\\1\\2>', 'g') AS t FROM texts)""", """
SELECT session, replace(substr(u, 2, length(u) - 2), '~~', '; ') AS sequence FROM (
  SELECT session, replace(replace(t, '<~Tool: T1~~End Event: E0~>', '~Tool: T1, End Event: E0~'),
    '<~Tool: T2~~End Event: E1~~Tool: T2~>', '~Tool: T2, End Event: E1, Tool: T2~') AS u FROM pass) x"""))
def _(spark, sf):
    merged = workflows.merge_first_match(V.items(spark, sf), "item", V.PATTERNS, source=V.log0(spark, sf))
    lists = sessions.groupby_lists(merged, lists=["item"])
    return lists.select("session", F.array_join("item-list", "; ").alias("sequence"))


@query("vocabulary", with_(_MERGED_FLOW, """
SELECT item, n, row_number() OVER (ORDER BY kind, n DESC, item) AS item_id FROM (
  SELECT 0 AS kind, item, count(*) AS n FROM merged GROUP BY item
  UNION ALL SELECT 1, message_content, count(*) FROM flow_rows WHERE cat = 'workflow' GROUP BY 2) v"""))
def _(spark, sf):
    rows = materialize(V.merged_log(spark, sf))
    return build_vocabulary(rows, workflows.workflow_rows(rows, V.PATTERNS, source=rows))


def _round(n: int) -> str:
    """One learning round on the wrapped item lists: count neighbours, merge the best pair."""
    return f""",
l{n} AS (SELECT session, string_split(substr(t, 2, length(t) - 2), '~~') AS l FROM t{n}),
p{n} AS (SELECT unnest(l[1:len(l) - 1]) AS a, unnest(l[2:]) AS b FROM l{n} WHERE len(l) > 1),
b{n} AS (SELECT a, b, count(*) AS n FROM p{n} GROUP BY a, b ORDER BY n DESC, a, b LIMIT 1),
t{n + 1} AS (SELECT session, replace(t, '~' || a || '~~' || b || '~', '~' || a || ',' || b || '~') AS t FROM t{n}, b{n})"""


@query("learn_merges", with_(ITEMS + """,
t1 AS (SELECT session, string_agg('~' || item || '~', '' ORDER BY ts, seq) AS t FROM items GROUP BY session)"""
                             + _round(1) + _round(2) + _round(3), """
SELECT a || ',' || b AS workflow, n FROM b1 UNION ALL SELECT a || ',' || b, n FROM b2 UNION ALL SELECT a || ',' || b, n FROM b3"""))
def _(spark, sf):
    learned = workflows.learn_merges(V.items(spark, sf), rounds=3)
    return spark.createDataFrame([(",".join(parts), n) for parts, n in learned], "workflow string, n bigint")
