"""Chat formatting: quotations are linked to the messages they quote, and removed.

A line that begins with ``>`` marks, blanks allowed between them, is quoted, one level per
mark.  Neighbouring lines of the same level are a passage.  Lines are normalised (outer marks
and white space off, inner white space one blank, lower case) and hashed; so are whole
passages.  A passage belongs to the earliest message of its conversation, before the quoting
one, whose own text (without quotes) is the passage; if there is none, its lines vote, each
for the earliest message that has the line as its own.  A message answers the message that
most of its outermost quoted lines come from, ties to the later one; without a link it opens
a thread of its own.

Attribution lines (``... wrote:`` and the like, right before a quotation) go with the quotes.
The conversation is ordered by replies: ``thread`` is the turn of the message that opened the
thread, ``depth`` the number of replies up to it, and messages go by (thread, turn).  Replies
come after what they answer, as that is always an earlier turn.

All in DataFrame functions.  Links go over minima per (conversation, hash), so lines that are
common in a conversation cost one row each.  Null and empty texts are messages without text or
quotes.  Messages that share conversation and turn are told apart by text; rows that agree in
all four columns are repeated.  A null conversation or turn takes part in no link.  Other columns are
not read.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.operators.scale import materialize

QUOTED = r"^[ \t]*>"
MARKS = r"^[ \t]*((?:>[ \t]*)+)"
ATTRIBUTION = r"(?i)^[^\n]{0,200}(wrote|writes|schrieb|a écrit|escribió)[ \t]*:[ \t]*$"


def _normal(line: Column) -> Column:
    bare = F.regexp_replace(line, MARKS, "")
    return F.lower(F.trim(F.regexp_replace(bare, r"\s+", " ")))


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", ""))


def parse_messages(df: DataFrame) -> DataFrame:
    """conv_id, turn, role with ``own`` (text without quotes), ``own_hashes`` (of its lines and the whole)
    and ``passages`` (level, hash of the whole, hashes of the lines)."""
    lines = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"), "\n", -1)
    leveled = F.transform(lines, lambda x: F.struct(_level(x).alias("level"), x.alias("line")))
    rows = df.select("conv_id", "turn", "role", "text", leveled.alias("lines"))

    def own_line(x: Column, i: Column) -> Column:
        before_quote = F.coalesce(F.get(F.col("lines"), i + 1)["level"] > 0, F.lit(False))
        return (x["level"] == 0) & ~(before_quote & x["line"].rlike(ATTRIBUTION))

    own = F.transform(F.filter("lines", own_line), lambda x: x["line"])
    empty = F.array().cast("array<struct<level:int,lines:array<string>>>")

    def extend(passages: Column, x: Column) -> Column:
        last = F.try_element_at(passages, F.lit(-1))
        fresh = F.struct(x["level"].alias("level"), F.array(_normal(x["line"])).alias("lines"))
        longer = F.struct(x["level"].alias("level"), F.concat(last["lines"], F.array(_normal(x["line"]))).alias("lines"))
        follows = F.coalesce(last["level"] == x["level"], F.lit(False))
        return F.when(follows, F.concat(F.slice(passages, 1, F.size(passages) - 1), F.array(longer))).otherwise(F.concat(passages, F.array(fresh)))

    # Lines without quotes are kept as level 0 until here, so that they end a passage.
    grouped = F.when(F.exists("lines", lambda x: x["level"] > 0),
                     F.filter(F.aggregate("lines", empty, extend), lambda p: p["level"] > 0)).otherwise(empty)
    filled = lambda xs: F.filter(xs, lambda x: x != "")
    passages = F.filter(F.transform(grouped, lambda p: F.struct(p["level"].alias("level"), filled(p["lines"]).alias("lines"))),
                        lambda p: F.size(p["lines"]) > 0)
    parsed = rows.select("conv_id", "turn", "role", "text", own.alias("own_lines"), passages.alias("passages"))
    normal = filled(F.transform("own_lines", _normal))
    trimmed = F.regexp_replace(F.array_join("own_lines", "\n"), r"^\s+|\s+$", "")
    return parsed.select(
        "conv_id", "turn", "role", "text", trimmed.alias("own"),
        F.array_distinct(F.transform(normal, lambda x: F.xxhash64(F.lit("line"), x))).alias("line_hashes"),
        F.when(F.size(normal) > 0, F.xxhash64(F.lit("whole"), F.array_join(normal, "\n"))).alias("whole_hash"),
        F.transform("passages", lambda p: F.struct(
            p["level"].alias("level"), F.xxhash64(F.lit("whole"), F.array_join(p["lines"], "\n")).alias("whole"),
            F.transform(p["lines"], lambda x: F.xxhash64(F.lit("line"), x)).alias("lines"))).alias("passages"))


def _links(parsed: DataFrame) -> DataFrame:
    """(message, reply_to, n_linked) for messages with a linked passage."""
    located = parsed.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    asked = located.select("conv_id", "turn", "message", F.posexplode("passages").alias("p", "passage"))
    # Only hashes that are quoted somewhere need their earliest message.
    hashes = asked.select("conv_id", F.explode(F.array_union(F.array("passage.whole"), "passage.lines")).alias("hash")).distinct()
    written = located.select("conv_id", "turn", F.explode(F.array_compact(F.array_union("line_hashes", F.array("whole_hash")))).alias("hash"))
    first = written.groupBy("conv_id", "hash").agg(F.min("turn").alias("origin")).join(hashes, ["conv_id", "hash"])
    first = materialize(first)
    whole = (asked.select("conv_id", "turn", "message", "p", F.col("passage.whole").alias("hash"))
             .join(first, ["conv_id", "hash"]).filter("origin < turn").select("message", "p", "origin"))
    lines = asked.select("conv_id", "turn", "message", "p", "passage.level", F.explode("passage.lines").alias("hash"))
    by_line = lines.join(first, ["conv_id", "hash"], "left").withColumn("by_line", F.when(F.col("origin") < F.col("turn"), F.col("origin"))).drop("origin")
    votes = (by_line.join(whole.withColumnRenamed("origin", "by_whole"), ["message", "p"], "left")
             .withColumn("origin", F.coalesce("by_whole", "by_line")))
    counted = votes.groupBy("message", "level", "origin").agg(F.count(F.lit(1)).alias("n"))
    linked = counted.groupBy("message").agg(
        F.sum(F.when(F.col("origin").isNotNull(), F.col("n")).otherwise(0)).alias("n_linked"),
        F.max(F.when((F.col("level") == 1) & F.col("origin").isNotNull(), F.struct("n", "origin"))).alias("best"),
        F.max(F.when(F.col("origin").isNotNull(), F.struct(-F.col("level"), "n", "origin"))).alias("deeper"))
    return linked.select("message", F.coalesce("best.origin", "deeper.origin").alias("reply_to"), "n_linked")


def _threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, thread, depth) of every turn that answers another, by pointer jumping."""
    hops = materialize(links.select("conv_id", "turn", F.col("reply_to").alias("up"), F.lit(1).cast("long").alias("depth")))
    while True:
        above = hops.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        jumped = hops.join(above, ["conv_id", "up"], "left")
        step = materialize(jumped.select("conv_id", "turn", F.coalesce("_up", "up").alias("up"),
                                         (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), F.col("_up").isNotNull().alias("_moved")))
        hops = step.drop("_moved")
        if step.filter("_moved").isEmpty():
            return hops.withColumnRenamed("up", "thread")


def link_quotes(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """For every row conv_id, turn, role, content (text without quotes), n_passages, n_linked, reply_to, thread, depth."""
    named = df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    parsed = materialize(parse_messages(named).withColumn("message", F.xxhash64("conv_id", "turn", "role", "text")).drop("text"))
    quoting = parsed.filter(F.size("passages") > 0).dropDuplicates(["message"])
    links = materialize(_links(parsed.filter(F.size("passages") == 0).unionByName(quoting)))
    placed = parsed.filter(F.size("passages") > 0).join(links, "message")
    # Messages that share a turn answer together: the thread of a turn is that of its latest link.
    turns = placed.filter(F.col("reply_to").isNotNull()).groupBy("conv_id", "turn").agg(F.max("reply_to").alias("reply_to"))
    threads = _threads(turns)
    return (parsed.join(links, "message", "left").join(threads, ["conv_id", "turn"], "left")
            .select("conv_id", "turn", "role", F.col("own").alias("content"), F.size("passages").cast("long").alias("n_passages"),
                    F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "reply_to", F.coalesce("thread", "turn").alias("thread"),
                    F.coalesce("depth", F.lit(0)).alias("depth")))
