"""Operators on the ordered rows of a session.

Each comes in two forms: ``..._step(rows: Timeline, ...)`` composes with others on one
session partitioning, and the plain name takes and returns a DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.hashing import uniform_int
from sessionloom.functions.messages import extract_command
from sessionloom.operators.ordered import Timeline, sessionwise

_UNDO = "Undo Event: "
_UNDO_REMOVE = "Undo and Remove Action: "


def _pair_brackets(rows: Timeline, push: Column, pop: Column, keys: Sequence[str],
                   level: str) -> Timeline:
    """Level of every push and of every pop that finds a push; null on all other rows.

    With +1 for a push and -1 for a pop, the stack depth is the running sum minus its
    running minimum below zero.  A pop finds a push if the depth before it is positive.
    On one level pushes and pops alternate, so partners are neighbours there.
    """
    rows = rows.with_columns(_x=F.when(push, 1).when(pop, -1).otherwise(0))
    rows = rows.running(keys, _sum=("sum", F.col("_x")))
    rows = rows.running(keys, inclusive=False, _low=("min", F.col("_sum")))
    before = F.col("_sum") - F.col("_x") - F.least(F.lit(0), F.col("_low"))
    rows = rows.with_columns(**{
        level: F.when(push, before + 1).when(pop & (before > 0), before)})
    return rows.drop("_x", "_sum", "_low")


def undo_redo_step(rows: Timeline, message: str = "message") -> Timeline:
    """Remove undone events, restore redone ones, and drop all undo and redo rows.

    An undo takes back the latest event with the same command; a redo restores the latest
    one undone (not one undone-and-removed).  A restored event cannot be undone again.
    """
    text = F.col(message)
    redo = text.startswith("Redo Event:")
    undo = text.startswith(_UNDO)
    remove = text.startswith(_UNDO_REMOVE)
    rows = rows.filter(F.col(rows.session).isNotNull())
    if not rows.block:
        # One shuffle by session serves these windows and all session steps that follow;
        # left alone, Spark would shuffle by (session, command) and then again by session.
        rows = rows.of(rows.df.repartition(rows.session))
    rows = rows.with_columns(
        _cmd=F.when(redo | undo | remove | text.startswith("End Event:"),
                    F.trim(extract_command(text))),
        _kind=F.when(text.startswith("End Event:"), "event").when(undo, "undo")
        .when(remove, "remove").when(redo, "redo"))
    known = F.col("_cmd").isNotNull()
    kind = F.col("_kind")
    # Round one: events and the undos that hit them.
    rows = _pair_brackets(rows, known & (kind == "event"),
                          known & kind.isin("undo", "remove"), ["_cmd"], "_level")
    # Round two: undos that hit something, and the redos that restore it.
    hit = F.col("_level").isNotNull()
    rows = _pair_brackets(rows, known & (kind == "undo") & hit,
                          known & (kind == "redo"), ["_cmd"], "_level2")
    rows = rows.neighbour(1, ["_cmd", "_level2"], _next2=kind)
    rows = rows.with_columns(_restored=F.col("_level2").isNotNull() & (kind == "undo")
                             & F.coalesce(F.col("_next2") == "redo", F.lit(False)))
    rows = rows.neighbour(1, ["_cmd", "_level"], _next=kind, _next_restored=F.col("_restored"))
    gone = (kind == "event") & hit & F.coalesce(
        F.col("_next").isin("undo", "remove") & ~F.col("_next_restored"), F.lit(False))
    keep = kind.isNull() | ((kind == "event") & ~gone)
    return rows.filter(keep).drop("_cmd", "_kind", "_level", "_level2", "_next2", "_restored",
                                  "_next", "_next_restored")


def collapse_runs_step(rows: Timeline, item: str = "item", count: str = "merge_count") -> Timeline:
    """Keep the last row of each run of equal items with the length of the run.

    Null equals nothing.  The run length is the distance between kept positions, so no
    run is ever gathered.
    """
    rows = rows.numbered("_pos").neighbour(1, _item_next=F.col(item))
    rows = rows.filter(~F.coalesce(F.col(item) == F.col("_item_next"), F.lit(False)))
    rows = rows.neighbour(-1, _pos_last=F.col("_pos"))
    rows = rows.with_columns(**{
        count: F.col("_pos") - F.coalesce(F.col("_pos_last"), F.lit(0).cast("bigint"))})
    return rows.drop("_pos", "_item_next", "_pos_last")


def drop_repeats_step(rows: Timeline, item: str = "item") -> Timeline:
    """Keep the first row of each run of equal items."""
    rows = rows.neighbour(-1, _item_last=F.col(item))
    return rows.filter(~F.coalesce(F.col(item) == F.col("_item_last"), F.lit(False))).drop("_item_last")


def time_intervals_step(rows: Timeline, ts: str = "ts", out: str = "timestamp_interval") -> Timeline:
    """Time since the previous row of the session; 0 on the first row."""
    rows = rows.neighbour(-1, _ts_last=F.col(ts))
    return rows.with_columns(**{
        out: F.coalesce(F.col(ts) - F.col("_ts_last"), F.lit(0))}).drop("_ts_last")


def split_fixed_step(rows: Timeline, min_items: int = 5, max_items: int = 200,
                     out: str = "session_part") -> Timeline:
    """Cut sessions into chunks of ``max_items``; a rest below ``min_items`` joins the last
    chunk; a session shorter than ``min_items`` keeps its own id."""
    rows = rows.numbered("_pos").totals(_rows=("count", F.lit(1)))
    size = F.col("_rows")
    chunks = (F.floor(size / max_items)
              + F.when(F.pmod(size, F.lit(max_items)) >= min_items, 1).otherwise(0))
    chunk = F.least(F.ceil(F.col("_pos") / max_items), chunks)
    own = F.col(rows.session).cast("string")
    return rows.with_columns(**{
        out: F.when(size < min_items, own).otherwise(
            F.concat_ws("-", own, chunk.cast("string")))}).drop("_pos", "_rows")


def _runner(step):
    def run(df: DataFrame, *args, session: str = "session",
            order: Sequence[str] = ("ts", "seq"), limit: int | None = None,
            source: DataFrame | None = None, **options) -> DataFrame:
        return sessionwise(df, lambda rows: step(rows, *args, **options), session, order, limit, source)
    run.__doc__ = step.__doc__
    run.__name__ = step.__name__.removesuffix("_step")
    return run


undo_redo = _runner(undo_redo_step)
collapse_runs = _runner(collapse_runs_step)
drop_repeats = _runner(drop_repeats_step)
time_intervals = _runner(time_intervals_step)
split_fixed = _runner(split_fixed_step)


def random_chunks(sizes: DataFrame, min_items: int, max_items: int, seed: int = 1,
                  session: str = "session", rows: str = "rows") -> DataFrame:
    """First position and number of every random chunk, from session lengths alone.

    While at least ``min_items`` rows are left, a chunk takes all of them if they fit into
    ``max_items`` or if the rest would be too short, else a uniform number of rows.
    """
    take_all = max(max_items, 2 * min_items - 1)
    # Candidate chunk numbers in two steps, so no single array grows with a long session.
    page = 10_000
    most = F.floor(F.col(rows) / min_items)
    numbers = (sizes.filter(F.col(rows) >= min_items)
               .withColumn("_page", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(most / page))))
               .withColumn("chunk", F.explode(F.sequence(
                   F.col("_page") * page + 1,
                   F.least((F.col("_page") + 1) * page, most + 1)))))
    drawn = numbers.withColumn("_size", uniform_int(min_items, max_items, session_text(session),
                                                    F.col("chunk"), seed))
    starts = sessionwise(
        drawn, lambda t: t.running(inclusive=False, _start=("sum", F.col("_size")))
        .with_columns(_start=F.coalesce(F.col("_start"), F.lit(0).cast("bigint")))
        .neighbour(-1, _start_last=F.col("_start")),
        session, ("chunk",))
    left = F.col(rows) - F.col("_start")
    left_last = F.col(rows) - F.col("_start_last")
    return starts.filter((left >= min_items) & (F.col("_start_last").isNull() | (left_last > take_all))
                         ).select(session, "chunk", (F.col("_start") + 1).alias("first_pos"))


def session_text(session: str) -> Column:
    return F.col(session).cast("string")


def split_random(df: DataFrame, min_items: int = 50, max_items: int = 100, seed: int = 1,
                 session: str = "session", order: Sequence[str] = ("ts", "seq"),
                 out: str = "session_part", limit: int | None = None) -> DataFrame:
    """Cut sessions into random chunks (see ``random_chunks``); a rest joins the last chunk."""
    sizes = df.groupBy(session).agg(F.count(F.lit(1)).alias("rows"))
    chunks = random_chunks(sizes, min_items, max_items, seed, session)
    numbered = sessionwise(df, lambda t: t.numbered("_pos"), session, order, limit)
    # Chunk heads are laid between the rows and the latest head is carried forward.
    rows = numbered.withColumns({"_head": F.lit(1), "_chunk": F.lit(None).cast("bigint")})
    heads = chunks.select(session, F.col("first_pos").alias("_pos"), F.lit(0).alias("_head"),
                          F.col("chunk").cast("bigint").alias("_chunk"))
    mixed = rows.unionByName(heads, allowMissingColumns=True)
    done = sessionwise(mixed, lambda t: t.running(_chunk_now=("max", F.col("_chunk"))),
                       session, ("_pos", "_head"), limit)
    own = session_text(session)
    return (done.filter(F.col("_head") == 1)
            .withColumn(out, F.when(F.col("_chunk_now").isNull(), own).otherwise(
                F.concat_ws("-", own, F.col("_chunk_now").cast("string"))))
            .drop("_pos", "_head", "_chunk", "_chunk_now"))


def list_tail(values, n: int = 200) -> Column:
    """The last ``n`` elements of an array column."""
    values = F.col(values) if isinstance(values, str) else values
    return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), n)


def groupby_lists(df: DataFrame, session: str = "session", order: Sequence[str] = ("ts", "seq"),
                  lists: Sequence[str] = (), firsts: Sequence[str] = (),
                  counts: Sequence[str] = (), first: int | None = None, last: int | None = None,
                  piece_rows: int = 100_000) -> DataFrame:
    """Ordered lists ``<col>-list`` with ``<col>-count`` and ``<col>-first``, keyed by (session, piece).

    ``first`` / ``last`` keep only that many rows in the lists; they are cut by rank before
    anything is collected, and Spark applies that rank per task before the shuffle.
    Without either, the lists of a session come in pieces of ``piece_rows`` rows, numbered from
    0, at every size: a session of up to ``piece_rows`` rows has piece 0 only.  What follows
    must keep ``piece`` in its key; no list grows without bound.
    """
    columns = list(dict.fromkeys(lists))
    # Counts and firsts come from combinable aggregates over all rows.
    facts = df.groupBy(session).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(c).alias(f"{c}-count") for c in counts],
        *[F.min_by(c, F.struct(*order)).alias(f"{c}-first") for c in firsts])
    rows = df.select(session, *dict.fromkeys([*order, *columns]))
    if first or last:
        window = Window.partitionBy(session).orderBy(
            *[F.col(o) if first else F.desc(o) for o in order])
        rows = rows.withColumn("_rank", F.row_number().over(window)).filter(
            F.col("_rank") <= (first or last)).withColumn("piece", F.lit(0).cast("bigint"))
    else:
        rows = sessionwise(rows, lambda t: t.numbered("_rank"), session, order).withColumn(
            "piece", F.floor((F.col("_rank") - 1) / piece_rows))
    packed = rows.groupBy(session, "piece").agg(F.sort_array(F.collect_list(
        F.struct(*order, *[F.col(c).alias(f"_v_{i}") for i, c in enumerate(columns)]))).alias("_list"))
    out = packed.select(session, "piece", *[
        F.col("_list")[f"_v_{i}"].alias(f"{c}-list")
        for i, c in enumerate(columns)])
    return out.join(facts, session).drop("_rows") if counts or firsts else out


def aggregate_sessions(df: DataFrame, session: str, items: Sequence[str], firsts: Sequence[str] = (),
                       order: Sequence[str] = ("ts", "seq"), maximum_length: int = 20,
                       minimum_length: int = 2) -> DataFrame:
    """Session rows with lists trimmed to the first ``maximum_length`` elements; sessions
    with a shorter list than ``minimum_length`` are dropped."""
    rows = groupby_lists(df, session, order, items, firsts, first=maximum_length)
    renamed = rows.drop("piece").withColumnsRenamed({f"{c}-list": f"{c}-list_trim" for c in items})
    return renamed.filter(F.size(f"{items[0]}-list_trim") >= minimum_length)
