"""Merging of command sequences into workflows, and learning which ones are frequent."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.constants import WORKFLOW, workflow_patterns
from sessionloom.operators.ordered import Timeline, sessionwise
from sessionloom.operators.scale import broadcast_if_small, materialize, once, same_keys

TILE = 2_000


def border_shifts(pattern: Sequence[str]) -> list[int]:
    """Distances at which the pattern overlaps itself."""
    return [s for s in range(1, len(pattern)) if list(pattern[s:]) == list(pattern[:-s])]


def _look(rows: Timeline, column: str, steps: int, prefix: str, direction: int = 1) -> Timeline:
    """Columns ``prefix1..prefixN`` with the value of the following (or preceding) rows."""
    if not rows.block:
        pick = F.lead if direction > 0 else F.lag
        window = rows._window(())
        return rows.with_columns(**{
            f"{prefix}{k}": pick(column, k).over(window) for k in range(1, steps + 1)})
    source = column
    for k in range(1, steps + 1):
        rows = rows.neighbour(direction, **{f"{prefix}{k}": F.col(source)})
        source = f"{prefix}{k}"
    return rows


def greedy_cover(rows: Timeline, length: str, longest: int, chosen: str = "_chosen") -> Timeline:
    """Left-to-right choice of non-overlapping fits.

    ``length`` is the length of the fit that starts on the row (0 for none) and ``_pos`` its
    position.  A fit is chosen unless an earlier chosen one still covers its start.  What is
    carried along is only how many rows are still covered (0 .. longest - 1).  The fits are
    cut into tiles; each tile is folded once for every possible start state, the tiny
    per-tile maps are chained, and the tiles are folded again with their true start state.
    """
    rows = rows.of(once(rows.df))
    fits = rows.df.filter(F.col(length) > 0).select(
        rows.session, "_pos", F.col(length).alias("_len"), F.floor(F.col("_pos") / TILE).alias("_tile"))
    packed = fits.groupBy(rows.session, "_tile").agg(
        F.sort_array(F.collect_list(F.struct("_pos", "_len"))).alias("_fits"))

    def fold(start: Column) -> Column:
        # ``free`` is the first position not covered by a chosen fit.
        return F.aggregate(
            "_fits", F.struct(start.cast("bigint").alias("free"),
                              F.array().cast("array<bigint>").alias("picked")),
            lambda acc, fit: F.when(
                fit["_pos"] >= acc["free"],
                F.struct((fit["_pos"] + fit["_len"]).alias("free"),
                         F.array_append(acc["picked"], fit["_pos"]).alias("picked"))
            ).otherwise(acc))

    def free_after(start: Column) -> Column:
        return F.aggregate("_fits", start.cast("bigint"), lambda free, fit: F.when(
            fit["_pos"] >= free, fit["_pos"] + fit["_len"]).otherwise(free))

    base = F.col("_tile") * TILE
    # Map of this tile: rows covered at its start -> rows covered at the start of the next.
    maps = packed.select(rows.session, "_tile", F.array(*[
        F.greatest(free_after(base + s) - (base + TILE), F.lit(0)) for s in range(longest)]).alias("_map"))
    states = _chain_maps(materialize(maps), rows.session, longest)
    picked = packed.alias("p").join(
        states.alias("s"), same_keys("p", "s", [rows.session, "_tile"])
    ).select(F.col(f"p.{rows.session}"), F.explode(
        fold(F.col("p._tile") * TILE + F.col("s._state"))["picked"]).alias("_pos"))
    marked = rows.df.alias("r").join(
        picked.withColumn(chosen, F.lit(True)).alias("p"),
        same_keys("r", "p", [rows.session, "_pos"]), "left")
    return rows.of(marked.select("r.*", F.coalesce(F.col(f"p.{chosen}"), F.lit(False)).alias(chosen)))


def _chain_maps(maps: DataFrame, session: str, longest: int) -> DataFrame:
    """State at the start of every tile, from the state maps of all tiles.

    Up to ``TILE`` maps are chained in one array; longer sessions chain the maps of whole
    groups of tiles first, so no array grows with the session.
    """
    packed = maps.withColumn("_group", F.floor(F.col("_tile") / TILE)).groupBy(session, "_group").agg(
        F.sort_array(F.collect_list(F.struct("_tile", "_map"))).alias("_maps"))
    first, last = F.col("_group") * TILE - 1, F.col("_group") * TILE + (TILE - 1)

    def walk(state: Column) -> Column:
        return F.aggregate("_maps", F.struct(
            first.alias("tile"), state.cast("bigint").alias("state"),
            F.array().cast("array<struct<tile:bigint,state:bigint>>").alias("seen")), _advance)

    def leave(state: Column) -> Column:
        end = F.aggregate("_maps", F.struct(first.alias("tile"), state.cast("bigint").alias("state")),
                          lambda acc, m: F.struct(m["_tile"].alias("tile"), _through(acc, m).alias("state")))
        return F.when(end["tile"] == last, end["state"]).otherwise(F.lit(0).cast("bigint"))

    most = maps.agg(F.max("_tile")).first()[0]
    if most is None or most < TILE:
        entered = packed.withColumn("_state", F.lit(0).cast("bigint"))
    else:
        groups = packed.select(session, F.col("_group").alias("_tile"), F.array(*[
            leave(F.lit(s)) for s in range(longest)]).alias("_map"))
        starts = _chain_maps(materialize(groups), session, longest)
        entered = packed.alias("p").join(
            starts.withColumnRenamed("_tile", "_group").alias("s"),
            same_keys("p", "s", [session, "_group"])).select("p.*", "s._state")
    return entered.select(session, F.explode(walk(F.col("_state"))["seen"]).alias("_s")).select(
        session, F.col("_s.tile").alias("_tile"), F.col("_s.state").alias("_state"))


def _enter(acc: Column, entry: Column) -> Column:
    """State on entering a tile; after a gap between tiles nothing is covered any more."""
    return F.when(entry["_tile"] == acc["tile"] + 1, acc["state"]).otherwise(F.lit(0).cast("bigint"))


def _through(acc: Column, entry: Column) -> Column:
    return F.get(entry["_map"], _enter(acc, entry).cast("int")).cast("bigint")


def _advance(acc: Column, entry: Column) -> Column:
    return F.struct(
        entry["_tile"].alias("tile"), _through(acc, entry).alias("state"),
        F.array_append(acc["seen"], F.struct(
            entry["_tile"].alias("tile"), _enter(acc, entry).alias("state"))).alias("seen"))


def _fits(column: str, prefix: str, pattern: Sequence[str]) -> Column:
    hit = F.col(column) == pattern[0]
    for k, part in enumerate(pattern[1:], 1):
        hit = hit & (F.col(f"{prefix}{k}") == part)
    return F.coalesce(hit, F.lit(False))


def _mark_pattern(rows: Timeline, item: str, pattern: Sequence[str]) -> Timeline:
    """``_start`` on the rows where a merged occurrence of the pattern begins."""
    size = len(pattern)
    rows = _look(rows, item, size - 1, "_ahead")
    rows = rows.with_columns(_fit=_fits(item, "_ahead", pattern)).drop(
        *[f"_ahead{k}" for k in range(1, size)])
    shifts = border_shifts(pattern)
    if not shifts:
        return rows.with_columns(_start=F.col("_fit")).drop("_fit")
    if shifts == [shifts[0] * k for k in range(1, len(shifts) + 1)] and not rows.block:
        # Overlapping fits form chains with one distance; greedy keeps every n-th of them.
        every = -(-size // shifts[0])
        window = Window.partitionBy(rows.session, "_fit").orderBy(*rows.order)
        ordered = Window.partitionBy(rows.session).orderBy(*rows.order)
        gap = F.col("_at") - F.lag("_at").over(window)
        df = (rows.df.withColumn("_at", F.row_number().over(ordered))
              .withColumn("_new", F.when(F.coalesce(gap < size, F.lit(False)), 0).otherwise(1))
              .withColumn("_chain", F.sum("_new").over(window))
              .withColumn("_nth", F.row_number().over(
                  Window.partitionBy(rows.session, "_fit", "_chain").orderBy(*rows.order)))
              .withColumn("_start", F.col("_fit") & (F.pmod(F.col("_nth") - 1, F.lit(every)) == 0))
              .drop("_at", "_new", "_chain", "_nth", "_fit"))
        return rows.of(df)
    rows = rows.numbered("_pos").with_columns(_len=F.when(F.col("_fit"), size).otherwise(0))
    rows = greedy_cover(rows, "_len", size, "_start")
    return rows.drop("_pos", "_len", "_fit")


def merge_workflows_step(rows: Timeline, item: str = "item",
                         patterns: Sequence[Sequence[str]] | None = None,
                         parts: str = "parts") -> Timeline:
    """Replace each occurrence of a pattern by one row whose item is the comma-joined pattern.

    Patterns are applied one after another, each from left to right without overlap; later
    patterns see merged items.  ``parts`` (an array column) of merged rows is concatenated.
    """
    for pattern in patterns if patterns is not None else workflow_patterns():
        size = len(pattern)
        rows = _mark_pattern(rows, item, pattern)
        rows = _look(rows, parts, size - 1, "_more")
        # A row is swallowed if an occurrence starts on one of the rows just before it.
        rows = _look(rows, "_start", size - 1, "_s", -1)
        swallowed = F.lit(False)
        for k in range(1, size):
            swallowed = swallowed | F.coalesce(F.col(f"_s{k}"), F.lit(False))
        more = [F.col(f"_more{k}") for k in range(1, size)]
        rows = rows.filter(~swallowed).with_columns(**{
            item: F.when(F.col("_start"), F.lit(",".join(pattern))).otherwise(F.col(item)),
            parts: F.when(F.col("_start"), F.concat(F.col(parts), *more)).otherwise(F.col(parts))})
        rows = rows.drop("_start", *[f"_more{k}" for k in range(1, size)],
                         *[f"_s{k}" for k in range(1, size)])
    return rows


PART_COLUMNS = ("ts", "cat", "message", "message_eng", "message_content", "localization_id")
_JOINED = ("message", "message_eng", "message_content", "localization_id")


def workflow_rows_step(rows: Timeline, patterns: Sequence[Sequence[str]] | None = None,
                       columns: Sequence[str] = PART_COLUMNS) -> Timeline:
    """Merge workflows in a full log.

    A merged row has the time of its last part, category ``workflow``, merge count 1 and
    its texts joined by ``", "``; other rows stay as they are.
    """
    rows = rows.with_columns(
        _token=F.col("message_content"), _parts=F.array(F.struct(*columns)))
    rows = merge_workflows_step(rows, "_token", patterns, "_parts")
    merged = F.size("_parts") > 1
    joined = {c: F.when(merged, F.array_join(F.col("_parts")[c], ", "))
              .otherwise(F.col(c)) for c in _JOINED if c in columns}
    return rows.with_columns(
        **joined, ts=F.element_at("_parts", -1)["ts"],
        cat=F.when(merged, WORKFLOW).otherwise(F.col("cat")),
        merge_count=F.when(merged, F.lit(1).cast("bigint")).otherwise(F.col("merge_count").cast("bigint"))
    ).drop("_token", "_parts")


def merge_first_match_step(rows: Timeline, item: str = "item",
                           patterns: Sequence[Sequence[str]] | None = None) -> Timeline:
    """One pass: at each position the first listed pattern that fits is merged.

    The merged row is the row of the last part with the item joined by ``", "`` and
    category ``workflow``.
    """
    patterns = patterns if patterns is not None else workflow_patterns()
    longest = max(len(p) for p in patterns)
    rows = _look(rows.numbered("_pos"), item, longest - 1, "_ahead")
    length, name = F.lit(0), F.lit(None).cast("string")
    for pattern in reversed(list(patterns)):
        hit = _fits(item, "_ahead", pattern)
        length = F.when(hit, len(pattern)).otherwise(length)
        name = F.when(hit, F.lit(", ".join(pattern))).otherwise(name)
    rows = rows.with_columns(_len=length, _name=name).drop(
        *[f"_ahead{k}" for k in range(1, longest)])
    rows = greedy_cover(rows, "_len", longest, "_start")
    # Each row looks back for the occurrence that covers it.
    rows = rows.with_columns(_b0=F.struct(
        F.when(F.col("_start"), F.col("_len")).otherwise(0).alias("len"), F.col("_name").alias("name")))
    rows = _look(rows, "_b0", longest - 1, "_b", -1)
    inside, ends = F.lit(False), F.lit(None).cast("string")
    for k in range(longest):
        size = F.coalesce(F.col(f"_b{k}.len"), F.lit(0))
        inside = inside | (size > k + 1)
        ends = F.when((size == k + 1) & (size > 0), F.col(f"_b{k}.name")).otherwise(ends)
    rows = rows.with_columns(_inside=inside, _ends=ends)
    rows = rows.filter(~F.col("_inside")).with_columns(**{
        item: F.coalesce(F.col("_ends"), F.col(item)),
        "cat": F.when(F.col("_ends").isNotNull(), WORKFLOW).otherwise(F.col("cat"))})
    return rows.drop("_pos", "_len", "_name", "_start", "_inside", "_ends",
                     *[f"_b{k}" for k in range(longest)])


def merge_workflows(df: DataFrame, item: str = "item",
                    patterns: Sequence[Sequence[str]] | None = None, session: str = "session",
                    order: Sequence[str] = ("ts", "seq"), limit: int | None = None,
                    source: DataFrame | None = None) -> DataFrame:
    """``merge_workflows_step`` on a DataFrame; the parts of a row are kept in ``parts``."""
    parts = df.withColumn("parts", F.array(F.col(item)))
    return sessionwise(parts, partial(merge_workflows_step, item=item, patterns=patterns),
                       session, order, limit, source)


def workflow_rows(df: DataFrame, patterns: Sequence[Sequence[str]] | None = None,
                  session: str = "session", order: Sequence[str] = ("ts", "seq"),
                  limit: int | None = None, source: DataFrame | None = None) -> DataFrame:
    return sessionwise(df, partial(workflow_rows_step, patterns=patterns), session, order, limit, source)


def merge_first_match(df: DataFrame, item: str = "item",
                      patterns: Sequence[Sequence[str]] | None = None, session: str = "session",
                      order: Sequence[str] = ("ts", "seq"), limit: int | None = None,
                      source: DataFrame | None = None) -> DataFrame:
    return sessionwise(df, partial(merge_first_match_step, item=item, patterns=patterns),
                       session, order, limit, source)


def learn_merges(df: DataFrame, rounds: int = 10, item: str = "item", min_count: int = 2,
                 session: str = "session", order: Sequence[str] = ("ts", "seq"),
                 separator: str = ",", limit: int | None = None, sizes: list[int] | None = None) -> list[tuple[list[str], int]]:
    """Learn frequent workflows by byte-pair merging of neighbouring items.

    Each round merges the most frequent pair (ties by name) and goes on with the merged sequence.  Pair counts
    are kept per session: the sessions that hold the pair are looked up there, only they are
    merged, written and counted anew, and the totals are moved by the difference.  Only the winning pair
    reaches the driver.  ``sizes`` takes the number of rows that each round merges.
    """
    def counted(rows: DataFrame) -> DataFrame:
        paired = sessionwise(rows, lambda t: t.neighbour(1, _next=F.col(item)), session, order, limit)
        return materialize(paired.filter(F.col("_next").isNotNull())
                           .groupBy(F.col(session).alias("_s"), F.col(item).alias("left"), F.col("_next").alias("right")).agg(F.count(F.lit(1)).alias("n")))

    def total(counts: DataFrame) -> DataFrame:
        return materialize(counts.groupBy("left", "right").agg(F.sum("n").alias("n")).filter("n > 0"))

    def every(parts: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, parts)

    def held(part: DataFrame, key: str, sessions: DataFrame) -> DataFrame:
        return part.alias("p").join(sessions.alias("s"), F.col(f"p.`{key}`").eqNullSafe(F.col("s._s")), "left_semi")

    # Layer 0 is the input; every round adds one for the sessions it changes.
    first = once(df.select(session, *order, item))
    layers = [(first, counted(first))]
    totals = total(layers[0][1])
    changed = []    # (session, layer) of the sessions of each later layer
    learned: list[tuple[list[str], int]] = []
    for number in range(1, rounds + 1):
        best = totals.orderBy(F.desc("n"), "left", "right").limit(1).first()
        if best is None or best["n"] < min_count:
            break
        pair = [best["left"], best["right"]]
        learned.append((separator.join(pair).split(separator), best["n"]))
        if number == rounds:
            break
        holders = every([counts.filter((F.col("left") == pair[0]) & (F.col("right") == pair[1])).select("_s", F.lit(i).alias("_layer"))
                         for i, (_, counts) in enumerate(layers)])
        if changed:  # of a session only its newest layer counts
            newest = every(changed).groupBy("_s").agg(F.max("_layer").alias("_new"))
            holders = (holders.alias("h").join(newest.alias("n"), same_keys("h", "n", ["_s"]), "left")
                       .filter(F.col("_layer") == F.coalesce("_new", F.lit(0))).select("h._s", "_layer"))
        holders = materialize(holders)
        of_layer = [broadcast_if_small(holders.filter(F.col("_layer") == i).select("_s")) for i in range(len(layers))]
        rows = materialize(every([held(rows, session, keys) for (rows, _), keys in zip(layers, of_layer)]))
        if sizes is not None:
            sizes.append(rows.count())
        merged = materialize(merge_workflows(rows, item, [pair], session, order, limit).select(first.columns))
        counts = counted(merged)
        before = every([held(counts, "_s", keys) for (_, counts), keys in zip(layers, of_layer)])
        totals = total(every([totals, before.select("left", "right", (-F.col("n")).alias("n")), counts.select("left", "right", "n")]))
        layers.append((merged, counts))
        changed.append(holders.select("_s", F.lit(number).alias("_layer")))
    return learned
