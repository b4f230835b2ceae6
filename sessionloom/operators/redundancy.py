"""Mining of command/event pairs, and removal of the events a command triggers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom import constants as C
from sessionloom.operators.ordered import sessionwise, with_halo
from sessionloom.operators.pairs import plain_strings
from sessionloom.operators.scale import broadcast_if_small, hot_groups, materialize, once, same_keys, small_table

TILE = 20_000
SCAN_ROWS = 250_000   # rows that a task of the scan in Python should not pass by much


def label_rows(df: DataFrame, session: str = "session", order=("ts", "seq"), out: str = "label",
               limit: int | None = None, source: DataFrame | None = None) -> DataFrame:
    """0-based position in the session, taken before later filters leave gaps."""
    numbered = sessionwise(df, lambda t: t.numbered(out), session, order, limit, source)
    return numbered.withColumn(out, F.col(out) - 1)


def following_low_level(df: DataFrame, before: int = 10, after: int = 10, n_next: int = 3,
                        n_prev: int = 1, session: str = "session", label: str = "label",
                        ts: str = "ts", cat: str = "cat", message: str = "message_eng",
                        out: str = "events", tile: int = TILE) -> DataFrame:
    """Low-level events near each high-level command.

    Among rows whose label lies within ``before``/``after`` of the command: the first
    ``n_next`` events not earlier than it, and the first ``n_prev`` events before it.
    Sessions are cut into tiles that overlap by the window, so none is too large.
    """
    rows = with_halo(df, label, tile, before, after)
    window = Window.partitionBy(session, "_tile").orderBy(label).rangeBetween(-before, after)
    near = F.collect_list(F.when(F.col(cat) == C.LOW_LEVEL, F.struct(ts, message))).over(window)
    found = (rows.withColumn("_near", near)
             .filter(F.col("_home") & F.col(cat).isin(list(C.HIGH_LEVEL))))
    later = F.slice(F.filter("_near", lambda e: e[ts] >= F.col(ts)), 1, n_next)
    earlier = F.slice(F.filter("_near", lambda e: e[ts] < F.col(ts)), 1, n_prev)
    return found.withColumn(out, F.transform(F.concat(later, earlier), lambda e: e[message])
                            ).drop("_near", "_tile", "_home")


def pair_support(commands: DataFrame, message: str = "message_eng", events: str = "events") -> DataFrame:
    """Support of commands (``sup1``) and of command/event pairs (``sup2``).

    An event counts once per occurrence of the command.  One pass: a null event stands for
    the command itself.
    """
    marked = F.concat(F.array(F.lit(None).cast("string")), F.array_distinct(events))
    counts = materialize(
        commands.select(F.col(message).alias("command"), F.explode(marked).alias("event"))
        .groupBy("command", "event").agg(F.count(F.lit(1)).alias("n")))
    single = counts.filter(F.col("event").isNull()).select("command", F.col("n").alias("sup1"))
    pairs = counts.filter(F.col("event").isNotNull()).select("command", "event", F.col("n").alias("sup2"))
    return pairs.join(broadcast_if_small(single), "command").select("command", "event", "sup1", "sup2")


def pair_confidence(support: DataFrame, minimum: float = C.PAIR_MIN_CONFIDENCE,
                    generic: Iterable[str] = C.GENERIC_EVENTS,
                    rare_support: int = C.PAIR_RARE_SUPPORT,
                    rare_confidence: float = C.PAIR_RARE_CONFIDENCE) -> DataFrame:
    """Pairs that count as triggered: confident enough, more so for rare commands.

    ``support`` may hold partial counts of several files (column ``file_index``); ``sup1``
    is then added up once per file.
    """
    if "file_index" in support.columns:
        commands = (support.groupBy("command", "file_index").agg(F.max("sup1").alias("sup1"))
                    .groupBy("command").agg(F.sum("sup1").alias("sup1_group_sum")))
        sums = support.groupBy("command", "event").agg(F.sum("sup2").alias("sup2_sum"))
        joined = sums.join(small_table(commands), "command")
    else:
        joined = support.select("command", "event", F.col("sup1").alias("sup1_group_sum"),
                                F.col("sup2").alias("sup2_sum"))
    confidence = F.col("sup2_sum") / F.col("sup1_group_sum")
    return (joined.withColumn("confidence", confidence)
            .filter(F.col("confidence") > minimum)
            .filter(~F.col("event").isin(list(generic)))
            .filter((F.col("sup1_group_sum") >= rare_support) | (F.col("confidence") > rare_confidence)))


class _Open:
    """Places of events of which some are gone; a run of gone ones is passed over at once, however often it is met."""

    def __init__(self, gone: np.ndarray):
        self.next = (np.arange(len(gone) + 1) + np.append(gone, False)).tolist()

    def close(self, at: int) -> None:
        self.next[at] = at + 1

    def first(self, at: int, stop: int, n: int) -> list[int]:
        """The first ``n`` open places from ``at`` to ``stop`` (exclusive)."""
        following, found = self.next, []
        while len(found) < n:
            while at != following[at]:
                following[at] = following[following[at]]
                at = following[at]
            if at >= stop:
                break
            found.append(at)
            at += 1
        return found


def _dropped_in(rows: pd.DataFrame, before: int | None, after: int | None, n_next: int,
                n_prev: int) -> list[int]:
    """Backward scan over the commands of one tile: the labels they drop."""
    cat = rows["cat"].to_numpy()
    low = cat == C.LOW_LEVEL
    labels, times = rows["label"].to_numpy(), rows["ts"].to_numpy()
    e_label, e_ts, e_text = labels[low], times[low], rows["text"].to_numpy()[low]
    gone = rows["gone"].to_numpy().astype(bool)[low]
    known = rows["allowed"].to_numpy()
    # Mostly labels go by time: then a command's events follow each other, and none of the others is looked at.
    rising = not pd.isnull(e_ts).any() and bool((e_ts[1:] >= e_ts[:-1]).all())
    still = _Open(gone)
    dropped: list[int] = []
    for at in np.flatnonzero(rows["home"].to_numpy().astype(bool) & ~low)[::-1]:
        label, ts, allowed = labels[at], times[at], known[at]
        lo = 0 if before is None else int(np.searchsorted(e_label, label - before, "left"))
        hi = len(e_label) if after is None else int(np.searchsorted(e_label, label + after, "right"))
        if rising:
            cut = lo + int(np.searchsorted(e_ts[lo:hi], ts, "left"))
            near = [*still.first(cut, hi, n_next), *still.first(lo, cut, n_prev)]
        else:
            open_ = ~gone[lo:hi]
            later = e_ts[lo:hi] >= ts
            near = [lo + int(i) for i in (*np.flatnonzero(open_ & later)[:n_next], *np.flatnonzero(open_ & ~later)[:n_prev])]
        if not near:
            dropped.append(int(label))
        elif allowed is not None:
            match = next((i for i in near if e_text[i] in allowed), None)
            if match is None:
                dropped.append(int(label))
            else:
                gone[match] = True
                still.close(match)
                dropped.append(int(e_label[match]))
    return dropped


def _scan_tiles(rows: DataFrame, schema: str, partitions: int, *view) -> DataFrame:
    """``_dropped_in`` for every (session, tile).

    Tiles are sorted inside the partitions and streamed, many to a batch, so short sessions
    do not pay for a call each; at most one tile is held over from batch to batch.  The
    work per row is in Python, so the number of partitions follows the rows, not their bytes.
    """
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done(frame: pd.DataFrame) -> pd.DataFrame:
            out = []
            keys = list(zip(frame["_s"].to_numpy(), frame["_tile"].to_numpy()))
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            for start, stop in zip(starts, [*starts[1:], len(keys)]):
                out += [(*keys[start], label) for label in _dropped_in(frame.iloc[start:stop], *view)]
            return plain_strings(pd.DataFrame(out, columns=["_s", "_tile", "label"]))

        for batch in batches:
            if not len(batch):
                continue
            last = (batch["_s"].iloc[-1], batch["_tile"].iloc[-1])
            open_rows = ((batch["_s"] == last[0]) & (batch["_tile"] == last[1])).to_numpy()
            if held and not open_rows.all():
                yield done(pd.concat([*held, batch[~open_rows]]))
                held = []
            elif not open_rows.all():
                yield done(batch[~open_rows])
            elif held and (held[0]["_s"].iloc[0], held[0]["_tile"].iloc[0]) != last:
                yield done(pd.concat(held))
                held = []
            held.append(batch[open_rows])
        if held:
            yield done(pd.concat(held))

    return (rows.repartition(partitions, "_s", "_tile").sortWithinPartitions("_s", "_tile", "label")
            .mapInPandas(scan, schema))


def dropped_labels(df: DataFrame, pairs: DataFrame, before: int | None = 10, after: int | None = 30,
                   n_next: int = 5, n_prev: int = 1, session: str = "session", label: str = "label",
                   ts: str = "ts", cat: str = "cat", message: str = "message_eng",
                   tile: int = TILE) -> DataFrame:
    """(session, label) of the rows that ``replace_low_level`` removes.

    Dropped events feed later decisions, so commands are visited from last to first.  A
    decision looks at most ``after`` labels ahead, so tiles of a session run side by side:
    first as if the next tile had dropped nothing, then again where the next tile's drops
    near the border turn out otherwise, until nothing changes.  The last tile is right
    at once and each round makes one more right, mostly all of them after two or three.
    """
    allowed = pairs.groupBy(F.col("command").alias("_command")).agg(
        F.collect_set("event").alias("allowed"))
    df = once(df)
    # Counted from the files' footers.
    partitions = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // SCAN_ROWS))
    rows = df.select(F.col(session).alias("_s"), F.col(label).alias("label"), F.col(ts).alias("ts"),
                     F.col(cat).alias("cat"), F.col(message).alias("text"))
    rows = rows.filter(F.col("cat").isin(C.LOW_LEVEL, *C.HIGH_LEVEL)).join(
        small_table(allowed),
        (F.col("text") == F.col("_command")) & F.col("cat").isin(list(C.HIGH_LEVEL)), "left"
    ).drop("_command")
    schema = f"_s {rows.schema['_s'].dataType.simpleString()}, _tile bigint, label bigint"
    view = (before, after, n_next, n_prev)
    if before is None or after is None:
        gone = _dropped_without_window(rows, schema, partitions, n_next, n_prev, tile)
        return gone.select(F.col("_s").alias(session), F.col("label").alias(label))
    tiled = with_halo(rows, "label", tile, before, after, "_tile", "home")

    def decide(source: DataFrame, incoming: DataFrame | None) -> DataFrame:
        if incoming is None:
            marked = source.withColumn("gone", F.lit(False))
        else:
            marked = source.alias("r").join(
                incoming.withColumn("gone", F.lit(True)).alias("g"),
                same_keys("r", "g", ["_s", "_tile", "label"]), "left"
            ).select("r.*", F.coalesce(F.col("g.gone"), F.lit(False)).alias("gone"))
        return materialize(_scan_tiles(marked, schema, partitions, *view))

    def border(decisions: DataFrame) -> DataFrame:
        """What each tile is told by the next one: its drops close to the border."""
        edge = F.col("_tile") * tile
        return decisions.filter((F.col("_tile") > 0) & (F.col("label") < edge + after)).select(
            "_s", (F.col("_tile") - 1).alias("_tile"), "label")

    decisions = decide(tiled, None)
    told = border(decisions).limit(0)
    while True:
        now = border(decisions)
        if told.isEmpty() and now.isEmpty():
            break  # no session reaches over one tile, or no drop lies near a border
        changed = materialize(
            now.exceptAll(told).unionByName(told.exceptAll(now)).select("_s", "_tile").distinct())
        if changed.isEmpty():
            break
        again = tiled.alias("t").join(changed.alias("c"), same_keys("t", "c", ["_s", "_tile"]), "left_semi")
        fresh = decide(again, now)
        kept = decisions.alias("d").join(changed.alias("c"), same_keys("d", "c", ["_s", "_tile"]), "left_anti")
        told, decisions = now, materialize(kept.unionByName(fresh))
    return decisions.select(F.col("_s").alias(session), F.col("label").alias(label)).distinct()


def _first_of_tiles(part: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of every session by label.

    Counts per tile tell which tiles are taken whole; only the tile that the n-th row lies in is ranked."""
    counts = part.groupBy("_s", "_tile").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy("_s").orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).filter(F.col("_before") < n)
    held = part.join(small_table(counts), ["_s", "_tile"])
    whole = held.filter(F.col("_before") + F.col("_rows") <= n)
    cut = held.filter(F.col("_before") + F.col("_rows") > n).withColumn(
        "_nth", F.row_number().over(Window.partitionBy("_s", "_tile").orderBy("label"))).filter(F.col("_before") + F.col("_nth") <= n)
    return whole.unionByName(cut.drop("_nth")).drop("_rows", "_before")


def _dropped_without_window(rows: DataFrame, schema: str, partitions: int, n_next: int, n_prev: int, tile: int) -> DataFrame:
    """Dropped labels if every command sees its whole session.

    A session up to ``tile`` rows is one group.  A longer one is walked tile by tile from
    its end, and a tile gets a bounded view: its own rows, and as many open events of the
    three places commands can reach - the head of the session, the rows of the same second
    before the tile, the rows after it - as the tile's commands could use up at most.
    """
    def whole(part: DataFrame) -> DataFrame:
        flagged = part.withColumns({"_tile": F.lit(0).cast("bigint"), "home": F.lit(True), "gone": F.lit(False)})
        return _scan_tiles(flagged, schema, partitions, None, None, n_next, n_prev).select("_s", "label")

    long = hot_groups(rows, ["_s"], tile)
    if long is None:
        return whole(rows)
    keys = broadcast_if_small(long.select("_s"))
    normal = rows.alias("r").join(keys.alias("k"), same_keys("r", "k", ["_s"]), "left_anti")
    tiled = materialize(rows.alias("r").join(keys.alias("k"), same_keys("r", "k", ["_s"]), "left_semi")
                        .withColumn("_tile", F.floor(F.col("label") / tile)))
    gone = materialize(tiled.select("_s", "label").limit(0))
    for at in range(tiled.agg(F.max("_tile")).first()[0], -1, -1):
        here = tiled.filter(F.col("_tile") == at)
        open_events = tiled.filter(F.col("cat") == C.LOW_LEVEL).alias("e").join(
            gone.alias("g"), same_keys("e", "g", ["_s", "label"]), "left_anti")
        since = broadcast_if_small(materialize(here.groupBy("_s").agg(F.min("ts").alias("_since"))))
        away = materialize(open_events.filter(F.col("_tile") != at).join(since, "_s").withColumn(
            "_place", F.when(F.col("_tile") > at, "after").when(F.col("ts") >= F.col("_since"), "same")))

        def first(part: DataFrame, n: int) -> DataFrame:
            return _first_of_tiles(part, n + tile).select("_s", "label", "ts", "cat", "text", "allowed")

        view = (first(away.filter("_place = 'after'"), n_next)
                .unionByName(first(away.filter("_place = 'same'"), n_next))
                .unionByName(first(away, n_prev)).dropDuplicates(["_s", "label"])
                .withColumns({"home": F.lit(False), "gone": F.lit(False)}))
        mine = here.drop("_tile").alias("h").join(
            gone.withColumn("gone", F.lit(True)).alias("g"), same_keys("h", "g", ["_s", "label"]), "left"
        ).select("h.*", F.lit(True).alias("home"), F.coalesce(F.col("g.gone"), F.lit(False)).alias("gone"))
        step = mine.unionByName(view).withColumn("_tile", F.lit(at).cast("bigint"))
        found = _scan_tiles(step, schema, partitions, None, None, n_next, n_prev).select("_s", "label")
        gone = materialize(gone.unionByName(found))
    return whole(normal).unionByName(gone)


def replace_low_level(df: DataFrame, pairs: DataFrame, before: int | None = 10,
                      after: int | None = 30, session: str = "session", label: str = "label",
                      ts: str = "ts", cat: str = "cat", message: str = "message_eng",
                      tile: int = TILE) -> DataFrame:
    """Remove the events that a command triggered, and commands that triggered nothing.

    For each high-level command, from last to first: the first five events not earlier than
    it and the first one before it are looked at.  None: the command goes.  The command has
    no known pairs: it stays.  One of the events is a known pair: the first such event goes.
    Otherwise the command goes.
    """
    df = once(df)
    gone = dropped_labels(df, pairs, before, after, session=session, label=label, ts=ts, cat=cat,
                          message=message, tile=tile)
    return df.alias("d").join(gone.alias("g"), same_keys("d", "g", [session, label]), "left_anti")
