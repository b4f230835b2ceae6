"""Scoring by vectors, retrieval of documents, batch packing and batch inference."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.vectors import l2_norm
from sessionloom.operators.ordered import global_number
from sessionloom.operators.pairs import matrix, plain_strings
from sessionloom.operators.scale import broadcast_if_small, materialize, small_table
from sessionloom.operators.ranking import topk

# Items per block of the score matrix.
ITEM_BLOCK = 4_096
# Sessions whose scores with a block are held at a time.
SCORE_ROWS = 512


def _best(ids: np.ndarray, items: np.ndarray, scores: np.ndarray, k: int, skip_self: bool, least: np.ndarray | None = None) -> pd.DataFrame:
    """Top k items of each row of a score block; equal scores go by item.

    ``least`` is a score below which no item of the row counts; nothing is sorted but what reaches it, or the row's k-th score."""
    order_items = np.argsort(items, kind="stable")
    if (np.diff(order_items) != 1).any():
        items, scores = items[order_items], scores[:, order_items]
    if skip_self:
        mine = np.flatnonzero(np.isin(ids, items))
        scores[mine] = np.where(ids[mine][:, None] == items[None, :], np.nan, scores[mine])
    rows, places = np.nonzero(scores >= (-np.inf if least is None else least[:, None]))
    if len(rows) > 4 * k * len(ids) and scores.shape[1] > k > 0:
        kth = np.partition(np.where(np.isnan(scores), -np.inf, scores), -k, axis=1)[:, -k]
        rows, places = np.nonzero(scores >= (kth if least is None else np.maximum(kth, least))[:, None])
    found = scores[rows, places]
    # Items are in order, so a stable sort by score breaks ties by item.
    order = np.lexsort((-found, rows))
    rows, places, found = rows[order], places[order], found[order]
    best = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return plain_strings(pd.DataFrame({"session": ids[rows[best]], "item": items[places[best]], "score": found[best]}))


def score_by_vectors(sessions: DataFrame, items: DataFrame, k: int, session: str = "session",
                     item: str = "item", vector: str = "vector", temperature: float | None = None,
                     skip_self: bool = False, item_block: int = ITEM_BLOCK, session_block: int = 8_192) -> DataFrame:
    """The ``k`` items with the largest inner product for every session vector.

    Items lie in blocks by falling length.  All sessions meet the block of the longest, which gives each its
    k-th best score so far; since no inner product is above the product of the lengths, a session then meets
    only as many further blocks as can still reach that score.  Each meeting leaves its top
    k, and those are ranked again.  Scores that are not a number are left out.
    """
    scale = 1.0 / temperature if temperature else 1.0
    left = sessions.select(F.col(session).alias("session"), F.col(vector).alias("vector"))
    right = items.select(F.col(item).alias("item"), F.col(vector).alias("item_vector"))
    blocks = _item_blocks(right, item_block)
    longest = [r[0] for r in blocks.groupBy("_ib").agg(F.max("_length").alias("_length")).orderBy("_ib").select("_length").collect()]
    first = _meet(left.withColumn("_reach", F.lit(1)), blocks.filter("_ib = 0"), _tiles(left.withColumn("_reach", F.lit(1)), session_block, 0),
                  k, scale, skip_self, session_block)
    if len(longest) > 1:
        first = materialize(first)
        asked = materialize(_reach(left, first, longest, k, scale))
        more = _meet(asked, blocks.filter("_ib > 0"), _tiles(asked, session_block, 1), k, scale, skip_self, session_block)
        first = first.unionByName(more)
    return topk(first, k).select(F.col("session").alias(session), F.col("item").alias(item), "score", "rank")


def _item_blocks(items: DataFrame, size: int) -> DataFrame:
    """Items with ``_length`` and their block ``_ib``: 0 has the longest vectors.  A length that is no number counts as endless."""
    length = F.coalesce(F.nanvl(l2_norm("item_vector"), F.lit(float("inf"))), F.lit(float("inf")))
    measured = materialize(items.withColumn("_length", length).withColumn("_short", -F.col("_length")))
    numbered = global_number(measured, ["_short", "item"], "_n")
    return materialize(numbered.withColumn("_ib", F.floor((F.col("_n") - 1) / size)).drop("_n", "_short"))


def _reach(sessions: DataFrame, found: DataFrame, longest: list[float], k: int, scale: float) -> DataFrame:
    """Sessions with ``_reach``: how many item blocks may hold one of their k best items, and ``_kth``, the score these
    have to reach.  ``longest``, one number per block, falls."""
    kth = found.groupBy("session").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("_kth"))
    kind = sessions.schema["session"].dataType.simpleString()
    vectors = sessions.schema["vector"].dataType.simpleString()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        falling = -np.array(longest)
        for batch in batches:
            own = np.array([np.linalg.norm(np.asarray(v, float)) for v in batch["vector"]]) * abs(scale)
            known = batch["_kth"].to_numpy(float)
            with np.errstate(divide="ignore", invalid="ignore"):
                least = known / (own * (1 + 1e-9))      # of an item's length; above zero only
            sure = np.isfinite(least) & (known > 0)
            reach = np.where(sure, np.searchsorted(falling, -np.where(sure, least, 0.0), "right"), len(longest))
            yield batch[["session", "vector"]].assign(_reach=reach.astype(np.int32), _kth=batch["_kth"])

    return (sessions.join(kth, "session", "left").mapInPandas(count, f"session {kind}, vector {vectors}, _reach int, _kth double")
            .filter("_reach > 1"))


def _grouped(sessions: DataFrame, session_block: int) -> DataFrame:
    """Sessions in groups of similar reach, cut into blocks."""
    blocks = max(1, -(-sessions.count() // session_block))
    return sessions.withColumns({"_g": F.ceil(F.log2("_reach")).cast("int"), "_sb": F.pmod(F.xxhash64("session"), F.lit(blocks))})


def _tiles(sessions: DataFrame, session_block: int, first: int) -> DataFrame:
    """The meetings (``_g``, ``_sb``, ``_ib``) of session blocks and item blocks that are computed."""
    reach = _grouped(sessions, session_block).groupBy("_g", "_sb").agg(F.max("_reach").alias("_most"))
    return reach.select("_g", "_sb", F.explode(F.sequence(F.lit(first).cast("bigint"), F.col("_most").cast("bigint") - 1)).alias("_ib"))


def _meet(sessions: DataFrame, blocks: DataFrame, tiles: DataFrame, k: int, scale: float, skip_self: bool, session_block: int) -> DataFrame:
    """Session, item and score of the top k of every meeting."""
    schema = (f"session {sessions.schema['session'].dataType.simpleString()}, "
              f"item {blocks.schema['item'].dataType.simpleString()}, score double")
    tiles = small_table(tiles)
    ls = _grouped(sessions, session_block).join(tiles, ["_g", "_sb"]).filter(F.col("_ib") < F.col("_reach"))
    rs = blocks.join(tiles, "_ib")

    def meet(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(theirs):
            return pd.DataFrame({"session": [], "item": [], "score": []})
        theirs = theirs.sort_values("item", kind="stable")
        ids, vectors, others = mine["session"].to_numpy(), matrix(mine["vector"]), matrix(theirs["item_vector"]).T
        least = mine["_kth"].fillna(-np.inf).to_numpy(float)
        return pd.concat([_best(ids[a:a + SCORE_ROWS], theirs["item"].to_numpy(), vectors[a:a + SCORE_ROWS] @ others * scale, k, skip_self,
                                least[a:a + SCORE_ROWS]) for a in range(0, len(ids), SCORE_ROWS)])

    if "_kth" not in sessions.columns:
        ls = ls.withColumn("_kth", F.lit(None).cast("double"))
    return (ls.select("_g", "_sb", "_ib", "session", "vector", "_kth").groupBy("_g", "_sb", "_ib")
            .cogroup(rs.select("_g", "_sb", "_ib", "item", "item_vector").groupBy("_g", "_sb", "_ib")).applyInPandas(meet, schema))


def retrieve_docs(queries: DataFrame, docs: DataFrame, k: int = 3, query: str = "query", doc: str = "doc",
                  vector: str = "vector", text: str = "text", skip_self: bool = False, **options) -> DataFrame:
    """The ``k`` nearest documents of every query, with their texts joined by line feeds."""
    best = score_by_vectors(queries, docs, k, query, doc, vector, skip_self=skip_self, **options)
    with_text = best.join(docs.select(doc, text), doc)
    return with_text.groupBy(query).agg(F.sort_array(F.collect_list(F.struct("rank", doc, text))).alias("_l")).select(
        query, F.transform("_l", lambda x: x[doc]).alias("docs"),
        F.array_join(F.transform("_l", lambda x: x[text]), "\n").alias("context"))


def _fill_table(tokens: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a range does to the batch that is open when it begins.

    The open batch ends before the first document that does not fit.  Of each document that can be that
    one: where it lies, the sum before it, how full the last batch is at the end and how many
    batches have begun.  There are at most as many as documents fit into a batch.
    """
    sums = np.concatenate(([0], np.cumsum(tokens)))
    n = len(tokens)
    breaks = np.arange(min(n, int(np.searchsorted(sums, most, "right"))))
    breaks = breaks[(tokens[breaks] > 0) | (breaks == 0)]
    at, begun, filled = breaks.copy(), np.zeros(len(breaks), np.int64), np.zeros(len(breaks), np.int64)
    alive = np.arange(len(breaks))
    while len(alive):
        here = at[alive]
        begun[alive] += 1
        after = np.maximum(here + 1, np.searchsorted(sums, sums[here] + most, "right") - 1)
        ended = after >= n
        filled[alive[ended]] = sums[n] - sums[here[ended]]
        at[alive] = after
        alive = alive[~ended]
    return breaks, sums[breaks], filled, begun


def _first_break(sums: np.ndarray, filled: int | None, most: int) -> int:
    """Index in ``sums`` (sums before possible breaks) of the document that does not fit a batch filled so far."""
    if filled is None or filled > most:
        return 0
    return int(np.searchsorted(sums, most - filled, "right")) - 1


def pack_batches(docs: DataFrame, max_tokens: int = 800_000, key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """Greedy batches in key order: a new one starts when the sum would pass ``max_tokens``.

    No task walks all documents.  The sorted ranges of a range partition each tell what they make of
    any batch that is still open when they begin (``_fill_table``; as many entries as documents fit
    into a batch, at most).  One pass over these tables gives every range the fill it begins
    with, and the ranges number their documents side by side.  Documents without a token count as 0.
    """
    kinds = ", ".join(f"{name} {docs.schema[c].dataType.simpleString()}" for name, c in (("_k", key), ("_t", tokens)))
    plain = docs.select(F.col(key).alias("_k"), F.col(tokens).alias("_t"), F.coalesce(F.col(tokens).cast("bigint"), F.lit(0)).alias("_size"))
    names, lists = ["_part", "_n", "_k", "_t", "_size", "sums", "filled", "begun"], pa.list_(pa.int64())

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sizes, at = TaskContext.get().partitionId(), [np.zeros(0, np.int64)], 0
        for batch in batches:
            n, same = batch.num_rows, [batch.column(c) for c in ("_k", "_t", "_size")]
            sizes.append(batch.column("_size").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), *same,
                                              *(pa.nulls(n, lists) for _ in range(3))], names=names)
            at += n
        if at:  # the table of the range: a row without a place in it, with the sum of its sizes
            whole = np.concatenate(sizes)
            _, *table = _fill_table(whole, max_tokens)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, same[0].type), pa.nulls(1, same[1].type),
                                              pa.array([whole.sum()], pa.int64()), *(pa.array([x], lists) for x in table)], names=names)

    ranges = materialize(plain.repartitionByRange("_k").sortWithinPartitions("_k").mapInArrow(
        summarize, f"_part int, _n bigint, {kinds}, _size bigint, sums array<bigint>, filled array<bigint>, begun array<bigint>"))

    def chain(tables: pa.Table) -> pa.Table:
        rows, filled, batch = [], None, 0
        for t in sorted(tables.to_pylist(), key=lambda t: t["_part"]):
            rows.append((t["_part"], filled, batch))
            if filled is not None and filled + t["_size"] <= max_tokens:
                filled += t["_size"]
            else:
                at = _first_break(np.array(t["sums"]), filled, max_tokens)
                filled, batch = t["filled"][at], batch + t["begun"][at]
        return pa.table(dict(zip(("_part", "filled", "batch"), map(pa.array, zip(*rows), (pa.int32(), pa.int64(), pa.int64())))))

    # One row per range; the tables of all ranges meet in one task, the documents never do.
    entries = materialize(ranges.filter("_n IS NULL").select("_part", "_size", "sums", "filled", "begun").groupBy()
                          .applyInArrow(chain, "_part int, filled bigint, batch bigint"))

    def number(table: pa.Table) -> pa.Table:
        table = table.sort_by("_n")
        sums = np.concatenate(([0], np.cumsum(table.column("_size").to_numpy())))
        starts = np.zeros(len(sums) - 1, np.int64)
        at = _first_break(sums, table.column("filled")[0].as_py(), max_tokens)
        while at < len(starts):
            starts[at] = 1
            at = max(at + 1, int(np.searchsorted(sums, sums[at] + max_tokens, "right")) - 1)
        return table.select(["_k", "_t"]).append_column("batch", pa.array(table.column("batch")[0].as_py() + np.cumsum(starts)))

    numbered = (ranges.filter("_n IS NOT NULL").select("_part", "_n", "_k", "_t", "_size").join(broadcast_if_small(entries), "_part")
                .groupBy("_part").applyInArrow(number, f"{kinds}, batch bigint").withColumnsRenamed({"_k": key, "_t": tokens}))
    if set(docs.columns) == {key, tokens}:
        return numbered.select(*docs.columns, "batch")
    return docs.join(numbered.drop(tokens), key)


def predict(sequences: DataFrame, model: Callable[[pd.DataFrame], np.ndarray], k: int = 5,
            session: str = "session", values: str = "items", top_k: int | None = None,
            item_ids: Sequence[int] | None = None) -> DataFrame:
    """Top ``k`` items of a model that maps a batch of sequences to a score matrix.

    ``top_k`` is the number of items the model itself returns; asking for more is an error.
    Columns of the matrix are items 0, 1, ... or ``item_ids``.
    """
    if top_k is not None and k > top_k:
        raise ValueError("k must not be larger than the model's own top_k")
    kind = sequences.schema[session].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                scores = np.asarray(model(batch), dtype=np.float64)
                ids = np.arange(scores.shape[1]) if item_ids is None else np.asarray(item_ids)
                yield _best(batch[session].to_numpy(), ids, scores, k, False).rename(columns={"session": session})

    found = sequences.select(session, values).mapInPandas(run, f"{session} {kind}, item bigint, score double")
    order = Window.partitionBy(session).orderBy(F.desc("score"), "item")
    return found.withColumn("rank", F.row_number().over(order))


def augment_commands(commands: DataFrame, describe: Callable, message: str = "message_content", context: str = "context",
                     rounds: int = 1, most_classes: int = 1_000) -> DataFrame:
    """Summary, classification and target of every distinct command, by a user's function.

    ``describe(command, context)`` gives the three texts; if it fails they are null and ``error`` says why.  Rows
    carry their command, so a failure shifts nothing.  With several ``rounds`` the commands are dealt into
    as many parts, and ``describe(command, context, classes)`` also gets the classes of the parts before, the
    ``most_classes`` most frequent ones at most, by falling number and name.
    """
    distinct = commands.groupBy(message).agg(F.min(context).alias(context))
    schema = f"{message} string, summary string, classification string, target string, error string"

    def described(part: DataFrame, *seen) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for command, text in zip(batch[message], batch[context]):
                    try:
                        rows.append((command, *describe(command, text, *seen), None))
                    except Exception as problem:  # the user's function; what it says is kept
                        rows.append((command, None, None, None, f"{type(problem).__name__}: {problem}"))
                yield plain_strings(pd.DataFrame(rows, columns=[message, "summary", "classification", "target", "error"]))

        return part.mapInPandas(run, schema)

    if rounds == 1:
        return described(distinct)
    dealt = materialize(distinct.withColumn("_part", F.pmod(F.xxhash64(message), F.lit(rounds))))
    done = None
    for part in range(rounds):
        classes: list[str] = []
        if done is not None:
            known = done.filter(F.col("classification").isNotNull()).groupBy("classification").agg(F.count(F.lit(1)).alias("n"))
            classes = [r[0] for r in known.orderBy(F.desc("n"), "classification").limit(most_classes).collect()]
        now = materialize(described(dealt.filter(F.col("_part") == part), classes))
        done = now if done is None else done.unionByName(now)
    return done
