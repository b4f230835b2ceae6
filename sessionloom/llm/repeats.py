"""Removal of long repeats: every byte covered by a string of 200 bytes that starts elsewhere too.

A run-length index of a whole corpus cannot be spread over executors, so the texts are first
cut into pieces that can be indexed on their own, without losing a repeat:

1. In every window of 200 bytes the smallest hash of its 40-byte strings is the anchor.  Equal
   windows have equal anchors, so a repeat can only lie between pieces (runs of neighbouring
   windows) with the same anchor.  Anchors that occur once end here, and anchors whose pieces
   are all equal are repeats as they stand.
2. The other pieces meet in shards by anchor.  An anchor with more than ``GROUP`` different
   pieces is split: the windows of a piece are halved by their place around the anchor, and
   each half moves to the group of the bytes that all its windows share.
3. Each shard sorts the suffixes of its pieces and keeps the Burrows-Wheeler transform as runs,
   with the text positions at the ends of each run.  Match lengths are compared at run ends
   only; between them they are streamed in text order, where each is one less than the last.
   Windows whose match reaches 200 bytes are repeats.
4. The repeats of a text are united and cut out.

Pieces and texts are told apart by 128-bit hashes.  Matches never cross texts; repeats are
judged on the input.  Null and empty texts, and those under 200 bytes, lose nothing.  Repeated
rows are copies of each other.  Columns of other names are not read.  An empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.textbytes import BASE_INVERSE, U, mix, powers, prefix_sums, release, span_hashes, text_blocks
from sessionloom.operators.scale import broadcast_if_small, materialize

LENGTH = 200
GRAM = 40
GROUP = 4096            # different pieces of an anchor that one shard takes
SHARD_BYTES = 1 << 20   # the index takes over a hundred bytes for one of text while it is built


def pieces(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Anchored pieces of every text of a block: row, start, size, place of the anchor, anchor hash, piece hash.

    A piece covers the neighbouring windows of ``length`` bytes with the same anchor."""
    n, spread = data.size, length - gram + 1
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, U, U))
    sums = prefix_sums(data)
    with np.errstate(over="ignore"):
        grams = mix((sums[gram:] - sums[:-gram]) * powers(BASE_INVERSE, n - gram + 1))
    low = U((1 << n.bit_length()) - 1)
    packed = (grams & ~low) | np.arange(len(grams), dtype=U)
    rows = -(-len(packed) // spread)
    table = np.full(rows * spread, np.iinfo(np.uint64).max, dtype=U)
    table[:len(packed)] = packed
    table = table.reshape(rows, spread)
    forward = np.minimum.accumulate(table, axis=1).ravel()
    backward = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    anchor = (np.minimum(backward[:windows], forward[spread - 1:spread - 1 + windows]) & low).astype(np.int64)
    inside = np.zeros(windows, bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        inside[a:max(a, b - length + 1)] = True
    starts = np.flatnonzero(inside)
    if not len(starts):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, U, U))
    at = anchor[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = starts[new]
    last = starts[np.append(np.flatnonzero(new)[1:], len(starts)) - 1]
    place = at[new]
    row = np.searchsorted(offsets, first, "right") - 1
    return (row, first - offsets[row], last + length - first, place - first, grams[place], span_hashes(sums, first, last + length))


class RunLengthIndex:
    """The Burrows-Wheeler transform of some texts as runs, with sampled run ends."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts])
        self.starts = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
        joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        symbols = joined.astype(np.int64) + 1
        self.ends = self.starts + sizes
        symbols[self.ends] = 0
        self.symbols = symbols
        self.left = np.repeat(self.ends, sizes + 1) - np.arange(len(symbols))  # bytes up to the end of the text
        order = self._suffixes(int(sizes.max(initial=0)))
        before = symbols[order - 1]
        before[order == 0] = 0
        # Texts have no symbol before their first: each of those is a run of its own.
        head = np.ones(len(order), bool)
        head[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)
        self.heads = np.flatnonzero(head)
        self.run_symbols, self.run_lengths = before[self.heads], np.diff(np.append(self.heads, len(order)))
        self.first_of_run = order[self.heads]               # samples: the first position of each run ...
        self.last_before = order[np.maximum(self.heads - 1, 0)]  # ... and the last of the run before it

    def _suffixes(self, longest: int) -> np.ndarray:
        """All positions in the order of their suffixes, each ending with its text; ties by position."""
        n, width = len(self.symbols), 7
        key = np.zeros(n, np.int64)
        for i in range(width):
            shifted = np.zeros(n, np.int64)
            shifted[:max(0, n - i)] = self.symbols[i:]
            shifted[i > self.left] = 0
            key = (key << 9) | shifted
        while True:
            order = np.argsort(key, kind="stable")
            step = np.zeros(n, np.int64)
            ranked = key[order]
            step[1:] = ranked[1:] != ranked[:-1]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(step)
            if width > longest:
                return order
            follow = np.zeros(n, np.int64)
            follow[:max(0, n - width)] = rank[width:] + 1
            follow[width > self.left] = 0
            key = rank * (n + 2) + follow
            width *= 2

    def _compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of the suffixes at a and at b."""
        limit = np.minimum(self.left[a], self.left[b])
        out = limit.copy()
        live = np.arange(len(a))
        depth = 0
        while len(live):
            live = live[limit[live] > depth]
            same = self.symbols[a[live] + depth] == self.symbols[b[live] + depth]
            out[live[~same]] = depth
            live = live[same]
            depth += 1
        return out

    def long_matches(self, length: int) -> np.ndarray:
        """Whether the ``length`` bytes from each position on occur at another position too."""
        n = len(self.symbols)
        lengths = np.zeros(n, np.int64)
        other = np.zeros(n, np.int64)
        lengths[self.first_of_run] = self._compare(self.first_of_run, self.last_before)
        lengths[self.first_of_run[0]] = 0
        other[self.first_of_run] = self.last_before
        sampled = np.zeros(n, np.int64)
        sampled[self.first_of_run] = self.first_of_run
        sampled = np.maximum.accumulate(sampled)
        passed = np.arange(n) - sampled
        match = lengths[sampled] - passed
        found = match >= length
        found[(other[sampled] + passed)[found]] = True
        return found


def repeat_spans(texts: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each text the spans covered by strings of ``length`` bytes that start elsewhere too."""
    index = RunLengthIndex(texts)
    at = np.flatnonzero(index.long_matches(length))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    if len(at):
        new = np.ones(len(at), bool)
        new[1:] = at[1:] > at[:-1] + 1
        first, last = at[new], at[np.append(np.flatnonzero(new)[1:], len(at)) - 1]
        owner = np.searchsorted(index.starts, first, "right") - 1
        for i, a, b in zip(owner.tolist(), (first - index.starts[owner]).tolist(), (last - index.starts[owner]).tolist()):
            spans[i].append((a, b + length))
    return spans


def text_key(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


_PIECE = "t binary, start int, size int, place int, anchor long, piece long"


def _pieces(df: DataFrame, text: str, length: int, gram: int) -> DataFrame:
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_blocks(batch.column("_text")):
                row, start, size, place, anchor, piece = pieces(data, offsets, length, gram)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("t").take(pa.array(row + first)), *(pa.array(x.astype(np.int32)) for x in (start, size, place)),
                     pa.array(anchor.view(np.int64)), pa.array(piece.view(np.int64))],
                    names=["t", "start", "size", "place", "anchor", "piece"])

    return df.select(text_key(text).alias("t"), F.col(text).alias("_text")).filter(
        F.octet_length("_text") >= length).mapInArrow(compute, _PIECE)


def _cut(df: DataFrame, text: str, asked: DataFrame) -> DataFrame:
    """The bytes of the asked pieces: anchor, piece, place, single, content."""
    wanted = asked.groupBy("t").agg(F.collect_list(F.struct("start", "size", "place", "anchor", "piece", "single")).alias("asked"))
    texts = df.select(text_key(text).alias("t"), F.col(text).cast("binary").alias("_bytes"))
    joined = texts.join(broadcast_if_small(materialize(wanted)), "t").select("_bytes", F.explode("asked").alias("a"))
    return joined.select("a.anchor", "a.piece", "a.place", "a.single",
                         F.substring("_bytes", F.col("a.start") + 1, F.col("a.size")).alias("content")).dropDuplicates(["anchor", "piece"])


def _halve(rows: DataFrame, length: int) -> DataFrame:
    """Each row as its windows in the lower and the upper half of the cell [low, high) around the anchor."""
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                most, least = r["place"], r["place"] - (len(r["content"]) - length)
                middle = (r["low"] + r["high"]) // 2
                for low, high in ((r["low"], middle), (middle, r["high"])):
                    a, b = max(least, low), min(most, high - 1)
                    if a > b:
                        continue
                    shift = most - b
                    content = r["content"][shift:shift + (b - a) + length]
                    core = content[b - low:b - (high - 1) + length]
                    key = int.from_bytes(hashlib.blake2b(core, digest_size=8, key=b"%d-%d" % (low, high)).digest(), "little", signed=True)
                    out.append({**r, "key": key, "low": low, "high": high, "place": b, "at": r["at"] + shift, "content": content})
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema)

    return rows.mapInArrow(compute, rows.schema)


def _match(cut: DataFrame, length: int, gram: int, group: int, shard_bytes: int) -> DataFrame:
    """Repeats inside the pieces: anchor, piece and the spans as (a, b) in the piece."""
    spread = length - gram + 1
    rows = materialize(cut.select(F.col("anchor").alias("key"), "anchor", "piece", "single", F.lit(0).alias("at"), "place",
                                  F.lit(0).alias("low"), F.lit(spread).alias("high"), "content"))
    ready = []
    while True:
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
        sized = rows.join(sizes.filter("_n > 1"), "key")
        ready.append(sized.filter((F.col("_n") <= group) | (F.col("high") - F.col("low") <= 1)).drop("_n"))
        large = sized.filter((F.col("_n") > group) & (F.col("high") - F.col("low") > 1)).drop("_n")
        if large.isEmpty():
            break
        rows = materialize(_halve(large, length))
    every = ready[0]
    for more in ready[1:]:
        every = every.unionByName(more)
    # A cell of one window holds equal contents only: its group is a repeat, whatever its size.
    whole = every.filter(F.col("high") - F.col("low") <= 1).filter("single").select(
        "anchor", "piece", F.col("at").alias("a"), (F.col("at") + F.octet_length("content")).alias("b"))
    every = materialize(every.filter(F.col("high") - F.col("low") > 1))
    total = every.agg(F.sum(F.octet_length("content").cast("long"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))

    def search(table: pa.Table) -> pa.Table:
        found = []
        for row, spans in zip(table.select(["anchor", "piece", "single", "at"]).to_pylist(),
                              repeat_spans([c.as_py() for c in table.column("content")], length)):
            if row["single"]:
                found += [(row["anchor"], row["piece"], row["at"] + a, row["at"] + b) for a, b in spans]
        columns = list(zip(*found)) if found else [(), (), (), ()]
        release()
        return pa.table({"anchor": pa.array(columns[0], pa.int64()), "piece": pa.array(columns[1], pa.int64()),
                         "a": pa.array(columns[2], pa.int32()), "b": pa.array(columns[3], pa.int32())})

    searched = (every.withColumn("_shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("_shard")
                .applyInArrow(search, "anchor long, piece long, a int, b int"))
    return whole.unionByName(searched)


def find_repeats(df: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, group: int = GROUP,
                 shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``t`` (see ``text_key``) and ``spans``, the repeats (a, b) of every text that has any; they may overlap."""
    every = _pieces(df, text, length, gram)
    anchors = every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("piece").alias("low"), F.max("piece").alias("high"))
    repeated = materialize(anchors.filter("n > 1").select("anchor", (F.col("low") != F.col("high")).alias("mixed")))
    rows = materialize(every.join(broadcast_if_small(repeated), "anchor"))
    different = materialize(rows.groupBy("anchor", "piece").agg(
        F.any_value("mixed").alias("mixed"), F.min(F.struct("t", "start", "size", "place")).alias("w"), (F.count(F.lit(1)) == 1).alias("single")))
    rows = materialize(rows.join(broadcast_if_small(different.select("anchor", "piece", "single")), ["anchor", "piece"]))
    different = different.filter("mixed").drop("mixed")
    # An anchor of which every piece occurs several times has nothing left to search.
    searched = different.groupBy("anchor").agg(F.max("single").alias("_open")).filter("_open").select("anchor")
    asked = different.join(searched, "anchor").select("w.*", "anchor", "piece", "single")
    inner = _match(_cut(df, text, asked), length, gram, group, shard_bytes)
    # One row per piece that is the only one of its kind, with its few spans.
    inner = inner.groupBy("anchor", "piece").agg(F.collect_list(F.struct("a", "b")).alias("inner"))
    part = rows.filter("mixed AND single").join(inner, ["anchor", "piece"]).select("t", "start", F.explode("inner").alias("s")).select(
        "t", (F.col("start") + F.col("s.a")).alias("a"), (F.col("start") + F.col("s.b")).alias("b"))
    full = rows.filter("NOT mixed OR NOT single").select("t", F.col("start").alias("a"), (F.col("start") + F.col("size")).alias("b"))
    spans = part.unionByName(full).distinct()
    return materialize(spans.groupBy("t").agg(F.collect_list(F.struct("a", "b")).alias("spans")))


def united(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _with_spans(df: DataFrame, text: str, **options) -> DataFrame:
    found = find_repeats(df, text, **options)
    return df.withColumn("_t", text_key(text)).join(
        broadcast_if_small(found.select(F.col("t").alias("_t"), F.col("spans").alias("_spans"))), "_t", "left").drop("_t")


def kept_bytes(content: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in spans:
        out.append(content[at:a])
        at = b
    return b"".join([*out, content[at:]])


def measure_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """For every row ``key``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256``."""
    kind = df.schema[key].dataType.simpleString()

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for content, spans in zip(batch.column("_bytes"), batch.column("_spans")):
                content, spans = content.as_py() or b"", united(spans.as_py())
                out.append((len(content), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept_bytes(content, spans)).hexdigest()))
            columns = list(zip(*out)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())],
                names=["_key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = _with_spans(df.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text", **options)
    return rows.select("_key", F.col("_text").cast("binary").alias("_bytes"), "_spans").mapInArrow(
        compute, f"_key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("_key", key)


def cut_repeats(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """``df`` with the repeats cut out of ``text``; a character of which a part goes, goes whole."""
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts = [t.as_py() if s.as_py() is None or t.as_py() is None else
                     kept_bytes(t.as_py().encode(), united(s.as_py())).decode(errors="ignore")
                     for t, s in zip(batch.column(at), batch.column("_spans"))]
            plain = batch.set_column(at, text, pa.array(texts, pa.string()))
            yield plain.drop_columns(["_spans"])

    rows = _with_spans(df, text, **options)
    return rows.mapInArrow(compute, df.schema)
