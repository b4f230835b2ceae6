"""Packing of documents into sequences of fixed length.

Documents are tokenised whole, dealt at random into groups of bounded size, and each group is
packed on its own: every document gives as many full sequences as it has room for, and its
rest is placed by first-fit decreasing, with a tournament tree over the free room of the open
sequences that finds the first that fits in logarithmic time.  Sequences that are still open
are then closed: the emptiest are taken apart and cut to fill the others exactly, and what is
left, less than one sequence per group, becomes sequences whose lengths are powers of two,
which need no padding.

Null and empty texts are documents of one token, the separator.  Repeated rows are packed as
often as they occur; a null id is kept.  Columns other than id and text are not read.  An
empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.textbytes import LOWER, U, prefix_sums, span_hashes, text_blocks, worker_state

LENGTH = 4096
GROUP_BYTES = 24 << 20   # text bytes of a group; it holds a fraction of that in token ids
CACHE_UNITS = 500_000    # units of text whose ids a worker remembers
SEPARATOR = 2


# Bytes that a text may be cut between: blanks and line breaks are dropped, and an ASCII letter
# next to ASCII punctuation (but the apostrophe of contractions) begins a new unit.
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x0A]] = True
_SIDE = np.zeros(256, np.int8)
_SIDE[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = 1
_SIDE[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]] = 2


class UnitTokenizer:
    """Token ids of texts, unit by unit.

    Only for tokenizers that lower the case and never join a letter with white space or
    punctuation, as the word-level one here: the ids of a text are then those of its units one
    after the other.  The same units come again and again, so a worker process remembers their
    ids, up to ``limit`` units.  Texts with the marks of special tokens are encoded whole.
    """

    def __init__(self, path: str, limit: int = CACHE_UNITS):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, U)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")

    def _learn(self, hashes: np.ndarray, units: list[str]) -> None:
        """Encode units, many in one string; a token belongs to the unit that it starts in."""
        ids, sizes = [self.ids], []
        for a in range(0, len(units), 256):
            part = units[a:a + 256]
            edges = np.cumsum([len(u) + 1 for u in part])
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            owner = np.searchsorted(edges, np.array([x for x, _ in found.offsets], np.int64), "right")
            sizes.append(np.bincount(owner, minlength=len(part)))
            ids.append(np.array(found.ids, "<u4"))
        size = np.concatenate(sizes)
        at = len(self.ids) + np.cumsum(size) - size
        every = np.concatenate([self.hashes, hashes])
        order = np.argsort(every)
        self.hashes = every[order]
        self.at, self.size = np.concatenate([self.at, at])[order], np.concatenate([self.size, size])[order]
        self.ids = np.concatenate(ids)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of every text of a block."""
        low = LOWER[data]
        solid = ~_GAP[data]
        begin = solid.copy()
        if data.size:
            side = _SIDE[data]
            begin[1:] &= ~solid[:-1] | ((side[1:] | side[:-1]) == 3)
            filled = offsets[:-1][offsets[1:] > offsets[:-1]]
            begin[filled] = solid[filled]
        starts = np.flatnonzero(begin)
        # A unit ends where the next begins, at a gap or at the end of its text.
        stop = np.append(np.flatnonzero(~solid), data.size)
        ends = np.minimum(np.append(starts[1:], data.size), stop[np.searchsorted(stop, starts)]) if len(starts) else starts
        owner = np.searchsorted(offsets, starts, "right") - 1
        ends = np.minimum(ends, offsets[owner + 1]) if len(starts) else ends
        hashes, first, number = np.unique(span_hashes(prefix_sums(low), starts, ends), return_index=True, return_inverse=True)
        if len(self.hashes) + len(hashes) > self.limit:
            self._forget()
        place = np.searchsorted(self.hashes, hashes)
        fresh = np.flatnonzero(self.hashes[np.minimum(place, max(0, len(self.hashes) - 1))] != hashes) if len(self.hashes) else np.arange(len(hashes))
        if len(fresh):
            whole = low.tobytes()
            self._learn(hashes[fresh], [whole[starts[i]:ends[i]].decode() for i in first[fresh].tolist()])
            place = np.searchsorted(self.hashes, hashes)
        size, at = self.size[place][number], self.at[place][number]
        total = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.repeat(at - total[:-1], size) + np.arange(total[-1])]
        edges = total[np.searchsorted(owner, np.arange(len(offsets)))]
        out = [ids[a:b] for a, b in zip(edges[:-1], edges[1:])]
        marks = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|"))) if data.size else ()
        for row in np.unique(np.searchsorted(offsets, marks, "right") - 1).tolist():
            text = data[offsets[row]:offsets[row + 1]].tobytes().decode()
            out[row] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return out


class TournamentTree:
    """Free room of bins in the order they were opened; the root of each subtree has its largest."""

    def __init__(self, size: int):
        self.leaves = 1 << max(1, (size - 1).bit_length())
        self.room = [0] * (2 * self.leaves)

    def first_with(self, need: int) -> int:
        """The first bin with at least that much room, or -1."""
        room, at = self.room, 1
        if room[1] < need:
            return -1
        while at < self.leaves:
            at *= 2
            if room[at] < need:
                at += 1
        return at - self.leaves

    def set(self, index: int, value: int) -> None:
        room, at = self.room, index + self.leaves
        room[at] = value
        at //= 2
        while at:
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                return
            room[at] = best
            at //= 2


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of item numbers; ties in size keep the items' order."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    tree, bins = TournamentTree(max(1, len(sizes))), []
    for item in order:
        at = tree.first_with(sizes[item])
        if at < 0:
            at = len(bins)
            bins.append([])
            tree.set(at, capacity - sizes[item])
        else:
            tree.set(at, tree.room[at + tree.leaves] - sizes[item])
        bins[at].append(item)
    return bins


def pack_group(lengths: list[int], capacity: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; each token lies in one piece.

    All sequences are full but for the last few, whose lengths are different powers of two."""
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    rests = []
    for document, length in enumerate(lengths):
        whole = length // capacity
        for i in range(whole):
            pieces.append((document, i * capacity, capacity, sequence, 0))
            sequence += 1
        if length % capacity:
            rests.append((document, whole * capacity, length % capacity))
    bins = [[rests[i] for i in items] for items in first_fit_decreasing([n for *_, n in rests], capacity)]
    fill = [sum(n for *_, n in items) for items in bins]
    order = sorted(range(len(bins)), key=lambda i: -fill[i])
    low, high = 0, len(order) - 1
    left: list[tuple[int, int, int]] = []  # pieces of sequences that were taken apart
    while low <= high:
        target = bins[order[low]]
        gap = capacity - fill[order[low]]
        while gap and (left or high > low):
            if not left:
                left, high = bins[order[high]], high - 1
            document, start, length = left.pop()
            cut = min(gap, length)
            target.append((document, start, cut))
            gap -= cut
            if cut < length:
                left.append((document, start + cut, length - cut))
        if gap:
            left = target
            break
        offset = 0
        for document, start, length in target:
            pieces.append((document, start, length, sequence, offset))
            offset += length
        sequence, low = sequence + 1, low + 1
    amount = sum(n for *_, n in left)
    for power in (1 << i for i in range(amount.bit_length() - 1, -1, -1)):
        if amount & power:
            offset = 0
            while offset < power:
                document, start, length = left.pop()
                cut = min(power - offset, length)
                pieces.append((document, start, cut, sequence, offset))
                offset += cut
                if cut < length:
                    left.append((document, start + cut, length - cut))
            sequence += 1
    return pieces


def pack_documents(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = LENGTH,
                   separator: int = SEPARATOR, group_bytes: int = GROUP_BYTES, seed: int = 17) -> DataFrame:
    """Pieces: ``key``, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of the tokenizer's file on every worker."""
    size = df.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 64)).first()[0] or 0
    groups = max(1, -(-size // group_bytes))
    kind = df.schema[key].dataType.simpleString()

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = worker_state(f"units of {tokenizer}", lambda: UnitTokenizer(tokenizer))
        end = np.array([separator], dtype="<u4")
        for batch in batches:
            for first, last, data, offsets in text_blocks(batch.column("_text")):
                ids = [np.append(x, end) for x in units.encode(data, offsets)]
                wide = max(int(x.max()) for x in ids) > 0xFFFF
                rows = slice(first, last)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_key")[rows], batch.column("_group")[rows], pa.array([4 if wide else 2] * len(ids), pa.int32()),
                     pa.array([x.astype("<u4" if wide else "<u2").tobytes() for x in ids], pa.binary())],
                    names=["_key", "_group", "_width", "_ids"])

    def pack(group: pa.Table) -> pa.Table:
        width = group.column("_width").to_pylist()
        tokens = [np.frombuffer(x.as_py(), f"<u{w}") for x, w in zip(group.column("_ids"), width)]
        pieces = pd.DataFrame(pack_group([len(t) for t in tokens], capacity),
                              columns=["document", "start", "length", "sequence", "offset"]).astype(np.int64)
        checks = [zlib.crc32(tokens[d][s:s + n].astype("<u4").tobytes())
                  for d, s, n in zip(pieces["document"], pieces["start"], pieces["length"])]
        sizes = np.array([len(t) for t in tokens], np.int64)
        number = group.column("_group")[0].as_py() << 32
        return pa.table({
            "_key": group.column("_key").combine_chunks().take(pa.array(pieces["document"])), "start": pa.array(pieces["start"]),
            "length": pa.array(pieces["length"]), "ids_crc32": pa.array(checks, pa.int64()),
            "doc_tokens": pa.array(sizes[pieces["document"]]), "sequence_id": pa.array(pieces["sequence"] + number),
            "offset": pa.array(pieces["offset"])})

    dealt = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"),
                      F.floor(F.rand(seed) * groups).cast("long").alias("_group"))
    tokens = dealt.mapInArrow(tokenise, f"_key {kind}, _group long, _width int, _ids binary")
    packed = tokens.groupBy("_group").applyInArrow(
        pack, f"_key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return packed.withColumnRenamed("_key", key)
