"""Language-model scoring by logistic context mixing of hashed-context bit predictors.

A text is a sequence of words (A-Z lower-cased) and one end.  Each of these tokens is coded in bits,
and every bit is predicted by mixing what several predictors say of it.

Known words.  A word of the training documents is coded by ``WORD_BITS`` bits of its hash.  Three
predictors hash a context (nothing, the word before, the two words before) and the bits so far to a slot
with two counts, gathered over the running text of all training documents.  Their log odds
are combined by weights that a gate selects (bit number, how many contexts have been seen, and how much each slot
has seen).  Weights are learned in a second pass over all training text, every token predicted without its own counts, and
averaged over the partitions.  Words that share all these bits are told apart by their training counts.

New words.  Whether a word is new is a bit of its own, learned from the words that training has once.
A new word is its bytes and a closing byte, eight bits each.  Four predictors
hash a context (the last one, two or three bytes, and two bytes with the place
in the word) and the bits so far to a slot with two counts, gathered over all different words
of the training documents.  Their gate is the bit number, the place in the word, and how much each slot has
seen.  Weights are learned online, one
pass over the different training words in a partition, every word predicted
without its own counts, and then averaged.  A last table per bit refines the mixed
probability; it is learned in the same pass.

The number of slots is a parameter; everything counted covers all training words.

Every document's probability is the product over its tokens, so it sums to at
most one over all texts; bits per byte follow from it.  Null and empty texts consist of an end
only.  Without training documents all counts are 0 and the predictors are uniform.
Repeated rows are scored as often; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.textbytes import LOWER, SPACE, U, mix, prefix_sums, span_hashes, text_blocks, words
from sessionloom.operators.scale import materialize

BATCH_BYTES = 8 << 20           # text of a batch of documents
PART_BYTES = 512 << 10          # of it that is hashed at a time, as that takes many bytes for one of text
SLOTS = (18, 19, 20, 19)        # bits of slot numbers, by predictor
LEVELS = 8                      # of how much a slot has seen
PLACES = 4
RATE = 0.02
GRID = 24                       # steps of the last table
WORD_BITS = 16                  # of a word's hash; a multiple of NIBBLE
NIBBLE = 4                      # bits of a word whose slots lie side by side
WORD_SLOTS = (WORD_BITS, 21, 21)  # bits of slot numbers, by words of context
WORD_RATE = 0.02
WORD_CHUNK = 8192               # tokens mixed at a time: what they touch stays in the cache
PACKED = 1 << 13                # slots to a row on their way to the driver
END, CLOSE = b"\n", 0x20

def running_words(data: np.ndarray, offsets: np.ndarray):
    """Hashes of all tokens of some texts in their order, and the number of the first token of each text."""
    starts, ends, owner = words(data, offsets)
    rows = len(offsets) - 1
    hashes = np.full(len(starts) + rows, U(0))  # those that stay are the ends
    hashes[np.arange(len(starts)) + owner] = span_hashes(prefix_sums(data), starts, ends)
    return hashes, starts, ends, owner, np.cumsum(np.bincount(owner, minlength=rows) + 1) - np.bincount(owner, minlength=rows) - 1


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted different hashes, where one of each lies, and the place of every hash among them.

    Any of some equal ones will do, so they need not be kept in order as ``np.unique`` does."""
    order = np.argsort(hashes)
    ranked = hashes[order]
    new = np.ones(len(hashes), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    number = np.empty(len(hashes), np.int64)
    number[order] = np.cumsum(new) - 1
    return ranked[new], order[new], number


def distinct_tokens(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, rows: int):
    """The different tokens of some texts, and the place of every token among them.

    Returns their sorted hashes, where their bytes start and end (-1: the end of a text), and the document and token number
    of every token in order."""
    doc = np.empty(len(hashes), np.int64)
    place = np.arange(len(starts)) + owner
    doc[place] = owner
    last = np.ones(len(hashes), bool)
    last[place] = False
    doc[last] = np.arange(rows)
    keys, first, number = distinct(hashes)
    spans, word = np.full((2, len(keys)), -1), np.flatnonzero(~last[first])
    spans[:, word] = np.stack([starts, ends])[:, first[word] - doc[first[word]]]
    return keys, spans, doc, number


def batch_tokens(column: pa.Array, mixer: WordMixer, predictors: Predictors):
    """The different tokens of the texts of a batch, found part by part, and each document's token numbers with counts.

    Returns the tokens, document of each entry, its token number, its count, the log10 of
    the probability that the mixer gives the entry's words, and that of each document's words."""
    parts, texts, of_text, size, begin = [], [], [], 0, 0
    for first, last, data, offsets in text_blocks(column, PART_BYTES):
        data = LOWER[data]
        hashes, starts, ends, owner, firsts = running_words(data, offsets)
        keys, spans, doc, number = distinct_tokens(hashes, starts, ends, owner, last - first)
        coded = mixer.run(WordBits(hashes, firsts), predictors, False) / np.log(10)
        of_text.append(np.add.reduceat(coded, firsts))
        pairs, entry, counts = np.unique(doc * len(keys) + number, return_inverse=True, return_counts=True)
        # What lasts until the end of the batch has the type it is written with, or a narrow one.
        parts.append((keys, *np.where(spans < 0, -1, spans + begin), (pairs // len(keys) + first).astype(np.int32),
                      (pairs % len(keys) + size).astype(np.int32), counts.astype(np.int32), np.bincount(entry, weights=coded).astype(np.float32)))
        texts.append(data.tobytes())
        size, begin = size + len(keys), begin + len(data)
    columns = [list(x) for x in zip(*parts)]
    del parts
    # Each column gives up its parts as it is joined.
    keys, starts, ends, doc, number, count, coded = (np.concatenate(columns.pop(0)) for _ in range(len(columns)))
    whole = b"".join(texts)
    del texts
    _, first, merged = distinct(keys)
    starts, ends, number = starts[first], ends[first], merged.astype(np.int32)[number]
    del keys, merged
    # A document lies in one part, whose keys are sorted too: its numbers still ascend.
    tokens = [END if a < 0 else whole[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
    return tokens, doc, number, count, coded, np.concatenate(of_text)


def _pack(values: np.ndarray, kind: type) -> bytes:
    """Small numbers as unsigned ``kind``: the largest of its values stands for itself, and more follows."""
    most = np.iinfo(kind).max
    more = values // most
    out = np.full(int(more.sum()) + len(values), most, kind)
    out[np.cumsum(more + 1) - 1] = values - more * most
    return out.tobytes()


def _unpack(data: bytes, kind: type) -> np.ndarray:
    digits = np.frombuffer(data, kind)
    sums = np.cumsum(digits, dtype=np.int64)[digits != np.iinfo(kind).max]
    return np.diff(sums, prepend=0)


_FIRST = ("kind int, batch long, id {kind}, held_out boolean, token binary, at int, n long, coded double, numbers binary, counts binary, "
          "doubts binary")


def _first_pass(df: DataFrame, predictors, mixer: WordMixer, kind: str) -> DataFrame:
    """Per batch of documents: its different tokens (kind 0; n: training count) and its documents as token
    numbers (kind 1; n: bytes).

    ``coded`` is what a document's words cost by their contexts, were all of them known; ``doubts`` holds the
    part of each of its tokens that no training document of the batch has, as those may be new."""
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for first, last, _, offsets in text_blocks(batch.column("text"), BATCH_BYTES):
                ids, held = batch.column("id").slice(first, last - first), batch.column("held_out").slice(first, last - first)
                tokens, doc, token, count, coded, of_text = batch_tokens(batch.column("text").slice(first, last - first), mixer, predictors.value)
                training = ~np.array(held.to_pylist(), bool)
                taught = np.bincount(token, weights=count * training[doc], minlength=len(tokens)).astype(np.int64)
                none = lambda t, n: pa.nulls(n, t)
                n, m = len(tokens), last - first
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, number)), none(ids.type, n), none(pa.bool_(), n),
                     pa.array(tokens, pa.binary()), pa.array(np.arange(n, dtype=np.int32)), pa.array(taught),
                     none(pa.float64(), n), *(none(pa.binary(), n) for _ in range(3))], names=names)
                edges = np.searchsorted(doc, np.arange(m + 1)).tolist()
                spans, unsure = list(zip(edges[:-1], edges[1:])), taught[token] == 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ones(m, np.int32)), pa.array(np.full(m, number)), ids, held,
                     none(pa.binary(), m), none(pa.int32(), m), pa.array(np.diff(offsets)), pa.array(of_text),
                     pa.array([_pack(np.diff(token[a:b], prepend=-1), np.uint16) for a, b in spans], pa.binary()),
                     pa.array([_pack(count[a:b], np.uint8) for a, b in spans], pa.binary()),
                     pa.array([coded[a:b][unsure[a:b]].astype(np.float32).tobytes() for a, b in spans], pa.binary())], names=names)
                number += 1

    names = ["kind", "batch", "id", "held_out", "token", "at", "n", "coded", "numbers", "counts", "doubts"]
    return df.mapInArrow(compute, _FIRST.format(kind=kind))


_OFFSETS = np.concatenate(([0], np.cumsum([1 << s for s in SLOTS])))
# Where each node of the eight bits (1 to 255) moves the slot of a context.
_NODES = [(mix(np.arange(256, dtype=U) * U(0x165667B19E3779F9) + U(k)) >> U(64 - size)).astype(np.int64) for k, size in enumerate(SLOTS)]


class Spelling:
    """Contexts and bits of some tokens: for every bit the slots of the predictors and the gate."""

    def __init__(self, tokens: list[bytes], styles: np.ndarray):
        sizes = np.array([len(t) + 1 for t in tokens], np.int64)
        self.ends = np.cumsum(sizes)
        self.symbols = np.frombuffer(b"".join(t + bytes([CLOSE]) for t in tokens), np.uint8)
        n = len(self.symbols)
        place = np.arange(n) - np.repeat(self.ends - sizes, sizes)
        self.style = np.repeat(np.asarray(styles, np.int64), sizes)
        before = np.zeros((3, n), dtype=U)
        for back in range(1, 4):
            inside = place >= back
            before[back - 1, inside] = self.symbols[np.flatnonzero(inside) - back].astype(U) + U(1)
        with np.errstate(over="ignore"):
            short = before[0] | (before[1] << U(9))
            style = (self.style.astype(U) + U(1)) << U(40)
            contexts = (before[0] | style, short | style, short | (before[2] << U(18)) | style,
                        short | (np.minimum(place, 15).astype(U) << U(20)))
            self.slots = [(mix(c + U((k + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64))) >> U(64 - SLOTS[k])).astype(np.int64) + _OFFSETS[k]
                          for k, c in enumerate(contexts)]
        self.place = np.minimum(place, PLACES - 1)

    def bits(self):
        """(bit number, its value at every position, slots of each predictor) for the eight bits in turn."""
        node = np.ones(len(self.symbols), np.int64)
        for b in range(8):
            bit = ((self.symbols >> (7 - b)) & 1).astype(np.int64)
            yield b, bit, [((slots - start) ^ nodes[node]) + start for slots, start, nodes in zip(self.slots, _OFFSETS, _NODES)]
            node = node * 2 + bit


def slot_counts(tokens: list[bytes], styles: np.ndarray) -> np.ndarray:
    """How often each slot has seen a zero and a one, as two rows."""
    found = np.zeros(2 * _OFFSETS[-1], np.int64)
    for a in range(0, len(tokens), 20_000):
        for _, bit, every in Spelling(tokens[a:a + 20_000], styles[a:a + 20_000]).bits():
            for slots in every:
                np.add.at(found, slots + bit * _OFFSETS[-1], np.int64(1))
    return found.reshape(2, -1)


# What a predictor says, in a byte and three bits: log odds in eighths, and how much the slot has seen.
_ODDS = (np.tile(np.arange(256), LEVELS) - 128) / 8.0


def _said(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    odds = np.clip(np.rint(np.log((ones + 0.2) / (zeros + 0.2)) * 8), -127, 127).astype(np.int64) + 128
    return (np.minimum(np.log2(zeros + ones + 1).astype(np.int64), LEVELS - 1) * 256 + odds).astype(np.uint16)


class Predictors:
    """What each slot says, as it is and without one zero or one one."""

    def __init__(self, counts: np.ndarray):
        n = counts.shape[1]
        self.plain, self.without = np.empty(n, np.uint16), np.empty(2 * n, np.uint16)
        for a in range(0, n, 1 << 18):
            zeros, ones = counts[:, a:a + (1 << 18)].astype(np.float64)
            self.plain[a:a + (1 << 18)] = _said(zeros, ones)
            self.without[a:a + len(zeros)] = _said(np.maximum(zeros - 1, 0), ones)
            self.without[n + a:n + a + len(zeros)] = _said(zeros, np.maximum(ones - 1, 0))
        self.kept: tuple[bool | None, np.ndarray | None] = None, None

    def paths(self, learn: bool) -> np.ndarray:
        """``word_paths`` of these predictors; made once per worker, and not sent to it."""
        if self.kept[0] is not learn:
            self.kept = learn, word_paths(self, learn)
        return self.kept[1]


def _gather_counts(vocabulary: DataFrame) -> np.ndarray:
    """Counts of zeros and ones of every slot over all training (word, style), as two rows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, _OFFSETS[-1]), np.int64)
        for batch in batches:
            found += slot_counts(batch.column("token").to_pylist(), batch.column("style").to_numpy())
        used = np.flatnonzero(found.any(axis=0))
        for a in range(0, len(used), 1 << 17):
            part = used[a:a + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *(pa.array(f[part]) for f in found)],
                                             names=["slot", "zeros", "ones"])

    sums = (vocabulary.filter("c_style > 0").select("token", "style").mapInArrow(count, "slot int, zeros long, ones long")
            .groupBy("slot").agg(F.sum("zeros").cast("float").alias("zeros"), F.sum("ones").cast("float").alias("ones")))

    def pack(table: pa.Table) -> pa.Table:
        return pa.table({c: pa.array([table.column(c).to_numpy().tobytes()], pa.binary()) for c in ("slot", "zeros", "ones")})

    # At most one entry per slot, packed so that the driver gets a few rows.
    packed = sums.groupBy((F.col("slot") / 65536).cast("int")).applyInArrow(pack, "slot binary, zeros binary, ones binary")
    counts = np.zeros((2, _OFFSETS[-1]), np.float32)
    for row in packed.toLocalIterator():
        slot = np.frombuffer(row["slot"], np.int32)
        counts[0, slot], counts[1, slot] = np.frombuffer(row["zeros"], np.float32), np.frombuffer(row["ones"], np.float32)
    return counts


class Mixer:
    """Gated weights and the last table; ``learn`` moves both after each batch of tokens."""

    def __init__(self, styles: int):
        self.weights = np.full((8, PLACES, len(SLOTS), LEVELS), 0.35)
        self.weights[..., 0] = 0.0
        self.table = np.zeros((2, 8, styles * GRID))

    def run(self, spelling: Spelling, predictors: Predictors, learn: bool) -> np.ndarray:
        """Natural log of the probability of each token; if learning, each is predicted without its own counts."""
        chance = np.ones(len(spelling.symbols))
        gate = spelling.place * (256 * LEVELS)
        for b, bit, slots in spelling.bits():
            said = [predictors.without[s + bit * _OFFSETS[-1]] if learn else predictors.plain[s] for s in slots]
            logit = np.zeros(len(bit), np.float32)
            gated = [gate + what for what in said]
            for k, at in enumerate(gated):
                # Weight times log odds, for every place and everything a slot can say.
                logit += np.take((self.weights[b, :, k, :, None] * _ODDS[:256]).astype(np.float32), at)
            p = 1 / (1 + np.exp(-logit))
            cell = spelling.style * GRID + np.clip(((logit + 9) * (GRID / 18)).astype(np.int64), 0, GRID - 1)
            # The last table; steps with little in them stay near the mixed value.
            seen = self.table[:, b].sum(axis=0) + 50
            refined = np.clip((self.table[1, b] / seen)[cell] + (50 / seen)[cell] * p, 1e-6, 1 - 1e-6)
            chance *= np.abs((1 - bit) - refined)
            if learn:
                wrong = bit - p
                for k, at in enumerate(gated):
                    moved = np.bincount(at, weights=wrong, minlength=PLACES * LEVELS * 256).reshape(-1, 256) @ _ODDS[:256]
                    often = np.maximum(1, np.bincount(at >> 8, minlength=PLACES * LEVELS))
                    self.weights[b, :, k] += RATE * (moved / np.sqrt(often)).clip(-4, 4).reshape(PLACES, LEVELS)
                self.table[1, b] += np.bincount(cell, weights=bit, minlength=self.table.shape[2])
                self.table[0, b] += np.bincount(cell, weights=1 - bit, minlength=self.table.shape[2])
        return np.add.reduceat(np.log(chance), np.concatenate(([0], spelling.ends[:-1]))) if len(chance) else chance


def _learn_mixer(vocabulary: DataFrame, counts, styles: int) -> Mixer:
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, seen, predictors = Mixer(styles), 0, Predictors(counts.value)
        for batch in batches:
            tokens, style = batch.column("token").to_pylist(), batch.column("style").to_numpy()
            for a in range(0, len(tokens), 2000):
                mixer.run(Spelling(tokens[a:a + 2000], style[a:a + 2000]), predictors, True)
                seen += len(tokens[a:a + 2000])
        if seen:
            values = np.concatenate([(mixer.weights * seen).ravel(), mixer.table.ravel(), [seen]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["i", "v"])

    sums = (vocabulary.filter("c_style > 0").select("token", "style").mapInArrow(learn, "i int, v double")
            .groupBy("i").agg(F.sum("v").alias("v")))
    mixer = Mixer(styles)
    size = mixer.weights.size + mixer.table.size + 1  # fixed by the parameters
    values = np.zeros(size)
    for i, v in sums.collect():
        values[i] = v
    if values[-1]:
        mixer.weights = (values[:mixer.weights.size] / values[-1]).reshape(mixer.weights.shape)
        mixer.table = values[mixer.weights.size:-1].reshape(mixer.table.shape)
    return mixer


_WORD_OFFSETS = np.concatenate(([0], np.cumsum([1 << s for s in WORD_SLOTS])))
_START = U(0x94D049BB133111EB)  # stands before the first word
# The gate is the number of contexts whose slot has seen something: the weights of each to begin with.
_WORD_START = np.array([[1.0, 0.0, 0.0], [0.4, 0.6, 0.3], [0.2, 0.4, 0.5]])


class WordBits:
    """Hash bits of tokens that follow each other: for every bit the slots of the predictors."""

    def __init__(self, hashes: np.ndarray, firsts: np.ndarray):
        self.code = word_codes(hashes)
        one, two = np.empty_like(hashes), np.empty_like(hashes)
        one[1:], one[firsts] = hashes[:-1], _START
        two[1:], two[firsts] = one[:-1], _START
        with np.errstate(over="ignore"):
            self.contexts = (mix(one), mix(one * U(0x9FB21C651E98DF25) + mix(two + _START)))

    def __len__(self) -> int:
        return len(self.code)

    def nibbles(self, a: int, b: int):
        """(number of the first bit, code of each token from ``a`` to ``b``, where the slots of the later predictors begin)."""
        code, below = self.code[a:b], np.int64((1 << NIBBLE) - 1)
        for at in range(0, WORD_BITS, NIBBLE):
            head = (code >> (WORD_BITS - at)).astype(U) + U(1 << at)
            with np.errstate(over="ignore"):
                head *= U(0x165667B19E3779F9)
                bases = [((c[a:b] ^ head) * U(0xC2B2AE3D27D4EB4F) >> U(64 - size)).view(np.int64) for c, size in zip(self.contexts, WORD_SLOTS[1:])]
            yield at, code, [(base & ~below) + start for base, start in zip(bases, _WORD_OFFSETS[1:])]

    def bits(self, a: int, b: int):
        """(bit number, its value for each token from ``a`` to ``b``, slots of each predictor), bit by bit."""
        for at, code, bases in self.nibbles(a, b):
            node = np.ones(len(code), np.int64)
            for i in range(at, at + NIBBLE):
                bit = (code >> (WORD_BITS - 1 - i)) & 1
                yield i, bit, [(code >> (WORD_BITS - i)) + (1 << i), *(base + node for base in bases)]
                node = node * 2 + bit

    def leaves(self, a: int, b: int) -> Iterator[np.ndarray]:
        """What ``node_counts`` is made from: the whole code, and every nibble beside the slots of its context."""
        for at, code, bases in self.nibbles(a, b):
            value = (code >> (WORD_BITS - NIBBLE - at)) & ((1 << NIBBLE) - 1)
            yield from (base + value for base in bases)
        yield code

    def paths(self, a: int, b: int):
        """(number of the first bit, the next bits as rows, entry of each predictor in ``word_paths``), nibble by nibble."""
        for at, code, bases in self.nibbles(a, b):
            head = code >> (WORD_BITS - NIBBLE - at)
            value = head & ((1 << NIBBLE) - 1)
            bits = np.stack([((value >> (NIBBLE - 1 - i)) & 1).astype(bool) for i in range(NIBBLE)])
            yield at, bits, [head + (1 << (at + NIBBLE)), *(base + (value + (1 << WORD_BITS)) for base in bases)]


def node_counts(leaves: np.ndarray) -> np.ndarray:
    """Counts of zeros and ones of every slot, as two rows, from how often each leaf was reached."""
    counts = np.zeros((2, len(leaves)), leaves.dtype)
    words, nibbles = leaves[:1 << WORD_BITS], leaves[1 << WORD_BITS:].reshape(-1, 1 << NIBBLE)
    for i in range(WORD_BITS):
        counts[:, 1 << i:2 << i] = words.reshape(1 << i, 2, -1).sum(axis=2).T
    later = counts[:, 1 << WORD_BITS:].reshape(2, -1, 1 << NIBBLE)
    for i in range(NIBBLE):
        later[:, :, 1 << i:2 << i] = np.moveaxis(nibbles.reshape(-1, 1 << i, 2, (1 << NIBBLE) >> (i + 1)).sum(axis=3), 2, 0)
    return counts


def word_paths(predictors: Predictors, learn: bool) -> np.ndarray:
    """What the slots on the way through a nibble say, four in one value, for every context and nibble.

    A lookup then serves four bits.  Entries of the predictor without context are numbered as nodes of the code's
    tree; those of the others follow."""
    size, first = len(predictors.plain), 1 << WORD_BITS
    zero, one = predictors.without.reshape(2, -1) if learn else (predictors.plain, predictors.plain)
    out = np.zeros((size + first, NIBBLE), np.uint16)
    for at in range(0, WORD_BITS, NIBBLE):
        prefix = np.arange(1 << (at + NIBBLE))
        for i in range(NIBBLE):
            slot, bit = (prefix >> (NIBBLE - i)) + (1 << (at + i)), (prefix >> (NIBBLE - 1 - i)) & 1
            out[(1 << (at + NIBBLE)) + prefix, i] = np.where(bit == 1, one[slot], zero[slot])
    value, later = np.arange(1 << NIBBLE), out[2 * first:].reshape(-1, 1 << NIBBLE, NIBBLE)
    for i in range(NIBBLE):
        node, bit = (1 << i) + (value >> (NIBBLE - i)), (value >> (NIBBLE - 1 - i)) & 1
        for v in value:
            later[:, v, i] = (one if bit[v] else zero)[first + node[v]::1 << NIBBLE]
    return out.view(np.uint64).ravel()


def word_codes(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes) >> U(64 - WORD_BITS)).astype(np.int64)


class WordMixer:
    """Gated weights of the predictors of known words; ``learn`` moves them after each chunk of tokens."""

    def __init__(self):
        self.weights = np.tile(_WORD_START[:, :, None], (WORD_BITS, 1, 1, LEVELS))  # by bit, gate, predictor and what its slot has seen
        self.weights[:, :, 1:, 0] = 0.0

    def _tables(self, at: int) -> np.ndarray:
        """Weight times log odds of the bits of a nibble: for every predictor by bit, gate and everything a slot can say."""
        products = self.weights[at:at + NIBBLE, ..., None] * _ODDS[:256]
        return products.astype(np.float32).transpose(2, 0, 1, 3, 4).reshape(len(WORD_SLOTS), -1)

    def run(self, tokens: WordBits, predictors: Predictors, learn: bool) -> np.ndarray:
        """Natural log of the probability of each token's bits; if learning, each is predicted without its own counts."""
        out, paths = np.empty(len(tokens)), predictors.paths(learn)
        gates = len(self.weights[0])
        tables = {at: self._tables(at) for at in range(0, WORD_BITS, NIBBLE)}
        rows = (np.arange(NIBBLE) * (gates * 256 * LEVELS)).astype(np.uint16)[:, None]  # a table has less than 65536 cells
        for a in range(0, len(tokens), WORD_CHUNK):
            chance = 1.0
            for at, bits, entries in tokens.paths(a, a + WORD_CHUNK):
                said = [np.ascontiguousarray(paths[e].view(np.uint16).reshape(-1, NIBBLE).T) for e in entries]
                gate = sum((what >= 256).view(np.uint8) for what in said[1:]).astype(np.uint16) * np.uint16(256 * LEVELS) + rows
                cells = [(gate + what).astype(np.intp) for what in said]
                logit = sum(np.take(t, c) for t, c in zip(tables[at], cells))
                p = np.clip(1 / (1 + np.exp(-logit)), 1e-5, 1 - 1e-5)
                if learn:
                    wrong, size = np.subtract(bits, p, dtype=np.float64).ravel(), len(tables[at][0])
                    for k, cell in enumerate(cells):
                        cell = cell.ravel()
                        moved = np.bincount(cell, weights=wrong, minlength=size).reshape(-1, 256) @ _ODDS[:256]
                        often = np.maximum(1, np.bincount(cell, minlength=size).reshape(-1, 256).sum(axis=1))
                        self.weights[at:at + NIBBLE, :, k] += WORD_RATE * (moved / np.sqrt(often)).clip(-4, 4).reshape(NIBBLE, gates, LEVELS)
                    tables[at] = self._tables(at)
                for bit_chance in np.abs(~bits - p):  # 1 - p of a zero
                    chance = chance * bit_chance.astype(np.float64)
            out[a:a + WORD_CHUNK] = np.log(chance)
        return out


def _word_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[WordBits]:
    for batch in batches:
        for _, _, data, offsets in text_blocks(batch.column("text"), PART_BYTES):
            hashes, *_, firsts = running_words(LOWER[data], offsets)
            yield WordBits(hashes, firsts)


def _count_words(training: DataFrame) -> np.ndarray:
    """Counts of zeros and ones of every slot over the running text of all training documents, as two rows."""
    size = int(_WORD_OFFSETS[-1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size, np.int32)
        for tokens in _word_blocks(batches):
            for a in range(0, len(tokens), WORD_CHUNK):
                for leaf in tokens.leaves(a, a + WORD_CHUNK):
                    np.add.at(found, leaf, np.int32(1))  # of the same type, as another one is ten times as slow
        parts = found.reshape(-1, PACKED)
        for i in np.flatnonzero(parts.any(axis=1)):
            yield pa.RecordBatch.from_pydict({"part": pa.array([i], pa.int32()), "found": pa.array([parts[i].tobytes()], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int32).astype(np.int64) for x in table.column("found"))
        return pa.table({"part": table.column("part").slice(0, 1), "found": pa.array([total.tobytes()], pa.binary())})

    # A task leaves one row for each part of the slots; as many tasks as cores, whatever the input.
    cores = training.sparkSession.sparkContext.defaultParallelism
    sums = (training.coalesce(cores).mapInArrow(count, "part int, found binary")
            .groupBy("part").applyInArrow(add, "part int, found binary"))
    leaves = np.zeros(size, np.int64)
    for row in sums.toLocalIterator():
        leaves[row["part"] * PACKED:(row["part"] + 1) * PACKED] = np.frombuffer(row["found"], np.int64)
    return node_counts(leaves).astype(np.float32)


def _learn_words(training: DataFrame, predictors) -> WordMixer:
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, seen = WordMixer(), 0
        for tokens in _word_blocks(batches):
            mixer.run(tokens, predictors.value, True)
            seen += len(tokens)
        if seen:
            values = np.concatenate([(mixer.weights * seen).ravel(), [seen]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["i", "v"])

    mixer = WordMixer()
    sums = training.mapInArrow(learn, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # as many as weights
    if sums:
        values = np.zeros(mixer.weights.size + 1)
        for i, v in sums:
            values[i] = v
        mixer.weights = (values[:-1] / values[-1]).reshape(mixer.weights.shape)
    return mixer


def _token_codes(column: pa.Array) -> np.ndarray:
    """The hash bits of some tokens, as they have them in running text."""
    codes = [np.zeros(0, np.int64)]
    for _, _, data, offsets in text_blocks(column, PART_BYTES):
        hashes = span_hashes(prefix_sums(data), offsets[:-1], offsets[1:])
        hashes[SPACE[data[offsets[:-1]]]] = U(0)  # the end
        codes.append(word_codes(hashes))
    return np.concatenate(codes)


def _code_totals(vocabulary: DataFrame) -> np.ndarray:
    """Training tokens by their hash bits."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(1 << WORD_BITS, np.int64)
        for batch in batches:
            np.add.at(found, _token_codes(batch.column("token")), batch.column("c").to_numpy())
        used = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(found[used])], names=["code", "n"])

    totals = np.zeros(1 << WORD_BITS)
    for code, n in vocabulary.select("token", "c").mapInArrow(add, "code int, n long").groupBy("code").agg(F.sum("n")).collect():
        totals[code] = n
    return totals


def held_out(key: str, parts: int = 7, rest: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % parts == rest, F.lit(False))


def score_texts(df: DataFrame, key: str = "doc_id", text: str = "text", withheld: Column | None = None) -> DataFrame:
    """For every row ``key``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``
    and ``bits_per_byte``.  ``base_score`` is that of token counts with one added; both are log10 probabilities."""
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"),
                     (held_out(key) if withheld is None else withheld).alias("held_out"))
    training = rows.filter("NOT held_out").select("text")
    words = spark.sparkContext.broadcast(Predictors(_count_words(training)))  # fixed size: WORD_SLOTS
    first = materialize(_first_pass(rows, words, _learn_words(training, words), kind))
    tokens = first.filter("kind = 0").select("batch", "at", "token", "n")
    documents = first.filter("kind = 1").select(F.col("batch").alias("part"), "id", "held_out", "n", "coded", "numbers", "counts", "doubts")

    vocabulary = materialize(tokens.groupBy("token").agg(F.sum("n").alias("c")))
    known = vocabulary.filter("c > 0").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("types"),
                                           F.count(F.when(F.col("c") == 1, 1)).alias("once")).first()
    train_tokens, different = known["n"] or 0, known["types"]
    unit = np.log10(train_tokens + different + 1)
    new_share = (known["once"] + 1) / (train_tokens + 2)
    code_totals = spark.sparkContext.broadcast(_code_totals(vocabulary))  # fixed size: WORD_BITS

    taught = vocabulary.select("token", F.lit(0).alias("style"), F.col("c").alias("c_style"))
    counts = spark.sparkContext.broadcast(_gather_counts(taught))  # fixed size: SLOTS
    mixer = _learn_mixer(taught, counts, 1)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictors = Predictors(counts.value)
        for batch in batches:
            c = batch.column("c").to_numpy().astype(float)
            # Of a known word what its hash bits leave open; its context has been counted already.
            own = np.log10(1 - new_share) + np.log10(np.maximum(c, 1) / np.maximum(1, code_totals.value[_token_codes(batch.column("token"))]))
            new = np.flatnonzero(c == 0)
            for a in range(0, len(new), 5000):
                some = batch.column("token").take(pa.array(new[a:a + 5000])).to_pylist()
                spelled = mixer.run(Spelling(some, np.zeros(len(some), np.int64)), predictors, False)
                own[new[a:a + 5000]] = np.log10(new_share) + spelled / np.log(10)
            yield pa.RecordBatch.from_arrays([batch.column("token"), batch.column("c"), pa.array(own.astype(np.float32))], names=["token", "c", "own"])

    # Every token once, spread evenly: a hashed side, so that the rows of all batches need not be sorted by their bytes.
    judged = vocabulary.mapInArrow(judge, "token binary, c long, own float").hint("shuffle_hash")
    looked_up = tokens.join(judged, "token").select("batch", "at", (F.col("n") == 0).alias("unsure"), "c", "own")

    def total(docs: pa.Table, found: pa.Table) -> pa.Table:
        at, c = found.column("at").to_numpy(), found.column("c").to_numpy()
        values, unsure, new = np.zeros((3, len(at))), np.zeros(len(at), bool), np.zeros(len(at), bool)
        values[:, at] = c > 0, np.log10(c + 1.0) - unit, found.column("own").to_numpy()
        unsure[at], new[at] = found.column("unsure").to_numpy(zero_copy_only=False), c == 0
        out = np.zeros((4, docs.num_rows))
        for i, (numbers, n, doubts) in enumerate(zip(docs.column("numbers"), docs.column("counts"), docs.column("doubts"))):
            n, number = _unpack(n.as_py(), np.uint8), np.cumsum(_unpack(numbers.as_py(), np.uint16)) - 1
            out[0, i] = n.sum()
            out[1:, i] = values[:, number] @ n
            # New words are spelled: what their hash bits cost does not count.
            out[3, i] -= np.frombuffer(doubts.as_py(), np.float32)[new[number[unsure[number]]]].sum(dtype=np.float64)
        out[3] += docs.column("coded").to_numpy()
        size = np.maximum(1, docs.column("n").to_numpy())
        return pa.table({"id": docs.column("id"), "held_out": docs.column("held_out"), "n_tokens": out[0].astype(np.int64),
                         "n_known": np.rint(out[1]).astype(np.int64), "base_score": out[2], "score": out[3],
                         "bits_per_byte": -out[3] / np.log10(2) / size})

    scored = documents.groupBy("part").cogroup(looked_up.groupBy("batch")).applyInArrow(
        total, f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double")
    return scored.select(F.col("id").alias(key), "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"),
                         "base_score", "score", "bits_per_byte")
