"""Decontamination, near duplicates, top-k, scores, repeats and quotations against plain Python."""

import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import plain
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sessionloom.llm import decontam, graph, lm, neardup, quotes, repeats, topk
from sessionloom.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def texts_of(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


# -- decontamination ------------------------------------------------------------------------
def test_masks_survive_two_replaced_words():
    for window, lost in ((13, 2), (12, 1), (11, 1)):
        places = range(window)
        for a in places:
            for b in places if lost == 2 else [a]:
                assert any(not {a, b} & {o + p for p in mask} for mask in decontam.MASKS for o in range(window - decontam.SPAN + 1))


def test_leaks(spark):
    random.seed(5)
    names = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(random.choices(names, k=random.choice([5, 11, 12, 13, 20, 40])))) for i in range(30)]
    items += [(100, items[3][1]), (101, None), (102, ""), (None, " ".join(names[:14]))]
    docs = []
    for d in range(150):
        w = random.choices(names, k=random.randint(0, 80))
        if random.random() < 0.7:
            v = [x if random.random() > 0.1 else "zz" for x in (random.choice(items)[1] or "").split()]
            k = random.randint(0, len(w))
            w[k:k] = v[random.choice([0, 0, 3]):]
        docs.append((d, ". ".join(w).upper()))
    docs += [(900, None), (901, ""), (902, items[3][1] + " x" * 30_000)]
    df = spark.createDataFrame([(*d, 1, "y") for d in docs], "doc_id long, text string, item int, h string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = plain.leaks(dict(docs[:-1]), items) | {902}
    marked = decontam.mark_leaks(df, bench).collect()
    assert {r["doc_id"] for r in marked if r["contaminated"]} == want and len(marked) == len(docs)
    assert {r["doc_id"] for r in decontam.drop_leaks(df, bench).collect()} == {d for d, _ in docs} - want
    assert decontam.find_leaks(df, bench.limit(0)).count() == 0 and decontam.mark_leaks(df.limit(0), bench).count() == 0
    null_id = spark.createDataFrame([(None, items[3][1]), (None, "clean")], "doc_id long, text string")
    assert decontam.drop_leaks(null_id, bench).count() == 0


def test_decontamination_query(spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    found = {r["doc_id"] for r in QUERIES["op2_decontamination"](spark, SMALL).filter("contaminated").collect()}
    assert found == plain.leaks({d: (t or "")[:20_000] for d, t in texts_of(spark).items()}, items)


def test_leaks_of_rows_that_share_an_id(spark):
    item = " ".join(f"w{i}" for i in range(14))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    df = spark.createDataFrame([(None, item), (None, "clean"), (None, None), (4, item), (4, "other")], "doc_id long, text string")
    marked = [(r["doc_id"], r["contaminated"]) for r in decontam.mark_leaks(df, bench).collect()]
    assert sorted(marked, key=str) == [(4, False), (4, True), (None, False), (None, False), (None, True)]
    left = [(r["doc_id"], r["text"]) for r in decontam.drop_leaks(df, bench, by_row=True).collect()]
    assert sorted(left, key=str) == [(4, "other"), (None, "clean"), (None, None)]


def test_leaks_count_every_item(spark):
    """Copies of items, and items that share a preamble, each count; so do their words."""
    random.seed(8)
    words = lambda n: [f"w{random.randrange(5000)}" for _ in range(n)]
    preamble, other = words(20), words(13)
    items = {i: preamble + words(10) for i in range(10)} | {20: words(4) + preamble[3:] + words(2), 30: other, 31: other, 32: other + words(6), 33: other[:12], 34: other[:12]}
    items[9] = items[3]
    texts = {0: words(5) + preamble + words(5), 1: items[3], 2: items[9][5:] + other, 3: words(3) + items[32], 4: other[:12], 5: words(40)}

    def matched(text, item):
        size, found = min(13, len(item)), 0
        for shift in range(-len(item), len(text)):
            same = [0 <= shift + j < len(text) and text[shift + j] == w for j, w in enumerate(item)]
            if max(sum(same[a:a + size]) for a in range(len(item) - size + 1)) >= 11:
                found = max(found, sum(same))
        return found

    df = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")
    for r in decontam.mark_leaks(df, bench).collect():
        want = {i: m for i, t in items.items() if (m := matched(texts[r["doc_id"]], t))}
        assert (r["n_items"], r["item_id"], r["matched"]) == (len(want), min(want, default=None), max(want.values(), default=0)), r


# -- near duplicates ------------------------------------------------------------------------
def test_near_duplicates_query(spark):
    texts = texts_of(spark)
    component, size = plain.components(texts)
    rows = QUERIES["op6_near_duplicates"](spark, SMALL).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows} == {
        d: (size[d], component[d], component[d] == d) for d in texts}


def test_near_duplicates_of_families_and_odd_rows(spark):
    random.seed(9)
    names = [f"w{i}" for i in range(500)]
    texts, number = {}, 0
    for family in range(12):
        base = random.choices(names, k=random.choice([3, 5, 8, 20, 60, 150]))
        for _ in range(random.choice([1, 3, 25])):
            copy = list(base)
            for _ in range(random.randint(0, max(1, len(base) // 25))):
                copy[random.randrange(len(copy))] = random.choice(names)
            texts[number] = random.choice([" ", "\n", "  "]).join(copy)
            number += 1
    passage = " ".join(random.choices(names, k=40))
    for _ in range(40):  # a shared passage alone makes no link
        texts[number] = passage + " " + " ".join(random.choices(names, k=random.randint(8, 30)))
        number += 1
    texts |= {1000: None, 1001: "", 1002: " \t", 1003: "One", 1004: "one", 1005: "x " * 30_000}
    component, size = plain.components(texts)
    df = spark.createDataFrame([(d, t, 1) for d, t in texts.items()], "doc_id long, text string, n int")
    rows = neardup.near_duplicates(df).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == {d: (size[d], component[d]) for d in texts}
    odd = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in neardup.near_duplicates(odd).collect()) == [
        (0, None, True), (3, 3, True), (7, 3, False), (7, 3, False)]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_signatures_agree_like_sets():
    rng = np.random.default_rng(1)
    every = rng.integers(0, 2**63, 4000).astype(np.uint64)
    for shared, own in ((300, 50), (12, 2), (3, 1)):
        pairs = [(np.unique(every[i:i + shared + own]), np.unique(np.concatenate([every[i:i + shared], every[i + 2000:i + 2000 + own]])))
                 for i in range(0, 900, 30)]
        agree = np.mean([(neardup.signatures([a]) == neardup.signatures([b])).mean() for a, b in pairs])
        assert abs(agree - shared / (shared + 2 * own)) < 0.08


def test_star_forest(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (100, 60), (7, 7)]
    found = {r["a"]: r["b"] for r in graph.star_forest(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, 60: 50, 100: 50}


# -- top-k ----------------------------------------------------------------------------------
@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_topk_with_odd_vectors(spark, scale):
    random.seed(2)
    vectors = [(i, [random.uniform(-2, 2) * scale for _ in range(6)]) for i in range(120)]
    vectors += [(200 + i, vectors[0][1]) for i in range(30)]  # ties
    bad = [(400, None), (401, [1.0, None]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (None, [1.0] * 6)]
    odd = [(420, []), (421, [1.0]), vectors[20], vectors[20]]
    df = spark.createDataFrame(vectors + bad + odd, "vec_id long, embedding array<double>")
    numbers = {i: [math.floor(64 * x) for x in v] for i, v in vectors + odd}
    want = []
    for q in numbers:
        if q % 20 == 0:
            ranked = sorted((-sum(x * y for x, y in zip(numbers[q], v)), i) for i, v in numbers.items() if i != q)[:20]
            want += [(q, rank + 1, i, -score) for rank, (score, i) in enumerate(ranked)]
    found = topk.exact_topk(df, df.filter("vec_id % 20 = 0"), vector_block=16, query_block=4)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert topk.exact_topk(df.limit(0), df.limit(0)).count() == 0


def test_topk_does_not_broadcast_tiles(spark):
    """Packed queries are a small file, but every block of vectors meets a copy of them."""
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(60)], "vec_id long, embedding array<double>")
    found = topk.exact_topk(df, df, k=2, vector_block=4, query_block=8)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [block" in plan and "BroadcastHashJoin [block" not in plan
    assert found.count() == 120


# -- language model -------------------------------------------------------------------------
def test_scores_query(spark):
    texts = texts_of(spark)
    held = {d for d in texts if zlib.crc32(str(d).encode()) % 7 == 2}
    want = plain.base_scores(texts, held)
    rows = QUERIES["op8_lm_score"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        tokens, known, total, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (r["doc_id"] in held, tokens, known, total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0


def test_scores_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "word " * 50_000), (None, "no id"), (5, "a b"), (5, "a b"), (6, "é\x00\x01 z")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, style int")
    found = lm.score_texts(df).collect()
    assert len(found) == len(rows) and all(math.isfinite(r["score"]) for r in found)
    assert lm.score_texts(df.limit(0)).count() == 0
    from pyspark.sql import functions as F
    untaught = lm.score_texts(df, withheld=F.lit(True)).collect()
    assert {r["train_tokens"] for r in untaught} == {0} and all(math.isfinite(r["score"]) for r in untaught)


def test_a_batch_takes_little_memory_for_its_text():
    random.seed(3)
    names = [f"w{random.randrange(10**6)}" for _ in range(30_000)]
    texts = [" ".join(names[int(len(names) * random.random() ** 3)] for _ in range(400)) for _ in range(1500)]
    column, size = pa.array(texts, pa.string()), sum(len(t) for t in texts)
    predictors = lm.Predictors(np.zeros((2, int(lm._WORD_OFFSETS[-1])), np.float32))
    predictors.paths(False)
    tracemalloc.start()
    tokens, doc, token, count, coded, of_text = lm.batch_tokens(column, lm.WordMixer(), predictors)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * size
    found = Counter({(d, tokens[t]): n for d, t, n in zip(doc.tolist(), token.tolist(), count.tolist())})
    assert found == Counter((d, w) for d, t in enumerate(texts) for w in [*(x.encode() for x in t.split(" ")), lm.END])
    assert len(of_text) == len(texts) and np.allclose(np.bincount(doc, weights=coded), of_text, rtol=1e-4)


def test_spelling_is_a_probability():
    """Over all bytes that can follow, the first bytes of a token add up to one."""
    tokens = [bytes([c]) for c in range(256)]
    predictors = lm.Predictors(lm.slot_counts([b"ab", b"abc", b"b"] * 5, np.zeros(15, np.int64)))
    mixer = lm.Mixer(1)
    both = mixer.run(lm.Spelling(tokens, np.zeros(256, np.int64)), predictors, False)
    closing = [mixer.run(lm.Spelling([t + bytes([c]) for c in range(256)], np.zeros(256, np.int64)), predictors, False) for t in (b"a", b"b")]
    assert np.exp(both).sum() < 1 and all(np.exp(c).sum() < 1 for c in closing)
    assert both[ord("b")] > both[ord("z")]
    for size, (_, _, slots) in zip(lm.SLOTS, lm.Spelling([b"q"], np.zeros(1, np.int64)).bits()):
        assert all(start <= x.min() and x.max() < end for x, start, end in zip(slots, lm._OFFSETS, lm._OFFSETS[1:]))


def test_mixer_learns_from_repeated_words(spark):
    """With every word twice in its style the weights and the last table still move."""
    tokens = [b"abc", b"abd", b"bcd", b"aabc"]
    counts = spark.sparkContext.broadcast(lm.slot_counts(tokens, np.zeros(4, np.int64)).astype(np.float32))
    vocabulary = spark.createDataFrame([(bytearray(t), 0, 2) for t in tokens], "token binary, style int, c_style long")
    mixer, start = lm._learn_mixer(vocabulary, counts, 1), lm.Mixer(1)
    assert mixer.table.sum() == 8 * sum(len(t) + 1 for t in tokens)
    assert not np.array_equal(mixer.weights, start.weights)


def test_known_words_are_scored_in_their_context(spark):
    """A text scores higher than its words in another order, if training text has that order."""
    order = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(order[i % 12:] + order[:i % 12]), False) for i in range(60)]
    rows += [(100, " ".join(order), True), (101, " ".join(order[::-1]), True), (102, " ".join(order) + " unseen", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, withheld boolean").repartition(3)
    found = {r["doc_id"]: r for r in lm.score_texts(df, withheld=F.col("withheld")).collect()}
    assert math.isclose(found[100]["base_score"], found[101]["base_score"])
    assert found[100]["score"] > found[101]["score"] + 1
    assert found[102]["n_tokens"] - found[102]["n_known"] == 1 and found[102]["score"] < found[100]["score"]


def test_bits_of_words_are_a_probability():
    """The codes that may follow two words add up to one."""
    n = 1 << lm.WORD_BITS
    texts = lm.WordBits(np.arange(1, 301, dtype=np.uint64) % np.uint64(7), np.arange(0, 300, 3))
    counts = np.zeros((2, lm._WORD_OFFSETS[-1]), np.float32)
    for _, bit, slots in texts.bits(0, 300):
        for s in slots:
            np.add.at(counts, (bit, s), 1)
    predictors, mixer, every = lm.Predictors(counts), lm.WordMixer(), lm.WordBits(np.ones(n, np.uint64), np.array([0]))
    mixer.run(texts, predictors, True)
    every.code = np.arange(n)
    every.contexts = tuple(np.full(n, c[4]) for c in texts.contexts)
    assert math.isclose(np.exp(mixer.run(every, predictors, False)).sum(), 1, abs_tol=1e-4)


def test_nibbles_give_what_single_bits_give():
    """Counts by leaf and lookups by path equal counting and mixing bit by bit."""
    random.seed(8)
    texts = lm.WordBits(np.array([random.randint(1, 40) for _ in range(3000)], np.uint64), np.arange(0, 3000, 50))
    size, n = int(lm._WORD_OFFSETS[-1]), len(texts)
    counts, leaves = np.zeros((2, size), np.int64), np.zeros(size, np.int64)
    for _, bit, slots in texts.bits(0, n):
        for s in slots:
            np.add.at(counts, (bit, s), 1)
    for leaf in texts.leaves(0, n):
        np.add.at(leaves, leaf, 1)
    assert np.array_equal(lm.node_counts(leaves), counts)
    predictors, mixer, odds = lm.Predictors(counts.astype(np.float32)), lm.WordMixer(), lm._ODDS.reshape(lm.LEVELS, 256)
    for learn in (False, True):
        want, start = np.zeros(n), mixer.weights.copy()
        for b, bit, slots in texts.bits(0, n):
            said = [predictors.without[s + bit * size] if learn else predictors.plain[s] for s in slots]
            gate = sum((what >= 256).astype(int) for what in said[1:])
            logit = sum(start[b, gate, k, what >> 8] * odds[0, what & 255] for k, what in enumerate(said))
            p = np.clip(1 / (1 + np.exp(-logit)), 1e-5, 1 - 1e-5)
            want += np.log(np.where(bit == 1, p, 1 - p))
        assert np.allclose(mixer.run(texts, predictors, learn), want, rtol=1e-4)
    assert not np.array_equal(mixer.weights, start)


def test_counts_of_a_task_have_one_number_per_slot(spark, monkeypatch):
    """What a counting task leaves is half of what it would be with zeros and ones of every slot."""
    sent = []
    whole = lm.node_counts
    monkeypatch.setattr(lm, "node_counts", lambda leaves: sent.append(leaves.shape) or whole(leaves))
    training = spark.createDataFrame([("a b a b",), ("b",), (None,)], "text string")
    counts = lm._count_words(training)
    assert sent == [(lm._WORD_OFFSETS[-1],)]
    # Eight tokens, the ends among them, each with one bit at the root of every predictor's tree.
    assert counts.shape == (2, lm._WORD_OFFSETS[-1]) and counts[:, 1].sum() == 8 and counts.sum() == 8 * lm.WORD_BITS * len(lm.WORD_SLOTS)


# -- repeats --------------------------------------------------------------------------------
def test_run_length_index():
    random.seed(1)
    for _ in range(150):
        length = random.choice([3, 5, 8])
        texts = [bytes(random.choice(b"ab\x00c") for _ in range(random.randint(0, 60))) for _ in range(random.randint(1, 8))]
        texts += texts[:random.randint(0, 1)]
        for text, spans, want in zip(texts, repeats.repeat_spans(texts, length), plain.covered(texts, length)):
            mark = [False] * len(text)
            for a, b in spans:
                mark[a:b] = [True] * (b - a)
            assert mark == want


def check_repeats(rows, texts, length=200):
    content = [(t or "").encode() for _, t in texts]
    want = {d: (c, m) for (d, _), c, m in zip(texts, content, plain.covered(content, length))}
    assert len(rows) == len(texts)
    for r in rows:
        c, mark = want[r["doc_id"]]
        kept = bytes(x for x, m in zip(c, mark) if not m)
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (
            len(c), sum(mark), plain.runs(mark), hashlib.sha256(kept).hexdigest()), r["doc_id"]


def test_repeats_query(spark):
    check_repeats(QUERIES["op9_repeats"](spark, SMALL).collect(), list(texts_of(spark).items()))


@pytest.mark.parametrize("group", [4096, 3])
def test_repeats_of_hot_passages_and_odd_rows(spark, group):
    """With a limit of three pieces per anchor every shared passage is split down."""
    random.seed(4)
    noise = lambda n: "".join(random.choice("abcdé ") for _ in range(n))
    passage, other = noise(260), noise(201)
    texts = [(i, noise(random.randint(0, 300)) + random.choice([passage, other, passage[30:250], ""]) + noise(random.randint(0, 90)))
             for i in range(40)]
    texts += [(100, None), (101, ""), (102, "a" * 700), (103, texts[0][1]), (104, "ab" * 250), (None, noise(300))]
    df = spark.createDataFrame([(*t, 1, "z") for t in texts], "doc_id long, text string, a int, t string")
    check_repeats(repeats.measure_repeats(df, group=group).collect(), texts)
    cut = repeats.cut_repeats(df, group=group)
    assert cut.columns == df.columns and cut.count() == len(texts)
    assert {r["doc_id"]: r["text"] for r in cut.collect()}[102] == ""
    assert repeats.measure_repeats(df.limit(0)).count() == 0


# -- quotations -----------------------------------------------------------------------------
def test_quotations(spark):
    rows = [(1, 0, "user", "Hello there\nHow are you?"), (1, 1, "bot", "> How  are you?\nFine."),
            (1, 2, "user", "On Monday X wrote:\n> Fine.\n>> how are you?\nGood\nbye"), (1, 3, "bot", ">>> deep\n> Good\n> bye\nend"),
            (1, 3, "bot", ">>> deep\n> Good\n> bye\nend"), (1, 4, "user", None), (1, 5, "user", ""), (1, 6, "u", "> not said\nhm"),
            (1, 7, "u", "\r\n>Good\r\n> > end\r\nok"), (2, 0, "u", "> Fine.\nx"), (None, 1, "u", "> x"), (2, None, "u", "x"),
            (3, 0, "u", "a\n" * 20_000), (3, 1, "u", "> a\nb")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, message int, p int")
    found = [tuple(r) for r in quotes.link_quotes(df).drop("role").collect()]
    content = {(c, t): x for c, t, x, *_ in found}
    assert len(found) == len(rows) and content.pop((3, 0)) == ("a\n" * 20_000).strip()
    assert set(found) - {f for f in found if f[:2] == (3, 0)} == {
        (1, 0, "Hello there\nHow are you?", 0, 0, None, 0, 0), (1, 1, "Fine.", 1, 1, 0, 0, 1), (1, 2, "Good\nbye", 2, 2, 1, 0, 2),
        (1, 3, "end", 2, 2, 2, 0, 3), (1, 4, "", 0, 0, None, 4, 0), (1, 5, "", 0, 0, None, 5, 0), (1, 6, "hm", 1, 0, None, 6, 0),
        (1, 7, "ok", 2, 2, 2, 0, 3), (2, 0, "x", 1, 0, None, 0, 0), (None, 1, "", 1, 0, None, 1, 0), (2, None, "x", 0, 0, None, None, 0),
        (3, 1, "b", 1, 1, 0, 0, 1)}
    assert quotes.link_quotes(df.limit(0)).count() == 0


def test_quotations_query_keeps_every_message(spark):
    rows = spark.read.parquet(f"{SMALL}/conversations.parquet").collect()
    found = QUERIES["op10_quotations"](spark, SMALL).collect()
    assert sorted((r["conv_id"], r["turn"], r["content"]) for r in found) == sorted((r["conv_id"], r["turn"], r["text"].strip()) for r in rows)
