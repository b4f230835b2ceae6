"""Filter audit, embedding groups and the Merkle manifest against plain Python."""

import hashlib
import math
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest

from sessionloom.llm import embed_dedup, filter_audit, merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, mask int, id string, tree string, digest string"


def as_docs(spark, rows):
    """Rows (doc_id, text, lang, source) with further columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, len(r[1] or ""), 7, "x", "y", "z") for r in rows], DOCS)


# -- filter interaction ---------------------------------------------------------------------
def plain_audit(docs, labels):
    first, lost, masks = {}, {}, []
    for d, t, *_ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    for d, q, x in labels:
        good, toxic = lost.get(d, (False, False))
        lost[d] = (good or q == 1, toxic or x == 1)
    for d, t, lang, _ in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > first[t]}
        masks.append((lang or "", {f for f in fails if fails[f]}, *(lost.get(d, (False, False)) if d is not None else (False, False))))
    rows = []
    for part in {m[0] for m in masks}:
        mine, shapley = [m for m in masks if m[0] == part], dict.fromkeys("ABCDE", 0)
        some = []
        for order in permutations("ABCDE"):
            for step, f in enumerate(order):
                before = set(order[:step])
                removed = [m for m in mine if f in m[1] and not m[1] & before]
                shapley[f] += len(removed)
                some.append((part, "".join(order), step + 1, sum(not m[1] & (before | {f}) for m in mine), len(removed),
                             sum(f in m[1] and bool(m[1] & before) for m in mine), sum(m[1] == {f} for m in mine),
                             sum(m[2] for m in removed), sum(m[3] for m in removed)))
        rows += [(*r, shapley[r[1][r[2] - 1]]) for r in some]
    return sorted(rows)


def test_audit_of_every_order(spark):
    random.seed(3)
    names = [f"w{i}" for i in range(400)]
    texts = [None, "", "A b", "x " * 300, " ".join(names), " ".join(names) + " #", " ".join(names).upper(), "  \t" + " ".join(names[:250]) + "\n", "é" * 50]
    docs = [(i if i % 11 else None, random.choice(texts), random.choice(["en", "", None, "fr"]), "s") for i in range(300)]
    docs += [(5, texts[4], "en", "s"), (5, texts[4], "en", "s")]
    labels = [(random.randrange(320), random.choice([0, 1, None]), random.choice([0, 1])) for _ in range(200)] + [(None, 1, 1)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit_documents(as_docs(spark, docs), frame)
    assert sorted(map(tuple, got.collect())) == plain_audit(docs, labels)
    assert filter_audit.audit_documents(as_docs(spark, docs).limit(0), frame).count() == 0
    assert filter_audit.audit_documents(as_docs(spark, docs), frame.limit(0)).agg({"good_lost": "max"}).first()[0] == 0


@pytest.mark.parametrize("n", [1, 2, 3, 6])
def test_edge_weights_count_orders(n):
    counted = {}
    for order in permutations(range(n)):
        state = 0
        for f in order:
            counted[state, f] = counted.get((state, f), 0) + 1
            state |= 1 << f
    assert filter_audit.edge_weights(n) == counted


def test_audit_of_other_filters(spark):
    masks = spark.createDataFrame([("p", 3), ("p", 1), ("p", 0), ("q", 2)], "part string, mask int")
    got = {r[:3]: r[3:] for r in map(tuple, filter_audit.audit(masks, "XY").collect())}
    assert got == {("p", "XY", 1): (1, 2, 0, 1, 3), ("p", "XY", 2): (1, 0, 1, 0, 1), ("p", "YX", 1): (2, 1, 0, 0, 1), ("p", "YX", 2): (1, 1, 1, 1, 3),
                   ("q", "XY", 1): (1, 0, 0, 0, 0), ("q", "XY", 2): (0, 1, 0, 1, 2), ("q", "YX", 1): (0, 1, 0, 1, 2), ("q", "YX", 2): (0, 0, 0, 0, 0)}


# -- embeddings -----------------------------------------------------------------------------
def plain_links(rows, similarity=0.93):
    rows = list({(i, x, None if v is None else tuple(map(str, v))): (i, x, v) for i, x, v in rows}.values())
    sound = [i is not None and x is not None and v is not None and all(c is not None and math.isfinite(c) for c in v) and any(v) for i, x, v in rows]
    links = [set() for _ in rows]
    for a, (_, x, v) in enumerate(rows):
        for b in range(a):
            _, y, w = rows[b]
            if sound[a] and sound[b] and x == y:
                n = min(len(v), len(w))
                v1, w1 = np.array(v) / np.abs(v).max(), np.array(w) / np.abs(w).max()
                if v1[:n] @ w1[:n] / math.sqrt((v1 @ v1) * (w1 @ w1)) >= similarity:
                    links[a].add(b)
                    links[b].add(a)
    out = []
    for a, (i, *_) in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            more = links[todo.pop()] - seen
            seen |= more
            todo += more
        low = i if i is None else min(rows[b][0] for b in seen)
        out.append((i, len(links[a]), low, low == i))
    return sorted(out, key=str)


def families(seed, count, width, label=1, noise=0.25):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((max(1, count // 12), width))
    picks = rng.integers(0, len(centres), count)
    return [(int(i), label, [float(c) for c in np.float32(centres[p] + noise * rng.standard_normal(width))]) for i, p in enumerate(picks)]


@pytest.mark.parametrize("kind, bucket, block", [("float", 512, 1024), ("double", 40, 16)])
def test_links_of_odd_vectors(spark, kind, bucket, block):
    rows = families(1, 260, 24) + [(1000 + i, 2, v) for i, _, v in families(2, 60, 24)]
    rows += [(2000 + i, 1, rows[7][2]) for i in range(40)]                        # copies
    rows += [(rows[3][0], 1, rows[3][2]), (rows[4][0], 1, rows[9][2])]            # a repeated row, a shared id
    rows += [(3000, None, rows[0][2]), (None, 1, rows[0][2]), (3001, 1, None), (3002, 1, []), (3003, 1, [0.0] * 24), (3004, 1, [None] * 24),
             (3005, 1, [float("nan")] * 24), (3006, 1, [float("inf")] + [1.0] * 23), (3007, 5, [1.0]), (3008, 5, [2.0, 0.1]), (3009, 5, [-1.0])]
    if kind == "double":
        rows += [(3010, 6, [1e308] * 24), (3011, 6, [1e-300] * 24)]
    schema = f"vec_id long, label int, embedding array<{kind}>, id string, class int, n int, v string"
    df = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], schema)
    got = sorted(map(tuple, embed_dedup.link_vectors(df, bucket=bucket, block=block).collect()), key=str)
    assert got == plain_links(rows)
    assert embed_dedup.link_vectors(df.limit(0)).count() == 0


def test_recall_of_bands_at_the_threshold():
    rng = np.random.default_rng(4)
    a = embed_dedup.unit(rng.standard_normal((4000, 64)))
    side = rng.standard_normal((4000, 64))
    side = embed_dedup.unit(side - (side * a).sum(axis=1, keepdims=True) * a)
    b = 0.9301 * a + math.sqrt(1 - 0.9301**2) * side
    bits, bands = embed_dedup.plan_bands(5_000_000, 0.93)
    x, y = (np.unpackbits(embed_dedup.code(v, bits * bands)[0], axis=1)[:, :bits * bands].reshape(4000, bands, bits) for v in (a, b))
    assert (x == y).all(axis=2).any(axis=1).mean() > 0.999


@pytest.mark.parametrize("width", [2, 64, 300])
def test_estimates_are_unbiased_and_bounded(width):
    rng = np.random.default_rng(6)
    a, b = (embed_dedup.unit(rng.standard_normal((600, width))) for _ in range(2))
    packed, factor = embed_dedup.code(b, width)
    signs = np.unpackbits(packed, axis=1)[:, :width].astype(float)
    estimate, error = embed_dedup.bounds(a @ embed_dedup.rotation(width, 0).T, signs, factor)
    wrong = estimate - a @ b.T
    assert (np.abs(wrong) <= error[None, :] + 1e-9).mean() > 0.9998 and abs(wrong.mean()) < 0.01


# -- manifest -------------------------------------------------------------------------------
def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves):
    """(root, per leaf its list of (before, after))."""
    proofs, at = [[] for _ in leaves], list(range(len(leaves)))
    while len(leaves) > 1:
        for p, i in zip(proofs, at):
            run = leaves[i // 3 * 3:i // 3 * 3 + 3]
            p.append(("".join(run[:i % 3]), "".join(run[i % 3 + 1:])))
        leaves = [sha("".join(leaves[i:i + 3])) for i in range(0, len(leaves), 3)]
        at = [i // 3 for i in at]
    return leaves[0], proofs


def plain_manifest(docs):
    def leaf(d, t, lang, s):
        return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (d, s, lang, len(t or ""), t)))

    trees = {}
    for d, t, lang, s in docs:
        trees.setdefault(s, []).append((d, leaf(d, t, lang, s), (t or "").replace("\n", "") if t is not None else None, lang, len(t or "")))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        trees[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    low = {s: plain_tree([r[1] for r in trees[s]]) for s in names}
    root, tops = plain_tree([low[s][0] for s in names])
    out = []
    for s, top in zip(names, tops):
        for (d, own, cut, lang, n), proof in zip(trees[s], low[s][1]):
            shown = own
            if d is not None and zlib.crc32(str(d).encode()) % 2 == 0:
                shown = sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (d, s, lang, n, cut)))
            for before, after in [*proof, *top]:
                shown = sha(before + shown + after)
            out.append((d, own, low[s][0], root, sha("".join(b + a for b, a in [*proof, *top])), shown, shown == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest_of_odd_rows(spark, height):
    random.seed(height)
    docs = [(i, random.choice(["a\nb", "plain", None, "", "é\n\n", "x" * 50]), random.choice(["en", None]), "hot") for i in range(170)]
    docs += [(1000 + i, "line\n", "de", random.choice([None, "", "é", "z", "a b", "Z"])) for i in range(40)]
    docs += [(5000 + i, "t\n", None, f"s{i}") for i in range(30)]                                  # sources of one row
    docs += [(None, "no id\n", "en", "hot"), (None, None, None, None), (3, "same id", "en", "hot"), (9, "again\n", "en", "z"), (9, "again\n", "en", "z")]
    random.shuffle(docs)
    got = merkle.verify_documents(as_docs(spark, docs), height=height)
    assert sorted(map(tuple, got.collect()), key=str) == plain_manifest(docs)
    assert merkle.verify_documents(as_docs(spark, docs).limit(0), height=height).count() == 0
    one = [(None, None, None, None)]
    assert list(map(tuple, merkle.verify_documents(as_docs(spark, one)).collect())) == plain_manifest(one)


def test_blocks_give_the_tree_of_all_nodes():
    for n in (1, 2, 3, 4, 9, 10, 28, 81, 82):
        leaves = [sha(str(i)) for i in range(n)]
        top, inner = merkle.sweep_block(list(enumerate(leaves)), n, 9)
        root, proofs = plain_tree(leaves)
        assert top == root
        assert [list(zip(*p)) if p[0] else [] for p in merkle.sweep_back(list(enumerate(leaves)), inner, [], [])] == proofs
