"""The operators' results by plain Python, for small inputs."""

from __future__ import annotations

import math
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def shingles(text, size=5):
    w = words(text)
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def components(texts: dict, similarity=75):
    """The smallest id that each id is connected to."""
    sets = {d: shingles(t) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * 100 >= similarity * max(len(sets[a]), len(sets[b])):
                shared = len(sets[a] & sets[b])
                if 100 * shared >= similarity * (len(sets[a]) + len(sets[b]) - shared):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {d: find(d) for d in texts}, {d: len(s) for d, s in sets.items()}


def covered(texts: list[bytes], length: int) -> list[list[bool]]:
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = [False] * len(t)
        end = 0
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                for j in range(max(i, end), i + length):
                    mark[j] = True
                end = i + length
        out.append(mark)
    return out


def runs(mark: list[bool]) -> int:
    return sum(m and not (i and mark[i - 1]) for i, m in enumerate(mark))


def leaks(texts: dict, items: list[tuple], window=13, agree=11, least=11) -> set:
    split = lambda s: re.findall(r"[^\W_]+", (s or "").lower())
    found = set()
    for d, t in texts.items():
        w = split(t)
        for i, s in items:
            v = split(s)
            n = len(v)
            if i is None or n < least:
                continue
            size = min(window, n)
            need = agree if n >= window else math.ceil(n * agree / window)
            for shift in range(-n, len(w)):
                same = [0 <= shift + j < len(w) and w[shift + j] == v[j] for j in range(n)]
                if sum(same) >= need and max(sum(same[a:a + size]) for a in range(n - size + 1)) >= need:
                    found.add(d)
    return found


def base_scores(texts: dict, held: set):
    train = Counter()
    for d, t in texts.items():
        if d not in held:
            train.update(words(t))
            train["\n"] += 1
    total, different = sum(train.values()), len(train)
    score = lambda w: sum(math.log10((train[x] + 1) / (total + different + 1)) for x in w)
    return {d: (len(words(t)) + 1, sum(train[x] > 0 for x in [*words(t), "\n"]), total, score([*words(t), "\n"])) for d, t in texts.items()}
