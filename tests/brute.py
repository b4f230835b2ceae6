"""Plain-Python versions of the sequential operators, for small fixtures."""

from __future__ import annotations


def command(message):
    return message.split(": ", 1)[1].strip() if ": " in message else None


def undo_redo(rows):
    """``rows``: (seq, message) of one session in order; the kept seqs."""
    recent, undone, gone = [], [], set()
    for seq, message in rows:
        cmd = command(message)
        if message.startswith("End Event:"):
            if cmd is not None:
                recent.append((seq, cmd))
        elif message.startswith(("Undo Event: ", "Undo and Remove Action: ")):
            gone.add(seq)
            hit = next((e for e in reversed(recent) if e[1] == cmd), None)
            if hit:
                recent.remove(hit)
                gone.add(hit[0])
                if message.startswith("Undo Event: "):
                    undone.append(hit)
        elif message.startswith("Redo Event:"):
            gone.add(seq)
            hit = next((e for e in reversed(undone) if e[1] == cmd), None)
            if hit:
                undone.remove(hit)
                gone.discard(hit[0])
    return [seq for seq, _ in rows if seq not in gone]


def collapse(rows):
    """(seq, item) of one session: last seq, item and length of each run; null equals nothing."""
    out = []
    for seq, item in rows:
        if out and item is not None and out[-1][1] == item:
            out[-1] = (seq, item, out[-1][2] + 1)
        else:
            out.append((seq, item, 1))
    return out


def merge_all(items, patterns):
    for pattern in patterns:
        out, i = [], 0
        while i < len(items):
            if items[i:i + len(pattern)] == pattern:
                out.append(",".join(pattern))
                i += len(pattern)
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def merge_first(items, patterns):
    out, i = [], 0
    while i < len(items):
        for pattern in patterns:
            if items[i:i + len(pattern)] == pattern:
                out.append(", ".join(pattern))
                i += len(pattern)
                break
        else:
            out.append(items[i])
            i += 1
    return out


def replace_low_level(rows, pairs, before, after, n_next=5, n_prev=1):
    """``rows``: (label, ts, cat, text) of one session in order; the kept labels."""
    dropped = set()
    for label, ts, cat, text in reversed(rows):
        if cat not in ("Tool", "Menu"):
            continue
        view = [r for r in rows if r[0] not in dropped and r[2] == "UNDO"
                and (before is None or label - before <= r[0]) and (after is None or r[0] <= label + after)]
        near = [r for r in view if r[1] >= ts][:n_next] + [r for r in view if r[1] < ts][:n_prev]
        if not near:
            dropped.add(label)
        elif text in pairs:
            hit = next((r for r in near if r[3] in pairs[text]), None)
            dropped.add(label if hit is None else hit[0])
    return [r[0] for r in rows if r[0] not in dropped]


def greedy_batches(tokens, limit):
    batch, filled, out = 0, None, []
    for t in tokens:
        if filled is None or filled + t > limit:
            batch, filled = batch + 1, 0
        filled += t
        out.append(batch)
    return out


def components(points, eps):
    import numpy as np

    n = len(points)
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if np.sqrt(((points[i] - points[j]) ** 2).sum()) <= eps and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def silhouette(points, labels):
    import numpy as np

    n, kinds = len(points), sorted(set(labels))
    if len(kinds) <= 1 or len(kinds) == n:
        return 1.0
    far = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    labels = np.array(labels)
    out = []
    for i in range(n):
        own = (labels == labels[i]).sum()
        if own == 1:
            out.append(0.0)
            continue
        a = far[i][labels == labels[i]].sum() / (own - 1)
        b = min(far[i][labels == k].mean() for k in kinds if k != labels[i])
        out.append((b - a) / max(a, b))
    return float(np.mean(out))
