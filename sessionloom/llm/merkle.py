"""Merkle manifest of a dataset: leaves, a tree per source, a tree over the sources, and proofs.

Time-forward processing: a node is labelled by its level and its number there, and its digest is a
message to its parent.  Messages wait in a priority queue ordered by label, so a node is
computed when the last of its children has been.  At scale the queue is external: the sorted
shuffle brings the nodes of ``3^HEIGHT`` neighbouring leaves to one place in the order of
their labels, a heap holds the messages inside such a block, and the digests at the top of all blocks
are the next, much smaller sweep.  The reversed sweep goes from the root to the leaves: a
block gets what follows its top in the proofs as one more row of its sorted input, and hands
it down, each level adding the siblings there.  No task holds more than a block, and the
number of sweeps is the logarithm of the largest source to the base 3^HEIGHT.

The digest of a row is SHA-256 (lowercase hex) over its fields, each ``-`` if null, else
length in UTF-8 bytes, ``:``, value.  Digests enter a parent as hex text.  Leaves ascend by key
(null first) and then by digest, so rows that share a key have a defined order; equal rows are
leaves of their own.  Null and empty sources are two sources.  An empty table gives no rows.
Columns other than the named ones are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sessionloom.operators.scale import broadcast_if_small, materialize

ARITY = 3
HEIGHT = 6            # levels of a block: 729 nodes
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def row_digest(fields: Sequence[Column]) -> Column:
    def spelled(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(spelled, fields)), 256)


def join_digests(digests: Sequence[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def sweep_block(nodes: Sequence[tuple[int, str]], total: int, height: int = HEIGHT) -> tuple[str, list[tuple[tuple[int, int], list[str]]]]:
    """Digest at the top of a block, and the children of its inner nodes in the order of labels.

    ``nodes`` are (number, digest) of neighbours, ``total`` how many the whole level has.
    """
    if total == 1:
        return nodes[0][1], []
    queue = [(1, number // ARITY, number, digest) for number, digest in nodes]
    heapq.heapify(queue)
    inner, level, left = [], 0, total
    while True:
        if queue[0][0] > level:
            level, left = queue[0][0], -(-left // ARITY)
        label, children = queue[0][:2], []
        while queue and queue[0][:2] == label:
            children.append(heapq.heappop(queue)[3])
        inner.append((label, children))
        digest = join_digests(children)
        if level == height or left == 1:
            if not queue:
                return digest, inner
            raise ValueError("these nodes have no common top")
        heapq.heappush(queue, (level + 1, label[1] // ARITY, label[1], digest))


def sweep_back(nodes: Sequence[tuple[int, str]], inner: list[tuple[tuple[int, int], list[str]]],
               before: list[str], after: list[str]) -> list[tuple[list[str], list[str]]]:
    """Proof of each node: per level the siblings before and after it, then those given for the top."""
    if not inner:
        return [(before, after)]
    given = {inner[-1][0]: (before, after)}
    for (level, number), children in reversed(inner):
        lefts, rights = given.pop((level, number))
        for slot in range(len(children)):
            given[level - 1, number * ARITY + slot] = (["".join(children[:slot]), *lefts], ["".join(children[slot + 1:]), *rights])
    return [given[0, number] for number, _ in nodes]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _ranked(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``number`` (from 0 in the order of its group) and ``total``, the size of the group."""
    cut = materialize(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
                      .withColumns({"_cut": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    # As many rows as groups and partitions; a group has at most one per partition.
    counts = cut.groupBy(group, "_cut").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_low"))
    of_group = Window.partitionBy(group)
    earlier = of_group.orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(counts.select(group, "_cut", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_low")).alias("_shift"),
                                       F.sum("_n").over(of_group).alias("total")))
    return (cut.join(broadcast_if_small(counts), [group, "_cut"]).withColumn("number", F.col("_at") + F.col("_shift"))
            .drop("_cut", "_at", "_shift"))


def _in_blocks(rows: DataFrame, size: int) -> DataFrame:
    """Blocks as neighbouring rows of one partition, in the order of numbers."""
    block = F.floor(F.col("number") / size)
    return rows.withColumn("block", F.coalesce("block", block)).repartition("tree", "block").sortWithinPartitions("tree", "block", "number")


def _tops(nodes: DataFrame, height: int) -> DataFrame:
    """The nodes one sweep higher, of trees that have several here."""
    size = ARITY**height

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for (tree, block), items in groupby(_rows(batches), key=lambda r: r[:2]):
            items = list(items)
            top, _ = sweep_block([(number, digest) for *_, number, digest, _ in items], items[0][4], height)
            found.append((tree, block, -(-items[0][4] // size), top))
            if len(found) >= 10_000:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, f)) for f in found], schema=schema)
                found = []
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, f)) for f in found], schema=schema)

    schema = pa.schema([("tree", pa.string()), ("number", pa.int64()), ("total", pa.int64()), ("digest", pa.string())])
    rows = _in_blocks(nodes.filter("total > 1").withColumn("block", F.lit(None).cast("long")), size)
    return materialize(rows.select("tree", "block", "number", "digest", "total")
                       .mapInArrow(sweep, "tree string, number long, total long, digest string"))


def _sweeps(nodes: DataFrame, height: int) -> list[DataFrame]:
    levels = [nodes]
    largest = nodes.agg(F.max("total")).first()[0] or 1
    while largest > 1:
        levels.append(_tops(levels[-1], height))
        largest = -(-largest // ARITY**height)
    return levels


_GIVEN = ("before", "after", "top")


def _hand_down(nodes: DataFrame, above: DataFrame, height: int, keep: Sequence[str]) -> DataFrame:
    """``before``, ``after`` and ``top`` of every node, from those of the tops of their blocks (``above``)."""
    size = ARITY**height
    kept = [nodes.schema[c] for c in keep]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for (tree, _), items in groupby(_rows(batches), key=lambda r: r[:2]):
            (_, _, _, _, _, before, after, top, *_), *items = items     # the row of the block's top comes first
            pairs = [(item[2], item[3]) for item in items]
            proofs = sweep_back(pairs, sweep_block(pairs, items[0][4], height)[1], before, after)
            found += [(tree, item[2], item[4], item[3], *proof, top, *item[8:]) for item, proof in zip(items, proofs)]
            if len(found) >= 2_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    texts = pa.list_(pa.string())
    schema = pa.schema([("tree", pa.string()), ("number", pa.int64()), ("total", pa.int64()), ("digest", pa.string()),
                        ("before", texts), ("after", texts), ("top", pa.string()),
                        *((f.name, to_arrow_type(f.dataType)) for f in kept)])
    columns = ["tree", "block", "number", "digest", "total", *_GIVEN, *keep]
    null = lambda kind: F.lit(None).cast(kind)
    below = nodes.withColumns({"block": null("long"), "before": null("array<string>"), "after": null("array<string>"), "top": null("string")})
    tops = above.select("tree", F.col("number").alias("block"), F.lit(-1).cast("long").alias("number"), null("string").alias("digest"),
                        "total", *_GIVEN, *(null(f.dataType).alias(f.name) for f in kept))
    names = ", ".join(["tree string, number long, total long, digest string, before array<string>, after array<string>, top string",
                       *(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)])
    return _in_blocks(below.select(columns).unionByName(tops), size).select(columns).mapInArrow(sweep, names)


def _proofs(levels: list[DataFrame], roots: DataFrame, height: int, keep: Sequence[str]) -> DataFrame:
    """Hand the proofs of ``roots`` (tree, before, after, top) down to the lowest level."""
    known = None
    for i, nodes in reversed(list(enumerate(levels))):
        # Trees that end here start from their roots; one row each.
        ended = nodes.filter("total = 1").join(roots, "tree")
        several = nodes.filter("total > 1")
        mine = tuple(keep) if i == 0 else ()
        columns = ["tree", "number", "total", "digest", *_GIVEN, *mine]
        if known is None:
            known = ended.select(columns)
        else:
            known = ended.select(columns).unionByName(_hand_down(several, known, height, mine).select(columns))
        if i:
            known = materialize(known)
    return known


def manifest(rows: DataFrame, tree: str = "tree", order: Sequence[str] = ("key",), digest: str = "digest",
             keep: Sequence[str] = (), height: int = HEIGHT) -> DataFrame:
    """``leaf``, ``subroot``, ``root`` and the proof of every row, and its columns ``keep``.

    ``rows`` has the leaves' digests (hex) and the tree they belong to (a string that is not null); trees are
    ordered by that name, leaves by ``order`` and digest.  The proof has two lists, ``before``
    and ``after``: joined siblings on either side, level by level up to the root.
    """
    leaves = rows.select(F.col(tree).alias("tree"), F.col(digest).alias("digest"),
                         *(F.col(c).alias(f"_order{i}") for i, c in enumerate(order)), *keep)
    keys = [f"_order{i}" for i in range(len(order))]
    leaves = materialize(_ranked(leaves, "tree", [*keys, "digest"]).drop(*keys))
    low = _sweeps(leaves, height)
    subroots = low[0].filter("total = 1").select("tree", "digest")
    for level in low[1:]:
        subroots = subroots.unionByName(level.filter("total = 1").select("tree", "digest"))
    tops = materialize(_ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "tree", ["name"]))
    high = _sweeps(tops, height)
    nothing = F.array().cast("array<string>")
    root = high[-1].filter("total = 1").select("tree", nothing.alias("before"), nothing.alias("after"), F.col("digest").alias("top"))
    of_trees = materialize(_proofs(high, root, height, ("name",)).select(
        F.col("name").alias("tree"), "before", "after", F.concat(F.col("digest"), F.col("top")).alias("top")))
    found = _proofs(low, of_trees, height, keep)
    return found.select(F.col("digest").alias("leaf"), F.substring("top", 1, 64).alias("subroot"), F.substring("top", 65, 64).alias("root"),
                        "before", "after", *keep)


def fold(leaf: Column, before: Column, after: Column) -> Column:
    """The root that follows from a leaf and its proof."""
    return F.aggregate(F.arrays_zip(before.alias("before"), after.alias("after")), leaf,
                       lambda digest, s: F.sha2(F.concat(s["before"], digest, s["after"]), 256))


def proof_digest(before: Column, after: Column) -> Column:
    return F.sha2(F.array_join(F.zip_with(before, after, lambda b, a: F.concat(b, a)), ""), 256)


def verify_documents(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Manifest of the documents, and whether each is still proven after some have lost their line ends.

    Tampered are the rows whose crc32 of the decimal ``doc_id`` is even; a row without an id is not.
    """
    row = {c: F.col(c) for c in FIELDS}
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    # The name of the tree puts a null source before all others.
    rows = materialize(docs.select(
        "doc_id", F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit("0")).alias("tree"), row_digest(list(row.values())).alias("digest"),
        F.when(tampered, row_digest(list((row | {"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}).values()))).alias("changed")))
    proven = manifest(rows, order=("doc_id",), keep=("doc_id", "changed"), height=height)
    proven = proven.withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("before"), F.col("after")))
    return proven.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("before"), F.col("after")).alias("proof_sha256"), "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))


# SHA-256 trees level by level; the remainder of crc32 is spelled out byte by byte, as the SQL engine has no crc32.
ORACLE = """
WITH RECURSIVE
crc AS (
  SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8),
crcs AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
ids AS (
  SELECT doc_id, 4294967295::BIGINT AS c, CAST(doc_id AS VARCHAR) AS rest FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL SELECT doc_id, xor(c >> 8, t[(xor(c, ascii(rest)::BIGINT) & 255) + 1]), substr(rest, 2) FROM ids, crcs WHERE rest <> ''),
even AS (SELECT doc_id FROM ids WHERE rest = '' AND xor(c, 4294967295) % 2 = 0),
d AS (
  SELECT doc_id, source, text, doc_id IN (SELECT doc_id FROM even) AS tampered,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head
  FROM documents),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN tampered THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS changed
  FROM d),
placed AS (
  SELECT *, coalesce('1' || source, '0') AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves),
low AS (
  SELECT tree, 0 AS lv, pos AS i, n, leaf AS h FROM placed
  UNION ALL
  SELECT tree, lv + 1, i // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY tree, lv, i // 3),
subs AS (SELECT tree, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS lv, pos AS i, n, h FROM subs
  UNION ALL
  SELECT lv + 1, i // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY lv, i // 3),
steps AS (
  SELECT p.tree, p.pos, lv, i, a.h FROM placed p JOIN low a ON a.tree = p.tree AND a.n > 1 AND a.i // 3 = (p.pos // (3 ** a.lv)::BIGINT) // 3
    AND a.i <> p.pos // (3 ** a.lv)::BIGINT
  UNION ALL
  SELECT p.tree, p.pos, 100 + a.lv, a.i, a.h FROM placed p JOIN subs s ON s.tree = p.tree
    JOIN high a ON a.n > 1 AND a.i // 3 = (s.pos // (3 ** a.lv)::BIGINT) // 3 AND a.i <> s.pos // (3 ** a.lv)::BIGINT),
proofs AS (SELECT tree, pos, string_agg(h, '' ORDER BY lv, i) AS siblings FROM steps GROUP BY ALL),
tall AS (
  SELECT tree, pos AS leaf_pos, lv, i, n, coalesce(changed, leaf) AS h FROM placed p, (SELECT 0 AS lv), LATERAL (SELECT p.pos AS i)
  UNION ALL
  SELECT w.tree, w.leaf_pos, w.lv + 1, w.i // 3, (max(w.n) + 2) // 3, sha256(string_agg(CASE WHEN a.i = w.i THEN w.h ELSE a.h END, '' ORDER BY a.i))
  FROM tall w JOIN low a ON a.tree = w.tree AND a.lv = w.lv AND a.i // 3 = w.i // 3 WHERE w.n > 1 GROUP BY w.tree, w.leaf_pos, w.lv, w.i),
over AS (
  SELECT t.tree, t.leaf_pos, 0 AS lv, s.pos AS i, s.n, t.h FROM tall t JOIN subs s ON s.tree = t.tree WHERE t.n = 1
  UNION ALL
  SELECT w.tree, w.leaf_pos, w.lv + 1, w.i // 3, (max(w.n) + 2) // 3, sha256(string_agg(CASE WHEN a.i = w.i THEN w.h ELSE a.h END, '' ORDER BY a.i))
  FROM over w JOIN high a ON a.lv = w.lv AND a.i // 3 = w.i // 3 WHERE w.n > 1 GROUP BY w.tree, w.leaf_pos, w.lv, w.i)
SELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, sha256(coalesce(q.siblings, '')) AS proof_sha256, o.h AS folded_root, o.h = r.h AS verified
FROM placed p JOIN subs s ON s.tree = p.tree LEFT JOIN proofs q ON q.tree = p.tree AND q.pos = p.pos
JOIN over o ON o.tree = p.tree AND o.leaf_pos = p.pos AND o.n = 1, (SELECT h FROM high WHERE n = 1) r"""
