"""All-pairs work in large groups, by strips of packed points.

The points of a group are numbered and packed into tiles.  A strip is one tile that stays in a task while the
tiles it has to meet stream by, so a task holds two tiles and what it has found so far, and a point is
sent as bytes once per strip, not as a row per tile and bound.  Only summaries leave a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sessionloom.operators.scale import materialize, same_keys, small_table

STRIP = 4096
# Rows of a strip whose distances to a tile are held at a time.
CHUNK = 128
# Rows of an Arrow batch of results.
_ROWS = 1 << 16


# -- packing and streaming ---------------------------------------------------------------------
def pack(points: DataFrame, group: str, vector: str, size: int, number: str = "_n", roots: str | None = None) -> DataFrame:
    """Tiles of ``size`` consecutive points: ``_g``, ``_t``, ``_rows``, ``_data`` and, if asked, ``_roots`` (one row per level)."""
    kind = points.schema[vector].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    plain = points.select(F.col(group).alias("_g"), F.floor((F.col(number) - 1) / size).cast("bigint").alias("_t"), F.col(number).alias("_n"),
                          (F.col(vector) if single else F.col(vector).cast("array<double>")).alias("_v"),
                          (F.col(roots) if roots else F.lit(None).cast("array<int>")).alias("_r"))
    key_type = to_arrow_schema(plain.select("_g").schema).field(0).type
    schema = pa.schema([("_g", key_type), ("_t", pa.int64()), ("_rows", pa.int32()), ("_data", pa.binary()), ("_roots", pa.binary())])

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by("_n").combine_chunks()
        column = table.column("_v").combine_chunks()
        lengths = np.diff(column.offsets.to_numpy())
        if column.null_count or (lengths != lengths[0]).any():
            raise ValueError("all vectors of a group must have the same length")
        data = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32 if single else np.float64)
        levels = b""
        if roots:
            levels = table.column("_r").combine_chunks().flatten().to_numpy().astype(np.int32).reshape(table.num_rows, -1).T.tobytes()
        return pa.Table.from_arrays([table.column("_g").slice(0, 1).combine_chunks().cast(key_type), table.column("_t").slice(0, 1), pa.array([table.num_rows], pa.int32()),
                                     pa.array([data.tobytes()], pa.binary()), pa.array([levels], pa.binary())], schema=schema)

    layout = f"_g {plain.schema['_g'].dataType.simpleString()}, _t bigint, _rows int, _data binary, _roots binary"
    done = materialize(plain.groupBy("_g", "_t").applyInArrow(packed, layout))
    return done.withColumn("_single", F.lit(single))


def _strips(tiles: DataFrame, about: DataFrame, size: int, half: bool) -> DataFrame:
    """A row per strip and tile that it meets, strips in one piece and in order.

    ``about`` has a row per group with its ``_total`` of points and what else the work needs to know.  With ``half`` every
    pair of tiles meets once, and a strip begins with itself; else a strip is followed by all tiles in order.
    """
    known = tiles.alias("t").join(small_table(about.filter(F.col("_total") > 0)).alias("a"), same_keys("t", "a", ["_g"])).select(
        "t.*", *(F.col(f"a.`{c}`") for c in about.columns if c != "_g")).withColumn("_tiles", F.ceil(F.col("_total") / size).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    if half:
        middle = F.floor(F.col("_tiles") / 2)
        spread = (known.withColumn("_step", F.explode(F.sequence(zero, middle)))
                  .withColumn("_strip", F.pmod(F.col("_t") - F.col("_step"), F.col("_tiles")))
                  .filter((F.col("_step") * 2 != F.col("_tiles")) | (F.col("_strip") < F.col("_step"))))
    else:
        spread = (known.withColumn("_other", F.explode(F.sequence(zero - 1, F.col("_tiles") - 1)))
                  .withColumn("_strip", F.when(F.col("_other") < 0, F.col("_t")).otherwise(F.col("_other")))
                  .withColumn("_step", F.when(F.col("_other") < 0, zero).otherwise(F.col("_t") + 1)).drop("_other"))
    return spread.repartition("_g", "_strip").sortWithinPartitions("_g", "_strip", "_step")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield {name: batch.column(i)[at] for i, name in enumerate(batch.schema.names)}


def _points(row: dict) -> np.ndarray:
    data = np.frombuffer(row["_data"].as_buffer(), np.float32 if row["_single"].as_py() else np.float64)
    return data.reshape(row["_rows"].as_py(), -1).astype(np.float64)


def _lists(parts: Sequence[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts), kind))


def _squares(a: np.ndarray, b: np.ndarray, long: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Squared distances, as ``pairs.distances`` takes them: from the differences where digits of the product cancel."""
    squares = np.add.outer(long, wide)
    squares -= np.matmul(2 * a, b.T)
    near = np.flatnonzero(~(squares.ravel() > 1e-3 * (long.max(initial=0) + wide.max(initial=0))))
    if len(near):
        i, j = near // len(b), near % len(b)
        close = ~(squares.ravel()[near] > 1e-3 * (long[i] + wide[j]))
        i, j = i[close], j[close]
        for at in range(0, len(i), 1 << 14):
            some = slice(at, at + (1 << 14))
            squares[i[some], j[some]] = ((a[i[some]] - b[j[some]]) ** 2).sum(axis=1)
    return squares


# -- components at several bounds --------------------------------------------------------------
def _square_bound(bound: float) -> float:
    """The largest number whose root is at most ``bound``."""
    if not bound >= 0:
        return -1.0
    square = float(bound) ** 2
    while np.isfinite(square) and np.sqrt(np.nextafter(square, np.inf)) <= bound:
        square = float(np.nextafter(square, np.inf))
    while np.sqrt(square) > bound:
        square = float(np.nextafter(square, -np.inf))
    return square


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the labels ``a`` and ``b``, pair by pair; a label is the smallest member."""
    parent = np.arange(len(label), dtype=label.dtype)
    while True:
        differ = a != b
        if not differ.any():
            break
        a, b = a[differ], b[differ]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        a, b = parent[a], parent[b]
    label[:] = parent[label]


def _connect(labels: np.ndarray, i: np.ndarray, j: np.ndarray, value: np.ndarray, bounds: Sequence[float], top: int) -> None:
    """Applies edges to the labels of the levels below ``top``.  Levels are nested: ends that share a label share all later ones."""
    for level in range(top):
        a, b = labels[level, i], labels[level, j]
        differ = a != b
        if not differ.all():
            i, j, value, a, b = i[differ], j[differ], value[differ], a[differ], b[differ]
        if not len(i):
            return
        reach = value <= bounds[level]
        if reach.any():
            _union(labels[level], a[reach], b[reach])


def _meet(labels: np.ndarray, a: np.ndarray, b: np.ndarray, offset: int, bounds: Sequence[float]) -> None:
    """Joins what the pairs of ``a`` (members 0 and up) and ``b`` (``offset`` and up) connect at each level."""
    long, wide = (a * a).sum(axis=1), (b * b).sum(axis=1)

    def apart(rows: slice) -> int:
        """Levels at which these rows and ``b`` are not one component yet; later levels have nothing to learn from them."""
        theirs = labels[:, offset:offset + len(b)]
        return int(((labels[:, rows] != theirs[:, :1]).any(axis=1) | (theirs != theirs[:, :1]).any(axis=1)).sum())

    for at in range(0, len(a), CHUNK):
        rows = slice(at, min(at + CHUNK, len(a)))
        if not (top := apart(rows)):
            continue
        squares = _squares(a[rows], b, long[rows], wide)
        # Each row joins its nearest point first, so that dense levels are done before their pairs are listed.
        mine, nearest = np.arange(len(squares)), squares.argmin(axis=1)
        _connect(labels, mine + at, nearest + offset, squares[mine, nearest], bounds, top)
        if top := apart(rows):
            hit = np.flatnonzero(squares <= bounds[top - 1])
            _connect(labels, hit // len(b) + at, hit % len(b) + offset, squares.ravel()[hit], bounds, top)


def nested_components(points: DataFrame, group: str, key: str, vector: str, bounds: Sequence[float], size: int = STRIP) -> DataFrame:
    """``_roots`` of every point (``_n``, from ``number_points`` by ``key``): the smallest number it is connected to, per bound.

    ``bounds`` rise.  Rows that share a key are connected.  A strip tells at most one edge per point of every tile it meets: the
    first level at which the point loses its label, and to which one.  The edges of a group stream into one array of labels.
    """
    squares = [_square_bound(b) for b in bounds]
    levels = len(bounds)
    tiles = pack(points, group, vector, size)
    about = points.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_total"))
    key_type = to_arrow_schema(tiles.select("_g").schema).field(0).type
    kind = tiles.schema["_g"].dataType.simpleString()
    edges = pa.schema([("_g", key_type), ("_strip", pa.int64()), ("_total", pa.int64()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64())), ("level", pa.list_(pa.int8()))])

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strip = labels = None
        for row in _rows(batches):
            tile = _points(row)
            if row["_step"].as_py() == 0:
                strip, begin = tile, row["_t"].as_py() * size
                mine = np.tile(np.arange(len(strip), dtype=np.int32), (levels, 1))
                labels, own = mine.copy(), True
            else:
                own = False
                mine = np.concatenate([labels, np.tile(np.arange(len(strip), len(strip) + len(tile), dtype=np.int32), (levels, 1))], axis=1)
                labels = mine.copy()
            _meet(labels, strip, tile, 0 if own else len(strip), squares)
            members = np.arange(labels.shape[1])
            before, after = (mine == members).sum(axis=0), (labels == members).sum(axis=0)
            moved = np.flatnonzero(after < before)
            numbers = members + begin
            if not own:
                numbers[len(strip):] = np.arange(len(tile)) + row["_t"].as_py() * size
            kept = labels[:, :len(strip)].copy()
            if not len(moved):
                labels = kept
                continue
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["_g"].as_py()], key_type), pa.array([row["_strip"].as_py()], pa.int64()), pa.array([row["_total"].as_py()], pa.int64()),
                 _lists([numbers[moved] + 1], pa.int64()), _lists([numbers[labels[after[moved], moved]] + 1], pa.int64()),
                 _lists([after[moved].astype(np.int8)], pa.int8())], schema=edges)
            labels = kept

    found = _strips(tiles, about.filter(F.col("_total") > 1), size, half=True).mapInArrow(forest, f"_g {kind}, _strip bigint, _total bigint, a array<bigint>, b array<bigint>, level array<tinyint>")
    # Rows of one key have consecutive numbers.
    repeated = (points.filter(F.col(key).isNotNull()).groupBy(F.col(group).alias("_g"), key).agg(F.min("_n").alias("_from"), F.max("_n").alias("_to"))
                .filter(F.col("_from") < F.col("_to")))
    count = (F.col("_to") - F.col("_from")).cast("int")
    same = repeated.select("_g", F.lit(2**62).alias("_strip"), F.lit(0).cast("bigint").alias("_total"), F.array_repeat("_from", count).alias("a"),
                           F.sequence(F.col("_from") + 1, F.col("_to")).alias("b"), F.array_repeat(F.lit(0).cast("tinyint"), count).alias("level"))
    result = pa.schema([("_g", key_type), ("_n", pa.int64()), ("_roots", pa.list_(pa.int32()))])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, labels, held = None, None, []

        def apply() -> None:
            if held:
                a, b, level = (np.concatenate(part) for part in zip(*held))
                _connect(labels, a - 1, b - 1, level, range(levels), levels)
                held.clear()

        def done() -> Iterator[pa.RecordBatch]:
            apply()
            for at in range(0, labels.shape[1], _ROWS):
                part = labels[:, at:at + _ROWS].T + 1
                offsets = pa.array(np.arange(0, part.size + 1, levels, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(part), key_type), pa.array(np.arange(at + 1, at + 1 + len(part)), pa.int64()),
                     pa.ListArray.from_arrays(offsets, pa.array(part.ravel(), pa.int32()))], schema=result)

        for row in _rows(batches):
            if row["_begins"].as_py():
                if labels is not None:
                    yield from done()
                name, labels = row["_g"].as_py(), np.tile(np.arange(row["_total"].as_py(), dtype=np.int32), (levels, 1))
            elif len(row["a"].values):
                held.append([row[c].values.to_numpy() for c in ("a", "b", "level")])
                if sum(len(h[0]) for h in held) > labels.shape[1] + _ROWS:
                    apply()
        if labels is not None:
            yield from done()

    # The first row of a group is marked, as a null or a number that is not one does not equal itself.
    marked = found.withColumn("_begins", F.lit(False)).unionByName(same.withColumn("_begins", F.lit(False))).unionByName(about.select(
        "_g", F.lit(-1).cast("bigint").alias("_strip"), "_total", F.array().cast("array<bigint>").alias("a"), F.array().cast("array<bigint>").alias("b"),
        F.array().cast("array<tinyint>").alias("level"), F.lit(True).alias("_begins")))
    roots = marked.repartition("_g").sortWithinPartitions("_g", "_strip").mapInArrow(merge, f"_g {kind}, _n bigint, _roots array<int>")
    return points.alias("p").join(roots.withColumnRenamed("_g", group).alias("r"), same_keys("p", "r", [group, "_n"])).select("p.*", "r._roots")


# -- silhouettes of nested clusters ------------------------------------------------------------
class _Silhouettes:
    """Silhouettes of one strip: per level the running cluster, the nearest closed one and the own one of each point.

    Points lie in the order of the levels, so a cluster of any level is a run of points, over tiles too.
    """

    def __init__(self, points: np.ndarray, roots: np.ndarray):
        self.points, self.own = points, roots
        self.long = (points * points).sum(axis=1)
        self.nearest = np.full(roots.shape, np.inf)
        self.inside, self.size = np.zeros(roots.shape), np.zeros(roots.shape, np.int64)
        self.open = np.zeros(roots.shape)
        self.open_root, self.open_size = np.zeros(len(roots), np.int64), np.zeros(len(roots), np.int64)

    def _close_open(self, level: int, rows: slice) -> None:
        if self.open_size[level]:
            mine = self.own[level, rows] == self.open_root[level]
            self.inside[level, rows][mine] = self.open[level, rows][mine]
            self.size[level, rows][mine] = self.open_size[level]
            mean = np.where(mine, np.inf, self.open[level, rows] / self.open_size[level])
            np.minimum(self.nearest[level, rows], mean, out=self.nearest[level, rows])

    def add(self, tile: np.ndarray, roots: np.ndarray) -> None:
        wide = (tile * tile).sum(axis=1)
        starts = [np.concatenate([[0], np.flatnonzero(np.diff(r)) + 1]) for r in roots]
        names = [r[s] for r, s in zip(roots, starts)]
        sizes = [np.diff(s, append=len(tile)) for s in starts]
        goes_on = [self.open_size[u] > 0 and names[u][0] == self.open_root[u] for u in range(len(roots))]
        for u, on in enumerate(goes_on):
            if on:
                sizes[u][0] += self.open_size[u]
        where = []
        for u, name in enumerate(names):        # which run of the tile is the own cluster
            order = np.argsort(name)
            at = np.minimum(np.searchsorted(name, self.own[u], sorter=order), len(name) - 1)
            where.append(np.where(name[order[at]] == self.own[u], order[at], -1))
        for at in range(0, len(self.points), CHUNK):
            rows = slice(at, at + CHUNK)
            sums = np.sqrt(_squares(self.points[rows], tile, self.long[rows], wide))
            before = np.arange(len(tile))
            for u, start in enumerate(starts):
                if len(start) < len(before):
                    sums = np.add.reduceat(sums, np.searchsorted(before, start), axis=1)
                before = start
                first, last, closed = sums[:, 0], sums[:, -1], len(start) - 1
                if goes_on[u]:
                    first = first + self.open[u, rows]
                    last = first if closed == 0 else last
                else:
                    self._close_open(u, rows)
                if closed:
                    means = sums[:, :-1] / sizes[u][:-1]
                    means[:, 0] = first / sizes[u][0]
                    mine = np.flatnonzero((where[u][rows] >= 0) & (where[u][rows] < closed))
                    if len(mine):
                        run = where[u][rows][mine]
                        self.inside[u, rows][mine] = np.where(run == 0, first[mine], sums[mine, run])
                        self.size[u, rows][mine] = sizes[u][run]
                        means[mine, run] = np.inf
                    np.minimum(self.nearest[u, rows], means.min(axis=1), out=self.nearest[u, rows])
                self.open[u, rows] = last
        for u in range(len(roots)):
            self.open_root[u], self.open_size[u] = names[u][-1], sizes[u][-1]

    def sums(self) -> np.ndarray:
        for u in range(len(self.own)):
            self._close_open(u, slice(None))
        a, b = self.inside / np.maximum(self.size - 1, 1), self.nearest
        longest = np.maximum(a, b)
        counts = (self.size > 1) & np.isfinite(b) & (longest > 0)
        return np.where(counts, (b - a) / np.where(counts, longest, 1.0), 0.0).sum(axis=1)


def nested_silhouettes(points: DataFrame, shape: DataFrame, group: str, vector: str, levels: int, size: int = STRIP) -> DataFrame:
    """Per group ``_sums``: the sum of the silhouettes of its points at every level.

    ``points`` are numbered (``_m``) in the order of ``_roots`` from the last level to the first.  ``shape`` has ``_total`` and the
    number of ``_clusters`` per level.  Levels of one cluster or only single points are not looked at, and
    levels of as many clusters as the one before are the same clusters.
    """
    tiles = pack(points, group, vector, size, "_m", "_roots")
    kind = tiles.schema["_g"].dataType.simpleString()
    key_type = to_arrow_schema(tiles.select("_g").schema).field(0).type
    schema = pa.schema([("_g", key_type), ("_sums", pa.list_(pa.float64()))])
    about = shape.filter(F.exists("_clusters", lambda c: (c > 1) & (c < F.col("_total")))).withColumnRenamed(group, "_g")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = row = None

        def done() -> pa.RecordBatch:
            sums = np.zeros(levels)
            sums[looked] = state.sums()[same]
            return pa.RecordBatch.from_arrays([pa.array([name], key_type), _lists([sums], pa.float64())], schema=schema)

        for row in _rows(batches):
            tile = _points(row)
            roots = np.frombuffer(row["_roots"].as_buffer(), np.int32).reshape(levels, -1)
            if row["_step"].as_py() == 0:
                if state is not None:
                    yield done()
                name, clusters = row["_g"].as_py(), np.array(row["_clusters"].as_py())
                looked = np.flatnonzero((clusters > 1) & (clusters < row["_total"].as_py()))
                _, first, same = np.unique(-clusters[looked], return_index=True, return_inverse=True)
                kept = looked[first]
                state = _Silhouettes(tile, roots[kept])
            else:
                state.add(tile, roots[kept])
        if state is not None:
            yield done()

    found = _strips(tiles, about, size, half=False).mapInArrow(score, f"_g {kind}, _sums array<double>")
    return found.groupBy(F.col("_g").alias(group)).agg(F.array(*(F.sum(F.col("_sums")[i]) for i in range(levels))).alias("_sums"))


# -- ranks of similarities ---------------------------------------------------------------------
def middle_ranks(points: DataFrame, asked: DataFrame, group: str, vector: str, rank_of: Callable[[np.ndarray], np.ndarray], bits: int,
                 size: int = STRIP, step: int = 14, held: int = 1 << 22) -> DataFrame:
    """Per group of ``asked`` the two middle ranks (``_low``, ``_high``) of the products of all pairs of its points.

    ``rank_of`` turns products in [-1, 1] into whole numbers below 2**bits, in order.  A pass counts the pairs below the
    range that is left and in its 2**step cells; once at most ``held`` pairs are left in a range they are fetched.
    """
    tiles = pack(points, group, vector, size)
    key_type = to_arrow_schema(tiles.select("_g").schema).field(0).type
    kind = tiles.schema["_g"].dataType.simpleString()
    names = ["_g", "_total", "prefix", "shift", "below", "pairs"]
    head = pa.schema([("_g", key_type), ("_total", pa.int64()), ("prefix", pa.int64()), ("shift", pa.int32()), ("below", pa.int64()), ("pairs", pa.int64())])
    told = pa.schema([*head, ("cells", pa.binary()), ("ranks", pa.binary()), ("above", pa.int64())])
    result = pa.schema([*head, ("_low", pa.int64()), ("_high", pa.int64())])
    layout = f"_g {kind}, _total bigint, prefix bigint, shift int, below bigint, pairs bigint"
    end = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strip = last = None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*(pa.array([last[n].as_py()], told.field(n).type) for n in names), pa.array([cells.tobytes()], pa.binary()),
                 pa.array([np.concatenate([np.zeros(0, np.int64), *ranks]).tobytes()], pa.binary()), pa.array([above], pa.int64())], schema=told)

        for row in _rows(batches):
            tile = _points(row)
            own = row["_step"].as_py() == 0
            if own:
                if strip is not None:
                    yield done()
                strip, last = tile, {n: row[n] for n in names}
                shift, pairs = row["shift"].as_py(), row["pairs"].as_py()
                low = row["prefix"].as_py() << shift
                high, fetch = low + (1 << shift), pairs <= held or shift == 0
                beyond = fetch and row["_total"].as_py() * (row["_total"].as_py() - 1) // 4 - row["below"].as_py() >= pairs
                narrow = max(0, shift - step)
                cells, ranks, above = np.zeros(1 << (shift - narrow), np.int64), [], end
                # Products that may lie in the range: a rank is 2**(1 - bits) wide, and rounding moves it by few of them.
                least, most = (low / end * 2 - 1 - 64 / end, high / end * 2 - 1 + 64 / end)
            for at in range(0, len(strip), CHUNK):
                part = strip[at:at + CHUNK]
                values = part @ (tile[at + 1:] if own else tile).T
                if own:     # of a tile with itself only the pairs (i, j) with i < j
                    values = values[np.arange(at + 1, len(tile))[None, :] > np.arange(at, at + len(part))[:, None]]
                values = values.ravel()
                if beyond:
                    over = rank_of(values[values >= most - 128 / end])
                    above = min(above, int(over[over >= high].min(initial=end)))
                if shift < bits:
                    values = values[(values >= least) & (values <= most)]
                found = rank_of(values)
                found = found[(found >= low) & (found < high)]
                if not fetch:
                    cells += np.bincount((found >> narrow) - (low >> narrow), minlength=len(cells))
                elif shift:
                    ranks.append(found)
        if strip is not None:
            yield done()

    def narrowed(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        total, prefix, shift, below, pairs = (rows[0][n] for n in names[1:])
        everything = total * (total - 1) // 2
        middle, low, high = ((everything - 1) // 2, everything // 2), None, None
        if pairs <= held or shift == 0:
            ranks = np.sort(np.concatenate([np.frombuffer(r["ranks"], np.int64) for r in rows]))
            if shift and len(ranks) < pairs:
                return result.empty_table()     # products that are no numbers have no middle
            above = min(r["above"] for r in rows)
            low, high = (above if m - below >= pairs else int(ranks[m - below]) if shift else prefix for m in middle)
        else:
            cells = sum(np.frombuffer(r["cells"], np.int64) for r in rows)
            upto = np.cumsum(cells)
            if upto[-1] < pairs:
                return result.empty_table()
            cell = int(np.searchsorted(upto, middle[0] - below, "right"))
            bits_done = min(step, shift)
            prefix, shift, pairs = (prefix << bits_done) + cell, shift - bits_done, int(cells[cell])
            below += int(upto[cell]) - pairs
            if shift == 0 and middle[1] - below < pairs:
                low = high = prefix
        values = [rows[0]["_g"], total, prefix, shift, below, pairs, low, high]
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(values, result)], schema=result)

    state = materialize(asked.select(F.col(group).alias("_g"), F.col("size").cast("bigint").alias("_total"), F.lit(0).cast("bigint").alias("prefix"), F.lit(bits).alias("shift"),
                                     F.lit(0).cast("bigint").alias("below"), (F.col("size") * (F.col("size") - 1) / 2).cast("bigint").alias("pairs")))
    finished = None
    while not state.isEmpty():
        counts = _strips(tiles, state, size, half=True).mapInArrow(count, f"{layout}, cells binary, ranks binary, above bigint")
        after = materialize(counts.groupBy("_g").applyInArrow(narrowed, f"{layout}, _low bigint, _high bigint"))
        ready = after.filter(F.col("_low").isNotNull()).select(F.col("_g").alias(group), "_low", "_high")
        finished = ready if finished is None else finished.unionByName(ready)
        state = after.filter(F.col("_low").isNull()).drop("_low", "_high")
    return finished
