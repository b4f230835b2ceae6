"""A streaming source for files that grow: every batch reads the bytes since the last one, and no others.

``register(spark)`` makes the format ``growing_lines`` known; its option ``path`` is a file or a folder
(all files below it, but hidden ones).  Rows are lines that are complete, that is end with a line feed:

* ``file``: the file, ``position``: the byte the line starts at,
* ``place``: how many bytes of the batch come before it; ascends by file and position,
* ``value``: the line without its end, as text (bytes that are not UTF-8 are replaced).

The offset of the stream is the number of consumed bytes of every file.  The driver looks at file sizes
and finds the last line feed of files that have grown; the lines are read by the tasks, in ranges of
``splitBytes`` (64 MB).  A file that has become shorter was replaced and is read from its
start; one that is gone is forgotten.  Empty lines are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "growing_lines"
SCHEMA = "file string, position long, place long, value string"
SPLIT_BYTES = 64 << 20
CHUNK = 1 << 20
LOOK_BACK = 1 << 16
BATCH_LINES = 10_000


@dataclass
class Range(InputPartition):
    """The lines of ``file`` that start in [first, last); the batch takes its bytes from ``low`` on, up to ``high``."""

    file: str
    first: int
    last: int
    low: int
    high: int
    place: int      # of the byte ``first`` in the batch

    def __post_init__(self):
        super().__init__(None)


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


class GrowingLinesReader(DataSourceStreamReader):
    def __init__(self, path: str, split_bytes: int = SPLIT_BYTES):
        self.path, self.split_bytes = path, split_bytes
        self.known: dict[str, tuple[int, int]] = {}     # file: its size and the end of its last complete line, then

    def initialOffset(self) -> dict:
        return {"files": {}}

    def _read(self, store: fs.FileSystem, file: str, first: int, last: int) -> bytes:
        with store.open_input_file(file) as stream:
            return stream.read_at(last - first, first)

    def _complete(self, store: fs.FileSystem, file: str, size: int) -> int:
        """Where the last line that has an end ends."""
        old_size, old_end = self.known.get(file, (0, 0))
        if size == old_size:
            return old_end
        floor, last = old_end if size > old_size else 0, size
        while last > floor:
            first = max(floor, last - LOOK_BACK)
            at = self._read(store, file, first, last).rfind(b"\n")
            if at >= 0:
                return first + at + 1
            last = first
        return floor

    def latestOffset(self) -> dict:
        store, path = open_store(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.Directory:
            info = store.get_file_info(fs.FileSelector(path, recursive=True))
        found = {}
        for item in info if isinstance(info, list) else [info]:
            if item.type == fs.FileType.File and not item.base_name.startswith((".", "_")):
                found[item.path] = (item.size, self._complete(store, item.path, item.size))
        self.known = found
        return {"files": {file: end for file, (_, end) in sorted(found.items()) if end}}

    def partitions(self, start: dict, end: dict) -> Sequence[Range]:
        ranges, place = [], 0
        for file, high in sorted(end["files"].items()):
            low = start["files"].get(file, 0)
            low = low if low <= high else 0
            for first in range(low, high, self.split_bytes):
                last = min(high, first + self.split_bytes)
                ranges.append(Range(file, first, last, low, high, place))
                place += last - first
        return ranges

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(self.path)
        rows: tuple[list, list] = ([], [])

        def batch() -> pa.RecordBatch:
            starts, lines = rows
            out = pa.RecordBatch.from_arrays(
                [pa.array([part.file] * len(starts)), pa.array(starts, pa.int64()), pa.array([part.place + s - part.first for s in starts], pa.int64()),
                 pa.array(lines, pa.string())], names=["file", "position", "place", "value"])
            starts.clear(), lines.clear()
            return out

        # A line that started before this range belongs to the range before; its end is looked for from one byte earlier.
        at = part.first if part.first == part.low else part.first - 1
        skip, rest = at < part.first, b""
        while at < part.high and (at - len(rest) < part.last or skip):
            data = rest + self._read(store, part.file, at, min(at + CHUNK, part.high))
            begin, at = at - len(rest), min(at + CHUNK, part.high)
            *lines, rest = data.split(b"\n")
            for line in lines:
                if not skip and begin < part.last:
                    text = line.removesuffix(b"\r").decode("utf-8", "replace")
                    if text:
                        rows[0].append(begin)
                        rows[1].append(text)
                begin, skip = begin + len(line) + 1, False
                if len(rows[0]) >= BATCH_LINES:
                    yield batch()
            if begin >= part.last:
                break
        if rows[0]:
            yield batch()


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingLinesReader:
        return GrowingLinesReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GrowingLines)


def stream_lines(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """The stream of complete lines below ``path``."""
    register(spark)
    reader = spark.readStream.format(FORMAT).option("path", path)
    return (reader.option("splitBytes", split_bytes) if split_bytes else reader).load()
