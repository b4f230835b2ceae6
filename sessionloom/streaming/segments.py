"""What a table on disk that grows by batches consists of: a manifest of segments, and their merging.

A segment is a folder per kind of rows (``raw``, ``result``, ``touched``) that covers some versions.  A
manifest is one small file that names all segments; it is written beside the old ones and renamed, so a reader
sees the state before a batch or after it.  When ``fanout`` segments of a level are there they become
one of the next level: with n batches there are at most ``fanout`` times log(n) segments, and a
row is written as often as there are levels.  Folders that no longer belong to the table stay for
``retain`` versions, for readers that opened them before.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

KINDS = ("raw", "result", "touched")


class Store:
    """The few file operations a manifest needs, on any file system that Spark knows."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self.jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.conf), where

    def names(self, folder: str) -> list[str]:
        system, where = self._at(folder)
        return sorted(s.getPath().getName() for s in system.listStatus(where)) if system.exists(where) else []

    def read(self, path: str) -> str:
        system, where = self._at(path)
        stream = system.open(where)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        system, where = self._at(path)
        draft = self.jvm.org.apache.hadoop.fs.Path(f"{where.getParent()}/.{where.getName()}.new")
        stream = system.create(draft, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not system.rename(draft, where):
            raise RuntimeError(f"{path} exists")

    def delete(self, path: str) -> None:
        system, where = self._at(path)
        system.delete(where, True)


class Manifest:
    """Segments of a table: ``id``, ``level``, versions ``low`` to ``high``, ``rows`` and number of ``buckets`` of raw rows."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = 8, retain: int = 16):
        if fanout < 2:
            raise ValueError("fanout must be at least 2")
        self.store, self.path, self.fanout, self.retain = Store(spark), path, fanout, retain

    def load(self) -> dict:
        """The newest state; version -1 if there is none."""
        names = self._files()
        if not names:
            return {"version": -1, "step": 0, "segments": [], "left": []}
        return json.loads(self.store.read(f"{self.path}/manifest/{names[-1]}"))

    def _files(self) -> list[str]:
        return [n for n in self.store.names(f"{self.path}/manifest") if n.endswith(".json") and not n.startswith(".")]

    def commit(self, state: dict) -> None:
        """Make ``state`` the newest; then delete what no reader of the last ``retain`` versions needs."""
        now = state["version"]
        old = [s for s in state["left"] if s["at"] <= now - self.retain]
        state = state | {"left": [s for s in state["left"] if s["at"] > now - self.retain]}
        self.store.write(f"{self.path}/manifest/{now:012d}-{state['step']:04d}.json", json.dumps(state))
        for segment in old:
            for kind in KINDS:
                self.store.delete(f"{self.path}/{kind}/{segment['id']}")
        for name in self._files()[:-self.retain]:
            self.store.delete(f"{self.path}/manifest/{name}")

    def due(self, state: dict) -> list[dict]:
        """The oldest ``fanout`` segments of the lowest level that is full; none if no level is."""
        levels: dict[int, list[dict]] = {}
        for segment in sorted(state["segments"], key=lambda s: s["low"]):
            levels.setdefault(segment["level"], []).append(segment)
        full = [level for level, some in levels.items() if len(some) >= self.fanout]
        return levels[min(full)][:self.fanout] if full else []
