"""The live path: the batch operators with live settings, re-run for touched sessions.

An undo takes back earlier rows and a command looks ahead, so results of a session change
when new rows arrive; the output is a table of session versions, not an append-only stream.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sessionloom import constants as C
from sessionloom.functions import messages as M
from sessionloom.operators.filters import drop_exact, drop_null_rows, prefilter_live
from sessionloom.operators.lookups import encode_items, translate
from sessionloom.operators.ordered import chain, sessionwise
from sessionloom.operators.ranking import topk
from sessionloom.operators.redundancy import label_rows, replace_low_level
from sessionloom.operators.scale import materialize, small_table, temporary_tables
from sessionloom.operators.sessions import collapse_runs_step, time_intervals_step, undo_redo
from sessionloom.operators.workflows import merge_first_match_step
from sessionloom.sources.readers import LIVE_SCHEMA
from sessionloom.sources.tail import stream_lines
from sessionloom.streaming.segments import Manifest
from sessionloom.streaming.state import touched_sessions, use_rocksdb


def live_filter(log: DataFrame, dictionary: DataFrame, pairs: DataFrame, vocabulary: DataFrame,
                info: DataFrame, patterns=None, session: str = "session") -> DataFrame:
    """Interactions of a live log: filtered, aligned, merged, timed and encoded.

    ``log`` has ``ts`` (live text), ``session``, ``cat``, ``message`` and, if the feed has an order
    of its own, ``seq``; otherwise the order of reading counts.
    """
    if "seq" not in log.columns:
        log = materialize(log.withColumn("seq", F.monotonically_increasing_id()))
    rows = prefilter_live(log).transform(undo_redo, session=session, source=log)
    rows = label_rows(rows, session, source=log)
    rows = rows.withColumn("message", M.normalize_quotes("message"))
    rows = translate(rows, dictionary, keep_unmapped=True).filter(M.is_ascii("message_eng"))
    # No label window on the live path: all rows of the session are in view.
    rows = replace_low_level(rows, pairs, None, None, session=session)
    rows = drop_exact(rows, message="message_eng")
    rows = rows.select(session, F.col("ts").alias("timestamp"), "seq", "cat",
                       M.strip_command_ids("message_eng").alias("item_id"))
    steps = chain(
        partial(merge_first_match_step, item="item_id", patterns=patterns),
        partial(collapse_runs_step, item="item_id"),
        partial(time_intervals_step, ts="timestamp"))
    rows = sessionwise(rows, steps, session, ("timestamp", "seq"), source=log)
    rows = drop_null_rows(rows, [c for c in rows.columns if c != "seq"])
    side = small_table(info.select(
        F.col("message_content").alias("_key"), "classification", "target"))
    rows = rows.join(side, F.col("item_id") == F.col("_key"), "left").drop("_key")
    rows = drop_null_rows(rows, ["classification", "target"])
    return encode_items(rows, vocabulary, default=-1)


def live_predict(rows: DataFrame, predictions: DataFrame, k: int = 5, minimum: int = C.MIN_SESSION_LENGTH,
                 session: str = "session") -> DataFrame:
    """Predictions of sessions with more than ``minimum`` rows; a notice for the others.

    ``predictions`` holds (session, item, score) with shown names.
    """
    sizes = rows.groupBy(session).agg(F.count(F.lit(1)).alias("rows"))
    ready = sizes.filter(F.col("rows") > minimum)
    best = topk(predictions, k, session).join(ready, session, "left_semi").select(
        session, "rank", F.col("item").cast("string").alias("item"), F.col("score").cast("string").alias("item_scores"))
    waiting = sizes.filter(F.col("rows") <= minimum).select(
        session, F.lit(1).alias("rank"), F.lit(C.NO_PREDICTION).alias("item"), F.lit("0").alias("item_scores"))
    return best.unionByName(waiting)


def live_history(rows: DataFrame, session: str = "session", item: str = "item_id", order=("timestamp", "seq")) -> DataFrame:
    """The shown names of each session's rows in order, also of sessions too short for a prediction."""
    numbered = sessionwise(rows.select(session, *dict.fromkeys([*order, item])), lambda t: t.numbered("position"), session, tuple(order))
    return numbered.select(session, F.col("position").cast("bigint").alias("position"), item)


class LiveTable:
    """Results of the live path on disk, by session version.

    ``raw`` keeps every row, ``result`` the full result of each touched session, and ``touched`` the
    version that holds it, also if the result became empty.  A version is a micro-batch number; a
    batch that was taken in before changes nothing.  Batches are segments (see ``Manifest``) that are
    merged level by level.  A merged segment has as many session buckets as its rows need, so a micro-batch
    reads the buckets of the sessions it touches and the few batches that are not merged yet.
    """

    def __init__(self, spark: SparkSession, path: str, transform, buckets: int | None = None, session: str = "session",
                 rows_per_bucket: int = 1_000_000, fanout: int = 8, retain: int = 16):
        self.spark, self.path, self.transform = spark, path, transform
        self.buckets, self.session, self.rows_per_bucket = buckets, session, rows_per_bucket
        self.manifest = Manifest(spark, path, fanout, retain)

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64(self.session), F.lit(buckets)).cast("int")

    def _folder(self, kind: str, segment: dict) -> str:
        return f"{self.path}/{kind}/{segment['id']}"

    def _read(self, kind: str, segments: list[dict]) -> DataFrame:
        """Rows of several segments, which may differ in layout."""
        parts = [self.spark.read.parquet(self._folder(kind, s)).drop("_bucket") for s in segments]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def _buckets_for(self, rows: int) -> int:
        return self.buckets or max(1, -(-rows // self.rows_per_bucket))

    def _write_raw(self, rows: DataFrame, segment: dict) -> None:
        n = segment["buckets"]
        if n == 1:
            rows.write.mode("overwrite").parquet(self._folder("raw", segment))
        else:
            # Rebalancing gives a bucket few files and still cuts one that a hot session makes too large.
            (rows.withColumn("_bucket", self._bucket(n)).hint("rebalance", "_bucket")
             .write.mode("overwrite").partitionBy("_bucket").parquet(self._folder("raw", segment)))

    def _history(self, segments: list[dict], touched: DataFrame) -> DataFrame:
        """All rows of the touched sessions; of every segment only their buckets are read."""
        parts, wanted = [], {}
        for s in [s for s in segments if s["buckets"]]:
            rows, n = self.spark.read.parquet(self._folder("raw", s)), s["buckets"]
            if n > 1:
                if n not in wanted:  # at most n values
                    wanted[n] = [r[0] for r in touched.select(self._bucket(n)).distinct().collect()]
                rows = rows.filter(F.col("_bucket").isin(wanted[n])).drop("_bucket")
            parts.append(rows)
        every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return every.join(touched, self.session, "left_semi")

    def apply(self, batch: DataFrame, version: int) -> None:
        """Take in a batch; its number must be higher than those before, or it was taken in already."""
        state = self.manifest.load()
        if version <= state["version"]:
            return
        if "seq" in batch.columns:  # rows without an order of their own count as read
            place = F.col("_place") if "_place" in batch.columns else F.monotonically_increasing_id()
            batch = batch.withColumn("seq", F.coalesce("seq", F.lit(version).cast("bigint") * (1 << 44) + place)).drop("_place")
        new = {"id": f"v{version:012d}", "level": 0, "low": version, "high": version, "buckets": 1, "rows": 0}
        self._write_raw(batch, new)
        rows = self.spark.read.parquet(self._folder("raw", new))
        new["rows"] = rows.count()  # from the files' footers
        if self._buckets_for(new["rows"]) > 1 and new["rows"] > self.rows_per_bucket:
            whole, new = new, new | {"id": new["id"] + "b", "buckets": self._buckets_for(new["rows"])}
            self._write_raw(rows, new)
            state["left"].append({"id": whole["id"], "at": version})
        touched = self._touch(self._read("raw", [new]), new)
        with temporary_tables(self.spark):
            self._finish(self._history([*state["segments"], new], touched), state, new)

    def apply_sessions(self, rows: DataFrame, version: int) -> None:
        """Like ``apply``, with all rows so far of the sessions of the batch; no raw rows are kept."""
        state = self.manifest.load()
        if version <= state["version"]:
            return
        new = {"id": f"v{version:012d}", "level": 0, "low": version, "high": version, "buckets": 0, "rows": 0}
        with temporary_tables(self.spark):
            rows = materialize(rows)  # a stream's batch runs its state once
            self._touch(rows, new)
            self._finish(rows, state, new)

    def _touch(self, rows: DataFrame, new: dict) -> DataFrame:
        """Write and return the sessions of a batch."""
        sessions = rows.select(self.session).distinct().withColumn("_version", F.lit(new["low"]).cast("bigint"))
        sessions.write.mode("overwrite").parquet(self._folder("touched", new))
        return self.spark.read.parquet(self._folder("touched", new)).select(self.session)

    def _finish(self, history: DataFrame, state: dict, new: dict) -> None:
        """Write the result of the touched sessions and make the batch part of the table."""
        result = self.transform(history).withColumn("_version", F.lit(new["low"]).cast("bigint"))
        result.write.mode("overwrite").parquet(self._folder("result", new))
        state = state | {"version": new["low"], "step": 0, "segments": [*state["segments"], new]}
        self.manifest.commit(state)
        while due := self.manifest.due(state):
            state = self._merge(state, due)

    def _latest(self, segments: list[dict]) -> tuple[DataFrame, DataFrame]:
        """The newest result of every session of some segments, and the version it is from."""
        touched = self._read("touched", segments).groupBy(self.session).agg(F.max("_version").alias("_version"))
        return self._read("result", segments).join(touched, [self.session, "_version"], "left_semi"), touched

    def _merge(self, state: dict, segments: list[dict]) -> dict:
        """One segment for several; nothing but the layout changes."""
        low, high, rows = segments[0]["low"], segments[-1]["high"], sum(s["rows"] for s in segments)
        level = segments[0]["level"] + 1
        kept = [s for s in segments if s["buckets"]]  # those that hold raw rows
        merged = {"id": f"m{level}-{low:012d}-{high:012d}", "level": level, "low": low, "high": high,
                  "rows": rows, "buckets": self._buckets_for(rows) if kept else 0}
        if kept:
            self._write_raw(self._read("raw", kept), merged)
        result, touched = self._latest(segments)
        result.write.mode("overwrite").parquet(self._folder("result", merged))
        touched.write.mode("overwrite").parquet(self._folder("touched", merged))
        gone = {s["id"] for s in segments}
        state = state | {"step": state["step"] + 1, "segments": [*(s for s in state["segments"] if s["id"] not in gone), merged],
                         "left": [*state["left"], *({"id": i, "at": state["version"]} for i in sorted(gone))]}
        self.manifest.commit(state)
        return state

    def current(self) -> DataFrame:
        """The latest result of every session.

        The DataFrame stays valid for ``retain`` more versions."""
        segments = self.manifest.load()["segments"]
        if not segments:
            raise ValueError("no batch has been taken in yet")
        return self._latest(segments)[0].drop("_version")

    def sync(self, source: str, stateful: bool = False) -> int | None:
        """Take in what has been appended to a folder of JSON-lines files, or to one file, since the last call.

        Returns the version of the rows it took, None if there were none.  Use either this, ``follow`` or ``watch`` on a table.
        """
        before = self.manifest.load()["version"]
        self.follow(source, f"{self.path}/feed", stateful=stateful).awaitTermination()
        after = self.manifest.load()["version"]
        return after if after > before else None

    def follow(self, source: str, checkpoint: str, interval: str | None = None, split_bytes: int | None = None,
               stateful: bool = False) -> StreamingQuery:
        """Follow JSON-lines files that grow, by the bytes appended to each; lines count once they have an end.

        With ``interval`` ("5 seconds") the query keeps running, else it ends with what is there.  A
        ``stateful`` query keeps the rows of sessions in Spark's state store, below ``checkpoint``, and writes
        no raw rows: the cost of a batch is that of the sessions it touches.  A table is followed one way or the other.
        """
        schema = T.StructType([*LIVE_SCHEMA.fields, T.StructField("seq", T.LongType())])
        lines = stream_lines(self.spark, source, split_bytes)
        rows = lines.select(F.from_json("value", schema).alias("row"), F.col("place").alias("_place")).select("row.*", "_place")
        take = self.apply
        if stateful:
            use_rocksdb(self.spark)
            rows, take = touched_sessions(rows.withColumnRenamed("_place", "place"), self.session), self.apply_sessions
        writer = rows.writeStream.foreachBatch(lambda batch, version: take(batch, version)).option("checkpointLocation", checkpoint)
        if stateful:
            writer = writer.outputMode("update")
        return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()

    def watch(self, source: str, checkpoint: str, files_per_trigger: int | None = None) -> StreamingQuery:
        """Follow a folder of JSON-lines files; every new file re-runs its sessions.

        Files must not grow once they are there; for a log that does, see ``follow``."""
        reader = self.spark.readStream.schema(T.StructType([*LIVE_SCHEMA.fields, T.StructField("seq", T.LongType())]))
        if files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", files_per_trigger)
        return (reader.json(source).writeStream
                .foreachBatch(lambda batch, version: self.apply(batch, version))
                .option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start())
