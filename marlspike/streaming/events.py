"""Event streams: windowed rates, debounced batches, presence, request limits.

Every function takes a streaming DataFrame and returns one; ``drain`` runs one
over all that its source holds now and gives back what came out. Watermarks
bound the state of each.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marlspike.functions.times import millis
from marlspike.operators.events import LIMITS, fixed_windows
from marlspike.operators.iterate import temporary

LATE_MINUTES = 10
LATE = f"{LATE_MINUTES} minutes"


def source(spark: SparkSession, path: str) -> DataFrame:
    """The event table as a stream; times without a zone are UTC."""
    schema = spark.read.parquet(path).schema
    # as a pattern that fits this path alone: the file source takes no single file otherwise
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]").withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What the stream gives for all its source holds, written as Parquet batch by batch in the shared folder.

    A batch that is written twice after a failure overwrites itself.
    """
    spark = stream.sparkSession
    root = temporary(spark, "stream")

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/{n:012d}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out/*")


def rates(events: DataFrame, size: str = "1 hour", limit: int = 5) -> DataFrame:
    """``entity, start, n, blocked`` for calendar windows that the watermark has closed."""
    w = events.withWatermark("ts", LATE).groupBy(F.window("ts", size), F.col("user_id").alias("entity")).agg(F.count("*").alias("n"))
    return w.select("entity", F.col("window.start").alias("start"), "n", F.greatest(F.lit(0), F.col("n") - limit).alias("blocked"))


def debounced(events: DataFrame, gap: str = "1 hour") -> DataFrame:
    """``path, start, n, last_kind`` for runs of changes closer together than the gap."""
    w = events.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap), F.col("user_id").alias("path"))
    w = w.agg(F.count("*").alias("n"), F.max_by("event_type", "ts").alias("last_kind"))
    return w.select("path", F.col("session_window.start").alias("start"), "n", "last_kind")


def sliding(events: DataFrame, size: str = "2 hours", slide: str = "1 hour") -> DataFrame:
    """``event_type, start, n, total`` for overlapping windows."""
    w = events.withWatermark("ts", LATE).groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return w.select("event_type", F.col("window.start").alias("start"), "n", "total")


def presence(events: DataFrame, gone: int = 24 * 3600) -> DataFrame:
    """``agent, last_seen, status``: updates for agents seen, and one ``removed`` when none came for ``gone`` seconds of event time."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"agent": [key[0]], "last_seen": pd.to_datetime([last], unit="ms", utc=True), "status": ["removed"]})
            return
        last = state.get[0] if state.exists else 0
        for pdf in batches:
            last = max(last, int(pdf["ms"].max()))
        state.update((last,))
        state.setTimeoutTimestamp(max(last + gone * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"agent": [key[0]], "last_seen": pd.to_datetime([last], unit="ms", utc=True), "status": ["active"]})

    d = events.withWatermark("ts", LATE).select(F.col("user_id").alias("agent"), "ts", F.unix_millis("ts").alias("ms"))
    return d.groupBy("agent").applyInPandasWithState(run, "agent bigint, last_seen timestamp, status string", "last bigint", "update", GroupStateTimeout.EventTimeTimeout)


def rate_limited(events: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """``id, entity, limit_hit`` request by request, windows kept as state for each entity."""
    limits = LIMITS | (limits or {})

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        windows = json.loads(state.get[0]) if state.exists else {}
        pdf = pd.concat(list(batches)).sort_values(["ms", "id"])
        hit = [fixed_windows(windows, int(ms), limits) for ms in pdf["ms"]]
        state.update((json.dumps(windows),))
        yield pd.DataFrame({"id": pdf["id"].to_numpy(), "entity": [key[0]] * len(pdf), "limit_hit": hit})

    d = events.select(F.col("event_id").alias("id"), F.col("user_id").alias("entity"), millis(F.col("ts")).alias("ms"))
    return d.groupBy("entity").applyInPandasWithState(run, "id bigint, entity bigint, limit_hit string", "windows string", "append", GroupStateTimeout.NoTimeout)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Stores of state for each core at most, and MB that all stores of an executor share.
STORES, ROCKS_MB = 4, 200


class _Batches(StatefulProcessor):
    """Open batches of changes by path: what has come, and a timer at the end of the first one's quiet time.

    A change that comes after a batch's quiet time does not close it: the watermark does, as late
    changes may still lengthen it. What no change in time can lengthen is given at once, so a path has two open batches
    at most where ``late`` is no longer than the gap.
    """

    def __init__(self, gap: int, late: int):
        self.gap, self.late = gap, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "start bigint, last bigint, id bigint, n bigint, kind string")

    def _closed(self, key: tuple, done: list[tuple]) -> pd.DataFrame:
        start = pd.to_datetime([r[0] for r in done], unit="us", utc=True)
        return pd.DataFrame({"path": [key[0]] * len(done), "start": start, "n": [r[3] for r in done], "last_kind": [r[4] for r in done]})

    def _joined(self, rows: list[tuple]) -> list[tuple]:
        """Batches ``(start, last, id, n, kind)`` of parts of them; the kind is that of the last change."""
        out: list[tuple] = []
        for start, last, id_, n, kind in sorted(rows, key=lambda r: r[:3]):
            if out and start - out[-1][1] < self.gap:
                first, was, of, m, k = out[-1]
                out[-1] = (first, *((last, id_, n + m, kind) if (last, id_) >= (was, of) else (was, of, n + m, k)))
            else:
                out.append((start, last, id_, n, kind))
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = [tuple(r) for r in self.open.get()]
        open_ = held
        for new in rows:  # frame by frame, so a hot path holds its batches and one frame, not all its changes
            us = new["us"].tolist()
            open_ = self._joined([*open_, *zip(us, us, new["id"].tolist(), [1] * len(us), new["kind"].tolist(), strict=True)])
        sure = open_[-1][1] // 1000 * 1000 - self.late  # the watermark will be there at least
        done = [r for r in open_ if r[1] + self.gap <= sure]
        open_ = open_[len(done) :]
        if held:
            self.handle.deleteTimer(self._due(held[0][1]))
        self.open.put(open_)
        self.handle.registerTimer(self._due(open_[0][1]))
        if done:
            yield self._closed(key, done)

    def _due(self, last: int) -> int:
        """Milliseconds at which a batch is over; no earlier than it is to the microsecond."""
        return -(-(last + self.gap) // 1000)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        mark = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        held = [tuple(r) for r in self.open.get()]
        done = [r for r in held if self._due(r[1]) <= mark]
        if len(done) < len(held):
            self.open.put(held[len(done) :])
            self.handle.registerTimer(self._due(held[len(done)][1]))
        else:
            self.open.clear()
        if done:
            yield self._closed(key, done)

    def close(self) -> None:
        pass


def watched(changes: DataFrame, gap: int = 3600) -> DataFrame:
    """``path, start, n, last_kind`` of batches of ``changes(id, path, ts, kind)`` closer together than ``gap`` seconds.

    State is the open batches of each path that has one; a timer of event time
    closes them, so nothing stays for paths that are quiet. Needs the state store
    ``ROCKS``.
    """
    d = changes.withWatermark("ts", LATE).select("path", "id", "ts", F.unix_micros("ts").alias("us"), "kind")
    schema = "path bigint, start timestamp, n bigint, last_kind string"
    return d.groupBy("path").transformWithStateInPandas(_Batches(gap * 1_000_000, LATE_MINUTES * 60_000_000), schema, "Append", "eventTime")


def resumed(stream: DataFrame, root: str, mode: str = "append") -> DataFrame:
    """Run a stream over what its source holds now, from where the last run under ``root`` stopped; all that runs have given so far.

    An executor keeps every store of state open that it has had, with memory outside the heap: so there are ``STORES``
    for each core at most, however many partitions a shuffle has, and they share ``ROCKS_MB``.
    """
    spark = stream.sparkSession
    parts = "spark.sql.shuffle.partitions"
    confs = {
        "spark.sql.streaming.stateStore.providerClass": ROCKS,
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": str(ROCKS_MB),
        parts: str(min(int(spark.conf.get(parts)), STORES * spark.sparkContext.defaultParallelism)),
    }
    before = {k: spark.conf.get(k, None) for k in confs}

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/{n:012d}")

    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(keep).start()
        q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(f"{root}/out/*")
