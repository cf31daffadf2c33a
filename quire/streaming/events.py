"""The event log as a stream: appended from files, folded by job, rate-limited with state.

State lives in the state store, by key: what an operator holds of a job is what the fold needs and the events that the
watermark hasn't passed. Event-time timers do the rest, so a stream that reads what has arrived so far ends by itself, and
one that is started again goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.operators.jobs import AFTER, STAGES

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
_STORE = "spark.sql.streaming.stateStore.providerClass"


def stateful(spark: SparkSession) -> SparkSession:
    """A session whose state store can hold maps and timers."""
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def log(spark: SparkSession, path: str, schema: str = EVENT, files_per_trigger: int = 16) -> DataFrame:
    """Events from the Parquet files that appear under a path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def latest(events: DataFrame) -> DataFrame:
    """Per job its last event and counts: the fold that a status is."""
    return events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("stage"), F.count(F.lit(1)).alias("events"), F.max("event_id").alias("last_event"))


def windowed(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Requests and tokens in tumbling windows of event time; later events than the watermark are left."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = e.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("requests"), F.sum(F.floor("value")).alias("tokens"))
    return w.select("w.start", "event_type", "requests", "tokens")


LIMITED = "user_id long, event_id long, delay long"
#: Rows that go back to Spark at a time.
SLICE = 10_000


class _Limiter(StatefulProcessor):
    """Requests wait in a list, a chunk for each time that some came, until the watermark has passed their second; then all
    that it has passed are let through in order. So what is asked of the state hangs on how many jobs there are and how often
    they get requests, not on the requests. A job's window is forgotten when the watermark has passed its end, from which on
    it is as if new."""

    def __init__(self, most_requests: int, most_tokens: int, window: int) -> None:
        self.most_requests, self.most_tokens, self.window = most_requests, most_tokens, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.use = handle.getValueState("use", "clock long, begun long, requests long, used long")
        self.waiting = handle.getListState("waiting", "chunk binary")  # seconds, events and tokens, as 64-bit numbers

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        least = None
        for frame in rows:
            new = np.stack([frame[c].to_numpy(np.int64) for c in ("at", "event_id", "tokens")])
            self.waiting.appendValue((new.tobytes(),))
            least = min(int(new[0].min()), int(new[0].min()) if least is None else least)
        if least is not None:
            self.handle.registerTimer(1000 * (least + 1))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed, now = timerValues.getCurrentWatermarkInMs() // 1000, expiredTimerInfo.getExpiryTimeInMs() // 1000
        chunks = [np.frombuffer(bytes(c), np.int64).reshape(3, -1) for (c,) in self.waiting.get()]
        waiting = np.concatenate(chunks, axis=1) if chunks else np.zeros((3, 0), np.int64)
        due = waiting[0] < passed
        clock, begun, requests, used = self.use.get() or (0, -(1 << 60), 0, 0)
        if due.any():
            some = waiting[:, due]
            some = some[:, np.lexsort(some[::-1])]
            delays = []
            for second, tokens in zip(some[0].tolist(), some[2].tolist(), strict=True):
                at = max(clock, second)
                if at - begun >= self.window:
                    begun, requests, used = at, 0, 0
                delay = 0
                if requests + 1 > self.most_requests or used + tokens > self.most_tokens:
                    delay = self.window - (at - begun)
                    begun, requests, used = at + delay, 0, 0
                clock, requests, used = at + delay, requests + 1, used + tokens
                delays.append(delay)
            if due.all():
                self.waiting.clear()
            else:
                rest = waiting[:, ~due]
                self.waiting.put([(rest.tobytes(),)])
                self.handle.registerTimer(1000 * (int(rest[0].min()) + 1))
            over = max(clock, begun + self.window)
            if passed > over:
                self.use.clear()
            else:
                self.use.update((clock, begun, requests, used))
                self.handle.registerTimer(1000 * (over + 1))
            for i in range(0, len(delays), SLICE):
                yield pd.DataFrame({"user_id": key[0], "event_id": some[1, i : i + SLICE], "delay": delays[i : i + SLICE]})
        elif now > max(clock, begun + self.window):
            self.use.clear()

    def close(self) -> None:
        pass


def limited(events: DataFrame, most_requests: int, most_tokens: int, window: int, late: str = "0 seconds") -> DataFrame:
    """Each request's delay under a fixed window per job, in order of time. Requests that come up to `late` after younger
    ones are put in their place, later ones are left; so a request is answered once the log has gone on by that time. What
    the stream gives is what `usage.rate_limited` gives of the same requests, however they are spread over files."""
    e = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.coalesce(F.floor("value").cast("long"), F.lit(0)).alias("tokens")).withWatermark("ts", late)
    e = e.withColumn("at", F.unix_seconds("ts")).where("at IS NOT NULL")
    stateful(events.sparkSession)
    return e.groupBy("user_id").transformWithStateInPandas(_Limiter(most_requests, most_tokens, window), LIMITED, "Append", "EventTime")


STATUS = "job long, status string, stage string, events long, last_event long, tail array<long>"


class _Status(StatefulProcessor):
    """What a job's log folds to, with the last of its events; forgotten when the job has been silent."""

    def __init__(self, most: int, keep: int) -> None:
        self.most, self.keep = most, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fold = handle.getValueState("fold", "status string, since long, latest string, last long, events long, seen long")
        self.tail = handle.getValueState("tail", "events array<long>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        status, since, latest, last, events, seen = self.fold.get() if self.fold.exists() else ("preparing", -1, "", -1, 0, 0)
        tail = list(self.tail.get()[0]) if self.tail.exists() else []
        for frame in rows:
            events += len(frame)
            seen = max(seen, int(frame["at"].max()))
            tail = sorted([*tail, *frame["event"].nlargest(self.most).tolist()])[-self.most :]
            for part, told in ((frame, False), (frame[frame["kind"].isin(AFTER)], True)):
                if len(part):
                    event, kind = max(zip(part["event"].tolist(), part["kind"].tolist(), strict=True), key=lambda x: x[0])
                    if told and event > since:
                        status, since = AFTER[kind], event
                    elif not told and event > last:
                        latest, last = kind, event
        if self.fold.exists():
            self.handle.deleteTimer(1000 * (self.fold.get()[5] + self.keep))
        self.fold.update((status, since, latest, last, events, seen))
        self.tail.update((tail,))
        self.handle.registerTimer(1000 * (seen + self.keep))
        stage = next((s for start, s in STAGES if (latest or "").startswith(start)), "translate")
        yield pd.DataFrame({"job": [key[0]], "status": [status], "stage": [stage], "events": [events], "last_event": [last], "tail": [tail]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.fold.clear()
        self.tail.clear()
        yield from ()

    def close(self) -> None:
        pass


def statuses(events: DataFrame, job: str, order: str, kind: str, most: int = 500, keep: int = 30 * 86_400, late: str = "1 day") -> DataFrame:
    """Per trigger the jobs that got events: status and stage as `jobs.folded_status` folds the whole log, how many events
    there are, and the last `most` of them. A job that has been silent for `keep` seconds of event time is forgotten: its
    state goes, and a later event starts it anew. Events more than `late` behind are left. Needs a column ts."""
    e = events.select(F.col(job).cast("long").alias("job"), F.col(order).cast("long").alias("event"), F.col(kind).alias("kind"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    stateful(events.sparkSession)
    return e.withColumn("at", F.unix_seconds("ts")).groupBy("job").transformWithStateInPandas(_Status(most, keep), STATUS, "Update", "EventTime")


def written(stream: DataFrame, path: str, checkpoint: str) -> None:
    """What has arrived so far, once, as Parquet."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def gathered(stream: DataFrame, path: str, checkpoint: str) -> None:
    """What has arrived so far of a stream that gives rows anew, as Parquet by batch: a batch that is done again after a
    failure takes the place of its first try."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
