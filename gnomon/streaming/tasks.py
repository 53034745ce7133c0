"""Streaming forms of the event and task operators, on Structured Streaming.

Events carry a timestamp column `ts` (a column without time zone is read as session time). State is keyed, kept in the
state store and bounded by the watermark or by what a key needs; every function takes a stream and returns one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from gnomon.operators import tasks as T

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def timed(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events with a watermark on ts, which must be a timestamp with time zone for that."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def record_once(events: DataFrame, late: str = "1 hour", key: str = "event_id") -> DataFrame:
    """Each event id once; ids are remembered as long as the watermark allows a repeat."""
    return timed(events, late).dropDuplicatesWithinWatermark([key])


def topic_counts(events: DataFrame, window: str | None = None, late: str = "1 hour") -> DataFrame:
    """topic, event_type, events; with a window also its start, and closed windows leave the state."""
    rows = timed(events, late).withColumn("topic", F.substring_index("event_type", ".", 1))
    keys = ["topic", "event_type"]
    if window:
        return rows.groupBy(F.window("ts", window), *keys).agg(F.count("*").alias("events")).select(F.col("window.start").alias("start"), *keys, "events")
    return rows.groupBy(*keys).agg(F.count("*").alias("events"))


def metrics(rows: DataFrame) -> DataFrame:
    return rows.groupBy("name").agg(F.count("*").alias("count"), F.sum("value").alias("sum"), F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"))


class _Tasks(StatefulProcessor):
    """One task: its state as JSON, and a timer at the end of its lease, retry wait or deadline."""

    def __init__(self, policy: T.RetryPolicy, timers: bool):
        self.policy, self.timers = policy, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", "state string, seq long")

    def _load(self) -> tuple[dict | None, int]:
        if not self.task.exists():
            return None, -1
        text, seq = self.task.get()
        return json.loads(text), seq

    def _save(self, task: dict | None, seq: int) -> None:
        if task is None:
            return
        self.task.update((json.dumps(task), seq))
        if self.timers:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if task["state"] in (*T.ACTIVE, "CANCEL_REQUESTED") and task["lease_until"] is not None:
                self.handle.registerTimer(int(task["lease_until"] * 1000))
            elif task["state"] == "RETRY_WAIT":
                self.handle.registerTimer(int(task["available_at"] * 1000))

    def _rows(self, out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in T.OUTCOME.split(", ")])
        return frame.astype({"version": "Int64", "attempt": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        task, seq = self._load()
        commands = [T.plain(c) for batch in rows for c in batch.to_dict("records")]
        out = []
        for c in sorted(commands, key=lambda c: c["seq"]):
            if c["seq"] <= seq:
                out.append(T.outcome(task, c, "late command"))
                continue
            task, note = T.step(task, c, self.policy)
            seq = c["seq"]
            out.append(T.outcome(task, c, note))
        self._save(task, seq)
        if out:
            yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        task, seq = self._load()
        if task is None:
            return
        at = expiredTimerInfo.getExpiryTimeInMs() / 1000
        command = "due" if task["state"] == "RETRY_WAIT" else "release"
        c = {"task_id": key[0], "seq": seq, "at": at, "command": command, "worker": None, "lease": None, "failure": None, "text": None, "seconds": None}
        task, note = T.step(task, c, self.policy)
        self._save(task, seq)
        yield self._rows([T.outcome(task, c, note)])

    def close(self) -> None:
        pass


def task_outcomes(commands: DataFrame, policy: T.RetryPolicy = T.RetryPolicy(), timers: bool = False, late: str = "1 hour") -> DataFrame:
    """T.OUTCOME rows of a stream of commands (T.COMMAND), as T.fold() gives for a log.

    A task's commands must come in the order of seq; an older one is refused as late. timers: the end of a lease and of a
    retry's wait are commands of their own, once event time (of ts, which commands must then have) has passed them.
    """
    names = [c.split()[0] for c in T.COMMAND.split(", ")]
    commands.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = timed(commands, late).select(*names, "ts") if timers else commands.select(*names)
    return rows.groupBy("task_id").transformWithStateInPandas(_Tasks(policy, timers), T.OUTCOME, "Append" if timers else "Update", "EventTime" if timers else "None")


class _Silence(StatefulProcessor):
    """A worker's last sign, and a timer at which it counts as unhealthy."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen = max(int(batch["ms"].max()) for batch in rows)
        had = self.last.get()[0] if self.last.exists() else None
        if had is None or seen > had:
            if had is not None:
                self.handle.deleteTimer(had + int(self.threshold * 1000))
            self.last.update((seen,))
            self.handle.registerTimer(seen + int(self.threshold * 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame({"worker": [key[0]], "last": [last / 1000], "unhealthy_at": [expiredTimerInfo.getExpiryTimeInMs() / 1000]})

    def close(self) -> None:
        pass


def silent_workers(heartbeats: DataFrame, threshold: float, late: str = "1 minute") -> DataFrame:
    """worker, last, unhealthy_at of workers (worker, ts) that gave no sign for `threshold` seconds of event time."""
    heartbeats.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = timed(heartbeats, late).select("worker", "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("worker").transformWithStateInPandas(_Silence(threshold), f"worker {dict(heartbeats.dtypes)['worker']}, last double, unhealthy_at double", "Append", "EventTime")


def deliver(events: DataFrame, handlers: dict[str, tuple[str, Callable[[dict], None]]], checkpoint: str, dead_letters: str, acknowledged: str) -> StreamingQuery:
    """Runs handlers on every event of a stream. Deliveries go to `acknowledged` or, with their reason, to `dead_letters`: one
    folder for each batch, which a repeated batch replaces."""

    def run(batch: DataFrame, number: int) -> None:
        done = T.dispatch(batch, handlers).persist()
        try:
            done.where("ok").select("event_id", "subscription_id").write.mode("overwrite").parquet(f"{acknowledged}/batch={number}")
            done.where("not ok").select("event_id", "subscription_id", "reason").write.mode("overwrite").parquet(f"{dead_letters}/batch={number}")
        finally:
            done.unpersist()

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
