"""Job lanes as state machines: bounded queues that workers drain, with job kinds in the key.

A lane is one kind of job ('upload-fast', 'upload-pdf', 'ocr', 'ontology') of one space. Its events are submit (the event's id
becomes the job's), take (a worker begins the oldest queued job), finish and fail (of the oldest running job), cancel (the newest queued
job goes; of a lane without one the newest running job is asked to stop) and restart (running jobs go back to the front of the queue as far as
it has room). A job that runs longer than ``stall`` seconds of event time ends as stalled. Every public change of a job is a row with its next
version.

``Lane`` is the one transition function. ``stream`` keeps its two short lists as state of each key, at most ``room`` queued and the running jobs,
and a timer for the oldest running one; ``replay`` folds whole histories, one lane at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

KEY = ["kind", "space"]
OUT = "kind string, space string, job long, version int, status string, code string, at long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Lane:
    """The lists of a lane and its transitions. queue: (job, version); running: (job, version, started)."""

    def __init__(self, room: int, stall: int, queue: list[tuple] = (), running: list[tuple] = ()):
        self.room, self.stall, self.queue, self.running = room, stall, list(queue), list(running)

    def expire(self, now: int) -> Iterator[tuple]:
        """Running jobs whose time is up at ``now``; (job, version, status, code, at)."""
        for job, version, started in self.running:
            if started + self.stall <= now:
                yield job, version + 1, "error", "stalled", started + self.stall
        self.running = [r for r in self.running if r[2] + self.stall > now]

    def step(self, job: int, action: str, at: int) -> Iterator[tuple]:
        yield from self.expire(at)
        if action == "submit":
            if len(self.queue) < self.room:
                self.queue.append((job, 1))
                yield job, 1, "queued", "", at
            else:
                yield job, 1, "error", "queue_full", at
        elif action == "take" and self.queue:
            first, version = self.queue.pop(0)
            self.running.append((first, version + 1, at))
            yield first, version + 1, "processing", "", at
        elif action in ("finish", "fail") and self.running:
            first, version, _ = self.running.pop(0)
            yield first, version + 1, *(("success", "") if action == "finish" else ("error", "failed")), at
        elif action == "cancel" and self.queue:
            last, version = self.queue.pop()
            yield last, version + 1, "cancelled", "", at
        elif action == "cancel" and self.running:
            last, version, started = self.running.pop()
            self.running.append((last, version + 1, started))
            yield last, version + 1, "cancelling", "", at
        elif action == "restart":
            room = self.room - len(self.queue)
            back = [(j, v + 1) for j, v, _ in self.running[:room]]
            for j, v in back:
                yield j, v, "queued", "recovered", at
            for j, v, _ in self.running[room:]:
                yield j, v + 1, "error", "requeue_full", at
            self.queue, self.running = back + self.queue, []


def _rows(key: tuple, changes: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(*key, *c) for c in changes], columns=[*KEY, "job", "version", "status", "code", "at"])


def _ordered(rows: pd.DataFrame) -> Iterator[tuple]:
    rows = rows.sort_values(["at", "event_id"])
    return zip(rows["event_id"].tolist(), rows["action"].tolist(), rows["at"].tolist(), strict=True)


class _Lanes(StatefulProcessor):
    def __init__(self, room: int, stall: int):
        self.room, self.stall = room, stall

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getListState("queue", "job long, version int")
        self.running = handle.getListState("running", "job long, version int, started long")

    def _load(self) -> Lane:
        read = lambda s: [tuple(r) for r in s.get()] if s.exists() else []
        return Lane(self.room, self.stall, read(self.queue), read(self.running))

    def _keep(self, lane: Lane) -> None:
        for state, rows in ((self.queue, lane.queue), (self.running, lane.running)):
            if rows:
                state.put(rows)
            else:
                state.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if lane.running:
            self.handle.registerTimer((min(r[2] for r in lane.running) + self.stall) * 1000)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  names of the interface
        lane = self._load()
        changes = [c for job, action, at in _ordered(pd.concat(list(rows))) for c in lane.step(job, action, at)]
        self._keep(lane)
        yield _rows(key, changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        lane = self._load()
        changes = list(lane.expire(expiredTimerInfo.getExpiryTimeInMs() // 1000))
        self._keep(lane)
        yield _rows(key, changes)

    def close(self) -> None:
        pass


def stream(events: DataFrame, room: int, stall: int, late: str = "0 seconds") -> DataFrame:
    """Changes of jobs (OUT) of a stream of events: kind, space, event_id, action, at (unix seconds); the session's state store must be RocksDB (see ``ROCKS``)."""
    timed = events.withColumn("ts", F.timestamp_seconds("at")).withWatermark("ts", late)
    return timed.groupBy(*KEY).transformWithStateInPandas(_Lanes(room, stall), OUT, "Append", "EventTime")


def replay(events: DataFrame, room: int, stall: int, until: int) -> DataFrame:
    """The same changes from whole histories; jobs that still run end as stalled if their time is up at ``until``."""

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lane = Lane(room, stall)
        changes = [c for job, action, at in _ordered(rows) for c in lane.step(job, action, at)]
        return _rows(key, [*changes, *lane.expire(until)])

    return events.select(*KEY, "event_id", "action", "at").groupBy(*KEY).applyInPandas(fold, OUT)


def run_once(events: DataFrame, out: str, checkpoint: str, room: int, stall: int) -> None:
    """Run the stream over what has arrived since its checkpoint and append its changes to ``out``."""
    spark = events.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        stream(events, room, stall).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
