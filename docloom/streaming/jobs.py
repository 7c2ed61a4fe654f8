"""Stateful operators as streams: failure events once, job versions, stalls."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def failures_once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each (query_id, failure_code) once while its first event is inside the watermark. events: query_id, failure_code, ts."""
    return events.filter("failure_code <> ''").withWatermark("ts", late).dropDuplicatesWithinWatermark(["query_id", "failure_code"])


def latest_activity(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Newest event of each kb in each window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "kb").agg(F.max("ts").alias("latest"), F.count(F.lit(1)).alias("n"))


def job_versions(events: DataFrame) -> DataFrame:
    """job, version, phase, ts: a row whenever the public snapshot (phase, tens of k) of a job changes. events: job, phase, k, ts."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, last = state.get if state.exists else (0, "")
        out = []
        rows = pd.concat(list(parts)).sort_values(["ts", "k"])
        for phase, k, ts in zip(rows["phase"], rows["k"], rows["ts"], strict=True):
            now = f"{phase}:{int(k) // 10}"
            if now != last:
                version, last = version + 1, now
                out.append((key[0], version, phase, ts))
        state.update((version, last))
        yield pd.DataFrame(out, columns=["job", "version", "phase", "ts"])

    return events.groupBy("job").applyInPandasWithState(step, "job long, version long, phase string, ts timestamp", "version long, last string", "append", GroupStateTimeout.NoTimeout)


def stalled_jobs(events: DataFrame, seconds: int, late: str = "0 seconds") -> DataFrame:
    """job, since, phase of jobs that gave no sign for ``seconds`` of event time. events: job, phase, ts."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            since, phase = state.get
            state.remove()
            yield pd.DataFrame([(key[0], pd.Timestamp(since, unit="ms"), phase)], columns=["job", "since", "phase"])
            return
        rows = pd.concat(list(parts)).sort_values("ts")
        since, phase = int(rows["ts"].iloc[-1].timestamp() * 1000), rows["phase"].iloc[-1]
        if state.exists and state.get[0] > since:
            since, phase = state.get
        state.update((since, phase))
        state.setTimeoutTimestamp(max(since + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([], columns=["job", "since", "phase"])

    return events.withWatermark("ts", late).groupBy("job").applyInPandasWithState(step, "job long, since timestamp, phase string", "since long, phase string", "append", GroupStateTimeout.EventTimeTimeout)
