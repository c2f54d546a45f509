"""A store of jobs as a stream with state: each job's last status, of which terminal ones live for a time and are then evicted by a timer.

State lives in the session's state store provider (RocksDB, which ``configured`` sets): one row a job, which may be far more than memory holds. Time is event
time, so a replay gives the same evictions; rows later than the watermark are dropped.

Defined results: of a job's rows in one micro-batch the last by time and then status counts; a row older than what is known is ignored; an active job never
expires; a job that comes again after its eviction is a new one; rows without id are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TERMINAL = ("completed", "failed")
TTL_SECONDS, DELAY = 300, "1 minute"
_OUTPUT = "id string, status string, updated_at timestamp, change string"


def configured(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


class _Jobs(StatefulProcessor):
    def __init__(self, seconds: int, terminal: tuple[str, ...]):
        self.seconds, self.terminal = seconds, terminal

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, at_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.job.get() if self.job.exists() else None
        last, first = None, None
        for frame in rows:
            for at, status in zip(frame["updated_at"].astype("datetime64[us]").astype("int64").tolist(), frame["status"].tolist(), strict=True):
                if (known is None or at // 1000 >= known[1]) and (first is None or at < first):
                    first = at
                if last is None or (at, status or "") > (last[0], last[1] or ""):
                    last = at, status
        if last is None or known is not None and last[0] // 1000 < known[1]:
            return
        expiry = known[1] + self.seconds * 1000 if known is not None and known[0] in self.terminal else None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if expiry is not None and first // 1000 >= expiry:  # it was over before these rows, whatever batch its timer would have come in
            yield self._row(key, known[0], expiry * 1000, "evicted")
        self.job.update((last[1], last[0] // 1000))
        if last[1] in self.terminal:
            self.handle.registerTimer(max(last[0] // 1000 + self.seconds * 1000, timerValues.getCurrentWatermarkInMs() + 1))
        yield self._row(key, last[1], last[0], "put")

    def _row(self, key, status: str | None, at: int, change: str) -> pd.DataFrame:
        return pd.DataFrame({"id": [str(key[0])], "status": [status], "updated_at": [pd.Timestamp(at, unit="us")], "change": [change]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.job.exists():
            return
        status, _ = self.job.get()
        self.job.clear()
        yield self._row(key, status, expiredTimerInfo.getExpiryTimeInMs() * 1000, "evicted")

    def close(self) -> None:
        pass


def job_changes(events: DataFrame, seconds: int = TTL_SECONDS, terminal: tuple[str, ...] = TERMINAL, delay: str = DELAY) -> DataFrame:
    """``id, status, updated_at, change`` for a stream of ``id, status, updated_at``: each job that was put, and each that was evicted (at its expiry)."""
    configured(events.sparkSession)
    typed = events.where(F.col("id").isNotNull()).select(F.col("id").cast("string").alias("id"), "status", F.col("updated_at").cast("timestamp").alias("updated_at"))
    return typed.withWatermark("updated_at", delay).groupBy("id").transformWithStateInPandas(_Jobs(seconds, terminal), _OUTPUT, "Append", "EventTime")


def store(changes: DataFrame) -> DataFrame:
    """``id, status, updated_at`` of the jobs that the changes leave: the last change of each job, unless it is its eviction."""
    last = changes.groupBy("id").agg(F.max_by(F.struct("status", "updated_at", "change"), F.struct("updated_at", F.col("change") == "evicted")).alias("x"))
    return last.where("x.change = 'put'").select("id", "x.status", "x.updated_at")
