"""Structured Streaming forms of the telemetry operators. Sources are any streaming DataFrame with an event-time column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType

from ..operators.graph import settled
from ..operators.store import upsert


def latest_state(events: DataFrame, key: str, time_column: str, value: str) -> DataFrame:
    """The last reported value of each key (for complete or update mode)."""
    return events.groupBy(key).agg(F.max(time_column).alias(time_column), F.max_by(value, F.struct(time_column, value)).alias(value))


def daily_rollup(usage: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Cost and requests by provider and UTC day; rows later than the delay are dropped.

    The watermark bounds the state in update and append mode; complete mode, which returns all days each time, keeps them all.
    """
    return (
        usage.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 day").alias("w"), "provider")
        .agg(F.sum("cost_usd").alias("cost"), F.count(F.lit(1)).alias("requests"))
        .select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "provider", "cost", "requests")
    )


def over_limit(requests: DataFrame, key: str, time_column: str, seconds: int = 60, limit: int = 60, delay: str = "1 minute") -> DataFrame:
    """Tumbling windows in which a key makes more requests than allowed."""
    counted = requests.withWatermark(time_column, delay).groupBy(key, F.window(time_column, f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    return counted.where(F.col("requests") > limit).select(key, F.col("w.start").alias("window_start"), "requests")


def restarting_limit(requests: DataFrame, key: str, time_column: str, seconds: int = 60, limit: int = 60, delay: str = "1 minute") -> DataFrame:
    """``key, ts, allowed``: windows that begin with the first request after the last one ended; state is two numbers a key.

    A key's state is dropped when the watermark has passed its window's end, so that keys that never come again take no place; rows later than the watermark
    are dropped. Rows of one micro-batch are taken in order of time: of a key's rows only the times are held, as eight bytes each.
    """
    schema = f"{key} string, ts timestamp, allowed boolean"

    def judge(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, used = state.get if state.exists else (None, 0)
        times = np.sort(np.concatenate([f["ts"].to_numpy("datetime64[us]").astype(np.int64) for f in frames]))
        allowed = []
        for second in (times / 1e6).tolist():
            if start is None or second >= start + seconds:
                start, used = second, 0
            used += 1
            allowed.append(used <= limit)
        state.update((start, used))
        state.setTimeoutTimestamp(max(int((start + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: str(group[0]), "ts": times.astype("datetime64[us]"), "allowed": allowed})

    typed = requests.select(F.col(key).cast("string").alias(key), F.col(time_column).cast("timestamp").alias("ts")).withWatermark("ts", delay)
    return typed.groupBy(key).applyInPandasWithState(judge, schema, "start double, used long", "append", GroupStateTimeout.EventTimeTimeout)


def expiring_jobs(events: DataFrame, ttl: str = "300 seconds", terminal: tuple[str, ...] = ("completed", "failed")) -> DataFrame:
    """``id, status, updated_at``: each job's changes; the state of a terminal job is forgotten when its time to live has passed.

    ``events``: id, status, updated_at.
    """
    seconds = pd.Timedelta(ttl).total_seconds()

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values("updated_at")
        status, at = rows["status"].iloc[-1], rows["updated_at"].iloc[-1]
        if state.exists and state.get[1] > at.timestamp():
            return  # older than what is known
        state.update((status, at.timestamp()))
        if status in terminal:
            state.setTimeoutTimestamp(max(int((at.timestamp() + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"id": [str(group[0])], "status": [status], "updated_at": [at]})

    watermarked = events.select(F.col("id").cast("string").alias("id"), "status", F.col("updated_at").cast("timestamp").alias("updated_at")).withWatermark("updated_at", "1 minute")
    return watermarked.groupBy("id").applyInPandasWithState(step, "id string, status string, updated_at timestamp", "status string, at double", "update", GroupStateTimeout.EventTimeTimeout)


def deduplicated(events: DataFrame, key: str, time_column: str, delay: str = "1 hour") -> DataFrame:
    """Each key once within the delay: a source that delivers at least once becomes exactly once."""
    return events.withWatermark(time_column, delay).dropDuplicatesWithinWatermark([key])


def upserting(stream: DataFrame, path: str, initial: Callable[[], DataFrame], key: str = "id", buckets: int = 64) -> DataStreamWriter:
    """Upserts each micro-batch into the table under ``path``, which lies in ``buckets`` parts by a hash of the key.

    Only the parts that a batch has keys for are read and written again; a batch that is repeated upserts the same rows once more. Parts are replaced in place: readers may see some
    of a batch, and a driver that is lost meanwhile leaves them to the repeated batch. ``merge_log`` has neither; this is for a plain table that others read.
    ``initial`` gives the table before the first batch. Rows of a batch with status ``ready`` in the table are skipped.
    """
    part = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession

        def put(rows: DataFrame) -> None:
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)

        if number == 0:
            put(initial().withColumn("part", part))
        table = spark.read.schema(initial().schema.add("part", IntegerType())).parquet(path)
        touched = [r.part for r in batch.select(part.alias("part")).distinct().collect()]  # ``buckets`` numbers at most
        before = table.where(F.col("part").isin(touched)).drop("part")
        if "status" in before.columns:
            batch = batch.join(before.where("status = 'ready'").select(key), key, "left_anti")
        put(settled(upsert(before, batch, F.current_timestamp(), key).withColumn("part", part)))

    return stream.writeStream.foreachBatch(apply)
