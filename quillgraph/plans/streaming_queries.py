"""Streaming queries: each reads ``events`` as a file stream, runs it to its end and returns the sink's rows."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import shared_folder
from ..streaming import jobs
from ..streaming import telemetry as s
from ..streaming.merge_log import MergeLog
from .registry import query
from .roles import t


def _stream(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    path, glob = (f"{d}/events.parquet", None) if _is_folder(spark, f"{d}/events.parquet") else (d, "events.parquet")
    reader = spark.readStream.schema(schema)
    return (reader if glob is None else reader.option("pathGlobFilter", glob)).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _finished(df: DataFrame, mode: str) -> DataFrame:
    """The rows of a stream that has run through all there is, from files in the shared folder; progress is kept there too."""
    base = f"{shared_folder(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    rows = f"{base}/rows"
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").start(rows)
    else:  # a batch is the whole result
        q = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(rows)).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(rows)


@query("r01_stream_latest_state", "SELECT DISTINCT ON (user_id) user_id, ts, event_type FROM events ORDER BY user_id, ts DESC, event_type DESC")
def _(spark, d):
    return _finished(s.latest_state(_stream(spark, d), "user_id", "ts", "event_type"), "complete").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("r04_stream_daily_rollup", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS provider, round(sum(value), 4) AS cost, count(*) AS requests FROM events GROUP BY 1, 2")
def _(spark, d):
    usage = _stream(spark, d).select("ts", F.col("event_type").alias("provider"), F.col("value").alias("cost_usd"))
    return _finished(s.daily_rollup(usage), "complete").withColumn("cost", F.round("cost", 4))


@query("r03_stream_rate_limit", "SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS window_start, count(*) AS requests FROM events GROUP BY 1, 2 HAVING count(*) > 3")
def _(spark, d):
    return _finished(s.over_limit(_stream(spark, d), "event_type", "ts", 3600, 3), "complete").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("r03_stream_restarting_limit", """WITH RECURSIVE o AS MATERIALIZED (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events), r AS (SELECT user_id, i, ts AS start, 1 AS used FROM o WHERE i = 1
    UNION ALL SELECT o.user_id, o.i, CASE WHEN o.ts >= r.start + INTERVAL 1 HOUR THEN o.ts ELSE r.start END, CASE WHEN o.ts >= r.start + INTERVAL 1 HOUR THEN 1 ELSE used + 1 END FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
  SELECT user_id::VARCHAR AS user_id, used <= 3 AS allowed, count(*) AS n FROM r GROUP BY ALL""")
def _(spark, d):
    return _finished(s.restarting_limit(_stream(spark, d), "user_id", "ts", 3600, 3), "append").groupBy("user_id", "allowed").agg(F.count(F.lit(1)).alias("n"))


@query("r06_stream_deduplicated", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    return _finished(s.deduplicated(_stream(spark, d), "event_id", "ts").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "complete")


_TERMINAL = "CASE event_type WHEN 'click' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END"


def _job_rows(events: DataFrame, ident: str) -> DataFrame:
    status = F.when(F.col("event_type") == "click", "completed").when(F.col("event_type") == "error", "failed").otherwise("running")
    return events.select(F.col(ident).cast("string").alias("id"), status.alias("status"), F.col("ts").alias("updated_at"))


@query("r02_stream_job_store", f"""WITH j AS (SELECT DISTINCT ON (user_id) user_id::VARCHAR AS id, {_TERMINAL} AS status, ts AS updated_at FROM events ORDER BY user_id, ts DESC, {_TERMINAL} DESC)
  SELECT id, status, updated_at FROM j WHERE status = 'running' OR updated_at + INTERVAL 6 HOUR > (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE""")
def _(spark, d):
    changes = _finished(jobs.job_changes(_job_rows(_stream(spark, d), "user_id"), 6 * 3600), "append")
    return jobs.store(changes).withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


@query("r06_merge_log", """WITH l AS (SELECT DISTINCT ON (user_id, event_id % 4) user_id AS id, event_id % 4 AS b, CASE event_type WHEN 'purchase' THEN 'ready' ELSE event_type END AS status, value FROM events ORDER BY user_id, event_id % 4, ts DESC, event_id DESC),
  r AS (SELECT *, min(CASE WHEN status = 'ready' THEN b END) OVER (PARTITION BY id) AS ready, min(b) OVER (PARTITION BY id) AS first FROM l)
  SELECT DISTINCT ON (id) id, status, value, first::INT AS created_by, b::INT AS updated_by FROM r WHERE ready IS NULL OR b <= ready ORDER BY id, b DESC""")
def _(spark, d):
    """The events in four deliveries, each made twice, with the log folded between; a delivery's number stands for its time."""
    events = t(spark, d, "events").select(F.col("user_id").alias("id"), F.when(F.col("event_type") == "purchase", "ready").otherwise(F.col("event_type")).alias("status"), "value", "ts", "event_id")
    log = MergeLog(spark, f"{shared_folder(spark)}/merge-{uuid.uuid4().hex}", events.schema, order=("ts", "event_id"))
    begin = datetime(2024, 1, 1, tzinfo=timezone.utc)
    for number in (0, 0, 1, 2, 1, 2, 3, 3):
        log.append(events.where(F.pmod("event_id", F.lit(4)) == number), number, begin + timedelta(days=number))
        if number == 1:
            log.compact()
    day = lambda c: F.date_diff(F.col(c), F.lit(begin.date())).cast("int")
    return log.table().select("id", "status", "value", day("created_at").alias("created_by"), day("updated_at").alias("updated_by"))
