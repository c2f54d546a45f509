"""The job store's timers over several micro-batches, and merges that are repeated or break off."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillgraph.streaming import jobs
from quillgraph.streaming.merge_log import MergeLog, merged

T0 = datetime(2024, 5, 1, 12)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def test_terminal_jobs_live_for_their_time_and_active_ones_stay(spark, tmp_path):
    schema = "id string, status string, updated_at timestamp"
    batches = [
        [("a", "running", at(0)), ("b", "completed", at(5)), ("c", "failed", at(10)), ("d", "running", at(10)), ("d", "completed", at(9)), (None, "running", at(1))],
        [("a", "running", at(200)), ("c", "running", at(180)), ("e", "completed", at(250)), ("a", None, at(100))],
        [("f", "running", at(500))],  # moves the watermark to 440: b is due at 305, e only at 550
        [("b", "running", at(460)), ("e", "running", at(445)), ("e", "completed", at(700))],
        [("g", "running", at(2000))],
    ]
    source = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        newest = max(source.glob("part-*"), key=lambda p: p.stat().st_mtime)
        import os

        os.utime(newest, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = jobs.job_changes(stream, 300).writeStream.option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out"))
    q.awaitTermination()
    changes = spark.read.parquet(str(tmp_path / "out"))
    evicted = sorted((r.id, r.updated_at) for r in changes.where("change = 'evicted'").collect())
    assert evicted == [("b", at(305)), ("e", at(1000))]
    left = {r.id: (r.status, r.updated_at) for r in jobs.store(changes).collect()}
    # d's older row is ignored, c runs again before its time is over, b comes again after its eviction
    assert left == {"a": ("running", at(200)), "b": ("running", at(460)), "c": ("running", at(180)), "d": ("running", at(10)), "f": ("running", at(500)), "g": ("running", at(2000))}


SCHEMA = StructType().add("id", "string").add("status", "string").add("v", "integer")


def folded(batches):
    """A plain merge of (number, rows) in order."""
    state = {}
    for number, rows in batches:
        last = {}
        for i, status, v in sorted((r for r in rows if r[0] is not None), key=lambda r: r[2] if r[2] is not None else -1):
            last[i] = (status, v)
        for i, (status, v) in last.items():
            if i in state and state[i][0] == "ready":
                continue
            state[i] = (status, v, state[i][2] if i in state else at(number), at(number))
    return sorted((i, *s) for i, s in state.items())


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({"_batch": F.lit("clash"), "extra": F.lit(1)})


def rows_of(log):
    return sorted(tuple(r) for r in log.table().select("id", "status", "v", "created_at", "updated_at").collect())


def test_repeated_and_broken_off_batches_change_nothing(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    batches = [(n, [(rng.choice([None, *"abcdefgh"]), rng.choice(["new", "failed", "ready", None]), rng.choice([None, *range(50)])) for _ in range(rng.randint(0, 12))]) for n in range(7)]
    batches[3] = (3, [])
    # two rows that are alike in all but the status have no order, so values are made different
    batches = [(n, [(i, s, None if v is None else v * 100 + k) for k, (i, s, v) in enumerate(rows)]) for n, rows in batches]
    batches = [(n, [r for k, r in enumerate(rows) if r[2] is not None or r[0] not in {x[0] for x in rows[:k] if x[2] is None}]) for n, rows in batches]
    log = MergeLog(spark, str(tmp_path / "log"), SCHEMA, order=("v",))
    assert rows_of(log) == [] and not log.compact()
    for n, rows in batches[:3]:
        assert log.append(frame(spark, rows), n, at(n))
    assert rows_of(log) == folded(batches[:3])
    assert not log.append(frame(spark, [("a", "other", 9)]), 1, at(99))  # delivered again, with other rows even

    with monkeypatch.context() as m:  # the driver is lost between the rows and their commit
        m.setattr(MergeLog, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            log.append(frame(spark, batches[3][1] or [("z", "new", 1)]), 3, at(3))
        with pytest.raises(RuntimeError):
            log.compact()
    assert rows_of(log) == folded(batches[:3])

    again = MergeLog(spark, str(tmp_path / "log"), SCHEMA, order=("v",))  # another driver goes on
    for n, rows in batches[3:5]:
        assert again.append(frame(spark, rows), n, at(n))
    assert again.compact() and not again.compact() and rows_of(again) == folded(batches[:5])
    assert all(not again.append(frame(spark, [("q", "new", 1)]), n, at(50)) for n in range(5))
    for n, rows in batches[5:]:
        again.append(frame(spark, rows), n, at(n))
    assert len(again.vacuum()) == 7 and again.vacuum() == []  # five batches that were folded, and what broke off
    assert rows_of(log) == folded(batches) == rows_of(again)
    assert merged([log, again]).count() == 2 * len(folded(batches))


def test_a_stream_that_restarts_merges_each_batch_once(spark, tmp_path):
    source, log = str(tmp_path / "in"), MergeLog(spark, str(tmp_path / "log"), SCHEMA, order=("v",))
    seen = []

    def run(fail_at=None):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)

        def put(batch, number):
            log.append(batch, number, at(number))
            seen.append(number)
            if number == fail_at:
                raise RuntimeError("lost after the commit")

        q = stream.writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
        q.awaitTermination()

    for i in range(3):
        spark.createDataFrame([("a", "new", i), (f"k{i}", "new", i)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="lost after the commit"):
        run(fail_at=1)
    run()
    assert seen == [0, 1, 1, 2] and {r[0] for r in rows_of(log)} == {"a", "k0", "k1", "k2"} and len(log._listed("commits")) == 3


def test_windows_restart_with_the_first_request_after_their_end(spark, tmp_path):
    from quillgraph.streaming import telemetry

    schema = "who string, ts timestamp"
    batches = [[("a", at(s)) for s in (0, 1, 2, 59, 60, 61)] + [("b", at(5))], [("a", at(s)) for s in (100, 130, 131)], [("c", at(5000))], [("a", at(5001)), ("b", at(5002)), ("b", at(5003)), ("b", at(5004)), ("b", at(5005))]]
    source = tmp_path / "in"
    import os

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        newest = max(source.glob("part-*"), key=lambda p: p.stat().st_mtime_ns)
        os.utime(newest, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = telemetry.restarting_limit(stream, "who", "ts", 60, 3).writeStream.option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out"))
    q.awaitTermination()
    refused = sorted((r.who, r.ts) for r in spark.read.parquet(str(tmp_path / "out")).where("not allowed").collect())
    # a: a window from 0 (59 is its fourth), one from 60 (60, 61, 100), one from 130; b: one from 5, whose state is gone by then, and one from 5002
    assert refused == [("a", at(59)), ("b", at(5005))]
    progress = q.recentProgress
    assert min(p["stateOperators"][0]["numRowsTotal"] for p in progress if p["batchId"] >= 2 and p["stateOperators"]) <= 2
