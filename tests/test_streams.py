"""Streams with timers: what comes out doesn't depend on batches, restarts go on, state ends."""

from datetime import datetime, timedelta

from docloom.streaming import tasks as S
from docloom.streaming import timed

T0 = datetime(2024, 1, 1)


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def ran(spark, make, source, schema, at):
    S.run_available(make(spark.readStream.schema(schema).parquet(source)), f"{at}/out", f"{at}/checkpoint")
    return sorted(tuple(r) for r in spark.read.parquet(f"{at}/out").collect())


def test_locks_end_and_restarts_go_on(spark, tmp_path):
    schema, source, at = "session_id long, ts timestamp", f"file://{tmp_path}/in", f"file://{tmp_path}"
    day = lambda d: T0 + timedelta(days=d)
    put(spark, source, [(1, day(0)), (1, day(3)), (2, day(1)), (None, day(1))], schema)
    assert ran(spark, timed.weekly_locks, source, schema, at) == [(1, "locked", day(0)), (2, "locked", day(1))]
    put(spark, source, [(3, day(9))], schema)  # session 2 is free, 1 has a day to go
    assert ran(spark, timed.weekly_locks, source, schema, at) == [(1, "locked", day(0)), (2, "freed", day(8)), (2, "locked", day(1)), (3, "locked", day(9))]
    put(spark, source, [(1, day(10.5)), (2, day(30))], schema)
    assert set(ran(spark, timed.weekly_locks, source, schema, at)) == {(1, "locked", day(0)), (1, "freed", day(10)), (1, "locked", day(10.5)), (1, "freed", day(17.5)), (2, "locked", day(1)), (2, "freed", day(8)), (2, "locked", day(30)), (3, "locked", day(9)), (3, "freed", day(16))}


def test_uploads_expire(spark, tmp_path):
    schema, source, at = "session long, seq long, ts timestamp, kind string", f"file://{tmp_path}/in", f"file://{tmp_path}"
    minute = lambda m: T0 + timedelta(minutes=m)
    put(spark, source, [(1, 1, minute(0), "open"), (1, 2, minute(5), "part"), (1, 3, minute(10), "complete"), (2, 4, minute(0), "open"), (2, 5, minute(31), "complete"), (3, 6, minute(20), "open")], schema)
    assert ran(spark, timed.upload_sessions, source, schema, at) == [(1, "completed", minute(10)), (2, "expired", minute(30))]
    put(spark, source, [(4, 7, minute(300), "complete")], schema)
    assert ran(spark, timed.upload_sessions, source, schema, at) == [(1, "completed", minute(10)), (2, "expired", minute(30)), (3, "expired", minute(50))]


def test_tail_resumes_beyond_its_high_water_id(spark, tmp_path):
    schema, source, at = "task_id long, id long, ts timestamp", f"file://{tmp_path}/in", f"file://{tmp_path}"
    put(spark, source, [(1, 2, T0), (1, 1, T0), (1, 2, T0)], schema)
    assert [r[1] for r in ran(spark, timed.log_tail, source, schema, at)] == [1, 2]
    put(spark, source, [(1, 2, T0), (1, 3, T0), (2, 1, T0)], schema)
    assert [r[:2] for r in ran(spark, timed.log_tail, source, schema, at)] == [(1, 1), (1, 2), (1, 3), (2, 1)]


def test_statuses_over_restarts(spark, tmp_path):
    schema, source, at = "task_id long, seq long, ts timestamp, status string", f"file://{tmp_path}/in", f"file://{tmp_path}"
    put(spark, source, [(1, 1, T0, "queued"), (1, 2, T0, "queued"), (1, 3, T0, "running")], schema)
    put(spark, source, [(1, 4, T0, "running"), (1, 5, T0, "completed"), (1, 6, T0, "running")], schema)
    assert ran(spark, S.status_changes, source, schema, at) == [(1, 1, "queued"), (1, 3, "running"), (1, 5, "completed")]
