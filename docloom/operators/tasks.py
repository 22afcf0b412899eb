"""The task store: lists, queue, quotas, lockouts, retention."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible(tasks: DataFrame, session: int | str) -> DataFrame:
    """P10."""
    return tasks.where(F.col("is_sample") | (F.col("session_id") == session))


def listed(tasks: DataFrame, page: int = 1, size: int = 20, status: str | None = None) -> DataFrame:
    """L1: one page of tasks, the newest first; ``size`` is held between 1 and 100."""
    size = min(max(size, 1), 100)
    t = tasks if status is None else tasks.where(F.col("status") == status)
    return t.orderBy(F.desc("created_at"), "task_id").offset((max(page, 1) - 1) * size).limit(size)


def queue_positions(tasks: DataFrame) -> DataFrame:
    """1 for the next task of a session, 0 while running, -1 otherwise."""
    n = F.row_number().over(Window.partitionBy("session_id", "status").orderBy("created_at", "task_id"))
    return tasks.select("task_id", F.when(F.col("status") == "queued", n).when(F.col("status") == "running", 0).otherwise(-1).cast("long").alias("position"))


def log_tail(logs: DataFrame, after: int, most: int = 100) -> DataFrame:
    """L3: the report's next lines."""
    return logs.where(F.col("id") > after).orderBy("ts", "id").limit(most)


def quota(tasks: DataFrame, day: str, limit: int) -> DataFrame:
    """Counts by status, and what is left of the day."""
    today = (F.to_date("created_at") == F.lit(day).cast("date")) & (F.col("status") == "completed")
    c = tasks.groupBy("session_id").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("running", "queued", "completed")), F.count_if(today).alias("today"))
    return c.withColumn("remaining", F.greatest(F.lit(0).cast("long"), limit - F.col("today"))).withColumn("allowed", F.col("today") < limit)


def weekly_lockout(tasks: DataFrame, now: datetime | str) -> DataFrame:
    """Sessions with a success in the seven days before ``now``, and when they are free again."""
    at = F.lit(now).cast("timestamp")
    done = tasks.where((F.col("status") == "completed") & (F.col("created_at") > at - F.expr("INTERVAL 7 DAYS")) & (F.col("created_at") <= at))
    return done.groupBy("session_id").agg(F.max("created_at").alias("last_success")).withColumn("free_at", F.col("last_success") + F.expr("INTERVAL 7 DAYS"))


def expired(tasks: DataFrame, now: datetime | str, days: int) -> DataFrame:
    """Ended tasks older than the retention time; samples never end."""
    return tasks.where(~F.col("is_sample") & F.col("status").isin("completed", "failed") & (F.col("created_at") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")))


def without_expired(logs: DataFrame, expired_tasks: DataFrame) -> DataFrame:
    """Logs go with their tasks."""
    return logs.join(expired_tasks.select("task_id"), "task_id", "left_anti")


def failed_attempts(events: DataFrame, most: int = 3) -> DataFrame:
    """Failures since the last success by key (key, seq, ok); once ``most`` come in a row the key stays locked."""
    order = Window.partitionBy("key").orderBy("seq")
    runs = events.withColumn("island", F.sum(F.col("ok").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    by_run = runs.groupBy("key", "island").agg(F.count_if(~F.col("ok")).alias("failures"))
    return by_run.groupBy("key").agg(F.max_by("failures", "island").alias("failures"), (F.max("failures") >= most).alias("locked"))


def progress(steps: DataFrame) -> DataFrame:
    """Percent done before each step of a weighted pipeline (task_id, ord, weight)."""
    w = Window.partitionBy("task_id")
    before = F.coalesce(F.sum("weight").over(w.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return steps.withColumn("percent", F.floor(100 * before / F.sum("weight").over(w) + 0.5).cast("long"))


def complete_uploads(chunks: DataFrame) -> DataFrame:
    """Sessions all of whose chunks are there (session, chunk, total, data), joined in order, with the magic checked."""
    c = chunks.dropDuplicates(["session", "chunk"]).groupBy("session").agg(F.first("total").alias("total"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("chunk", "data"))).alias("parts"))
    whole = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["data"]))
    return c.where("n = total").select("session", whole.alias("data")).withColumn("is_pdf", F.substring("data", 1, 5) == F.lit(b"%PDF-"))


def day_of(ts: Column) -> Column:
    """The UTC day; the session's time zone is UTC."""
    return F.to_date(ts)
