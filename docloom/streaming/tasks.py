"""R1-R11 on Structured Streaming: task events, changes of status, first steps, lockouts, live usage."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Hours without a row after which a task's state goes.
IDLE_HOURS = 72
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, schema: str | None = None, files_a_trigger: int = 16) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema or spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def deduplicated(stream: DataFrame, key: str = "id", time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each id once; ids are forgotten after the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def _rows(batches: Iterator[pd.DataFrame], *columns: str) -> Iterator[tuple]:
    """A key's rows of this batch by ``seq``."""
    rows = pd.concat([b[list(columns)] for b in batches]).sort_values("seq")
    return zip(*(rows[c].tolist() for c in columns))


def status_changes(stream: DataFrame, idle_hours: float = IDLE_HOURS, late: str = "1 hour") -> DataFrame:
    """R2: (task_id, seq, status): a row where a task's status differs from the one before; nothing after an end.

    ``stream``: task_id, seq, ts, status. A task is forgotten when its last row is ``idle_hours`` older than the watermark.
    """
    span = int(idle_hours * 3_600_000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, done, latest = state.get if state.exists else (None, False, 0)
        out = []
        for seq, at, status in _rows(batches, "seq", "ts", "status"):
            latest = max(latest, int(at.timestamp() * 1000))
            if not done and status != last:
                out.append((key[0], seq, status))
                last, done = status, status in ("completed", "failed", "cancelled")
        state.update((last, done, latest))
        state.setTimeoutTimestamp(max(latest + span, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["task_id", "seq", "status"])

    return stream.withWatermark("ts", late).groupBy("task_id").applyInPandasWithState(step, "task_id long, seq long, status string", "last string, done boolean, latest long", "append", GroupStateTimeout.EventTimeTimeout)


def first_steps(stream: DataFrame, idle_hours: float = IDLE_HOURS, late: str = "1 hour") -> DataFrame:
    """The first row of each step, named by the prefix of its log line, of each task; forgotten as in ``status_changes``."""
    span = int(idle_hours * 3_600_000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, latest = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        out = []
        for seq, at, name in _rows(batches, "seq", "ts", "step"):
            latest = max(latest, int(at.timestamp() * 1000))
            if name not in seen:
                seen.append(name)
                out.append((key[0], seq, name))
        state.update((seen, latest))
        state.setTimeoutTimestamp(max(latest + span, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["task_id", "seq", "step"])

    named = stream.select("task_id", "seq", "ts", F.regexp_extract("message", r"^\[(\w+)\]", 1).alias("step")).where("step <> ''")
    return named.withWatermark("ts", late).groupBy("task_id").applyInPandasWithState(step, "task_id long, seq long, step string", "seen array<string>, latest long", "append", GroupStateTimeout.EventTimeTimeout)


def lockouts(stream: DataFrame, most: int = 3) -> DataFrame:
    """(key, seq, failures, locked) after each event; a success resets the count, but not a lock.

    Only keys with failures or a lock have state.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, locked = state.get if state.exists else (0, False)
        out = []
        for seq, ok in _rows(batches, "seq", "ok"):
            failures = 0 if ok else failures + 1
            locked = bool(locked or failures >= most)
            out.append((key[0], seq, failures, locked))
        if failures or locked:
            state.update((failures, locked))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "seq", "failures", "locked"])

    return stream.groupBy("key").applyInPandasWithState(step, "key long, seq long, failures long, locked boolean", "failures long, locked boolean", "append", GroupStateTimeout.NoTimeout)


def live_usage(stream: DataFrame) -> DataFrame:
    """Token sums by component so far; for complete mode."""
    return stream.groupBy("component").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.count("*").alias("calls"))


def windowed_usage(stream: DataFrame, size: str = "1 day", late: str = "1 day", time: str = "ts") -> DataFrame:
    """R7 on event time: sums by window and component; late rows beyond the watermark are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), "component").agg(F.sum("tokens_in").alias("tokens_in"), F.count("*").alias("calls"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what is there and stops; a second run goes on from the checkpoint."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def latest_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Processes what is there in complete mode; each batch's whole result is written, the last one is read."""

    def write(result: DataFrame, batch: int) -> None:
        result.write.mode("overwrite").parquet(f"{path}/batch={batch:09d}")

    stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    every = stream.sparkSession.read.parquet(path)
    return every.join(F.broadcast(every.agg(F.max("batch").alias("batch"))), "batch").drop("batch")


class Queue:
    """Tasks in order of arrival, ``most`` at a time; rows of the store say what runs, so a restart goes on where it was."""

    def __init__(self, most: int = 3):
        self.most, self.waiting, self.running = most, [], set()

    def restore(self, tasks: list[tuple[int, str]]) -> None:
        """Running tasks of a lost process wait again, before the others."""
        self.waiting = [t for t, s in tasks if s == "running"] + [t for t, s in tasks if s == "queued"]

    def add(self, task: int) -> None:
        if task not in self.waiting and task not in self.running:
            self.waiting.append(task)

    def start(self) -> list[int]:
        """The tasks that may begin now."""
        free = max(0, self.most - len(self.running))
        begun, self.waiting = self.waiting[:free], self.waiting[free:]
        self.running.update(begun)
        return begun

    def finish(self, task: int) -> None:
        self.running.discard(task)

    def cancel(self, task: int) -> bool:
        """Whether the task was there."""
        known = task in self.waiting or task in self.running
        self.waiting = [t for t in self.waiting if t != task]
        self.running.discard(task)
        return known

    def position(self, task: int) -> int:
        """W17."""
        return 0 if task in self.running else self.waiting.index(task) + 1 if task in self.waiting else -1
