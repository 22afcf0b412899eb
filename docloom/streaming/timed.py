"""R3, R7, R8 as streams whose state ends: weekly locks, upload sessions, log tails, by timers on event time.

Each key's rows of a micro-batch are taken by time, so what comes out doesn't depend on how the rows fall into batches, as long as
these come in order; a timer that is due before the watermark fires in the next batch, at the latest in the last empty one. A
key without lock, open session or recent log line has no state. Rows without time or key are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MICROS = 1_000_000
DAY = 24 * 3600 * MICROS


def _micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy("datetime64[us]").astype(np.int64)


def _times(micros: list[int]) -> pd.Series:
    return pd.Series(np.array(micros, np.int64).astype("datetime64[us]"))


def _due(state: GroupState, at: int) -> bool:
    """Sets the timer to ``at``; true if the watermark has passed it already."""
    ms = -(-at // 1000)
    if ms <= state.getCurrentWatermarkMs():
        return True
    state.setTimeoutTimestamp(ms)
    return False


def weekly_locks(stream: DataFrame, days: float = 7, late: str = "1 hour") -> DataFrame:
    """(session_id, kind, at): ``locked`` at a success of a free session, ``freed`` when its last success is ``days`` old.

    ``stream`` holds successes: session_id, ts.
    """
    span = int(days * DAY)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        if not state.hasTimedOut:
            for t in sorted(np.concatenate([_micros(b.ts) for b in batches]).tolist()):
                if last is not None and t >= last + span:
                    out.append(("freed", last + span))
                    last = None
                if last is None:
                    out.append(("locked", t))
                last = t if last is None else max(last, t)
        if state.hasTimedOut or _due(state, last + span):
            out.append(("freed", last + span))
            state.remove()
        else:
            state.update((last,))
        if out:
            yield pd.DataFrame({"session_id": key[0], "kind": [k for k, _ in out], "at": _times([t for _, t in out])})

    known = stream.where("session_id is not null and ts is not null").select("session_id", "ts")
    return known.withWatermark("ts", late).groupBy("session_id").applyInPandasWithState(step, "session_id long, kind string, at timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def upload_sessions(stream: DataFrame, minutes: float = 30, late: str = "1 hour") -> DataFrame:
    """(session, outcome, at): an opened session is ``completed``, or ``expired`` once it is ``minutes`` old.

    ``stream``: session, seq, ts, kind (open, complete, or anything else for parts). Rows of a closed session say nothing.
    """
    span = int(minutes * 60 * MICROS)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened = state.get[0] if state.exists else None
        out = []
        if state.hasTimedOut:
            out.append(("expired", opened + span))
            opened = None
        else:
            rows = pd.concat([b[b.kind.isin(["open", "complete"])] for b in batches]).sort_values(["ts", "seq"])
            for t, kind in zip(_micros(rows.ts).tolist(), rows.kind.tolist()):
                if opened is not None and t >= opened + span:
                    out.append(("expired", opened + span))
                    opened = None
                if kind == "open" and opened is None:
                    opened = t
                elif kind == "complete" and opened is not None:
                    out.append(("completed", t))
                    opened = None
        if opened is not None and _due(state, opened + span):
            out.append(("expired", opened + span))
            opened = None
        if opened is not None:
            state.update((opened,))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame({"session": key[0], "outcome": [k for k, _ in out], "at": _times([t for _, t in out])})

    known = stream.where("session is not null and ts is not null").select("session", "seq", "ts", "kind")
    return known.withWatermark("ts", late).groupBy("session").applyInPandasWithState(step, "session long, outcome string, at timestamp", "opened long", "append", GroupStateTimeout.EventTimeTimeout)


def log_tail(stream: DataFrame, idle_days: float = 1, late: str = "1 hour") -> DataFrame:
    """(task_id, id, ts) beyond each task's high-water id, in its order; a task that is silent for ``idle_days`` is forgotten.

    ``stream``: task_id, id, ts. A row that was read before, or that comes after a higher one of an earlier batch, isn't read again.
    """
    span = int(idle_days * DAY)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        high, latest = state.get if state.exists else (-1, 0)
        rows = pd.concat(list(batches)).drop_duplicates("id").sort_values("id")
        latest = max(latest, int(_micros(rows.ts).max()))
        rows = rows[rows.id > high]
        high = max([high, *rows.id.tolist()])
        if _due(state, latest + span):
            state.remove()
        else:
            state.update((high, latest))
        if len(rows):
            yield rows[["task_id", "id", "ts"]]

    known = stream.where("task_id is not null and id is not null and ts is not null").select("task_id", "id", "ts")
    return known.withWatermark("ts", late).groupBy("task_id").applyInPandasWithState(step, "task_id long, id long, ts timestamp", "high long, latest long", "append", GroupStateTimeout.EventTimeTimeout)
