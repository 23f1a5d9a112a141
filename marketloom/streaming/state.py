"""Job events as streams: the current state of every job, events per window, exact admission and job states."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marketloom.operators.admission import step
from marketloom.operators.jobs import is_fresh, move


def current_state(events: DataFrame, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """The latest event type of each key; write it in update or complete mode. Ties go to the larger event_id."""
    return events.groupBy(key).agg(F.max_by("event_type", F.struct(ts, "event_id")).alias("status"), F.max(ts).alias("at"))


def admitted_per_window(events: DataFrame, length: str = "60 seconds", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Events per window and type; rows later than the watermark are left out."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, late).groupBy(F.window(ts, length).alias("window"), "event_type").agg(F.count(F.lit(1)).alias("events"))


def _frame(columns: dict[str, list]) -> pd.DataFrame:
    """With texts as plain objects, which Arrow takes in one piece."""
    return pd.DataFrame({name: pd.Series(v, dtype=object if v and isinstance(v[0], str) else None) for name, v in columns.items()})


class Limiter(StatefulProcessor):
    """Admits an event of a key if fewer than `limit` admitted ones lie in the window before it; their times are a list
    state, and a timer removes it when the window has passed over the last."""

    def __init__(self, limit: int, seconds: int) -> None:
        self.limit, self.window = limit, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "micros long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = deque(r[0] for r in self.times.get())
        events = pd.concat(list(rows)).sort_values(["micros", "event_id"])
        waits = [step(held, int(now), self.limit, self.window) for now in events.micros]
        if held:
            self.times.put([(t,) for t in held])
            self.handle.registerTimer((held[-1] + self.window) // 1000 + 1)
        yield _frame({"event_id": events.event_id.tolist(), "key": [str(key[0])] * len(waits), "admitted": [w == 0 for w in waits], "retry_after": waits})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [r[0] for r in self.times.get()]
        if not held or (held[-1] + self.window) // 1000 < timerValues.getCurrentWatermarkInMs():
            self.times.clear()
        return iter(())

    def close(self) -> None:
        pass


class Jobs(StatefulProcessor):
    """The state of a job by its events. An event that is older than one already taken is late and changes nothing; an
    illegal one changes nothing but the time. A timer forgets the job when its time to live has passed."""

    def __init__(self, seconds: int) -> None:
        self.ttl = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "micros long, event_id long, version string, status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = tuple(self.job.get()) if self.job.exists() else None
        events, out = pd.concat(list(rows)).sort_values(["micros", "event_id"]), []
        for now, event_id, version, action in zip(events.micros.tolist(), events.event_id.tolist(), events.version, events.action, strict=True):
            if known and (now, event_id) < known[:2]:
                out.append((known[3], known[3], "late"))
                continue
            before = known[3] if known and is_fresh((known[0], known[2]), now, version, self.ttl) else "new"
            after, legal = move(before, action)
            known = (now, event_id, version, after)
            out.append((before, after, "legal" if legal else "illegal"))
        self.job.update(known)
        self.handle.registerTimer((known[0] + self.ttl) // 1000 + 1)
        before, status, outcome = map(list, zip(*out, strict=True))
        yield _frame({"event_id": events.event_id.tolist(), "key": [str(key[0])] * len(out), "before": before, "status": status, "outcome": outcome})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.job.exists() and (self.job.get()[0] + self.ttl) // 1000 < timerValues.getCurrentWatermarkInMs():
            self.job.clear()
        return iter(())

    def close(self) -> None:
        pass


def _timed(events: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    at = F.col(ts).cast("timestamp")
    return events.withColumns({"_at": at, "micros": F.unix_micros(at), "_key": F.col(key).cast("string")}).withWatermark("_at", late)


def limited(events: DataFrame, key: str, limit: int, seconds: int, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """event_id, key, admitted and retry_after (0 if admitted) of a stream of events; the batch form is
    operators.admission.admitted. Needs the RocksDB state store; rows later than the watermark are left out."""
    rows = _timed(events, key, ts, late).select("_key", "_at", "micros", "event_id")
    schema = "event_id long, key string, admitted boolean, retry_after long"
    return rows.groupBy("_key").transformWithStateInPandas(Limiter(limit, seconds), schema, "Append", "EventTime")


def job_outcomes(events: DataFrame, key: str, action: str, version: str, seconds: int, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """event_id, key, before, status and outcome (legal, illegal or late) of a stream of job events; the batch form is
    operators.jobs.job_states."""
    rows = _timed(events, key, ts, late).select("_key", "_at", "micros", "event_id", F.col(version).cast("string").alias("version"), F.col(action).alias("action"))
    schema = "event_id long, key string, before string, status string, outcome string"
    return rows.groupBy("_key").transformWithStateInPandas(Jobs(seconds), schema, "Append", "EventTime")
