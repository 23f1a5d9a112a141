"""States of jobs by their events, with what is illegal told apart, as a parallel prefix over a sorted table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from marketloom.sources.sinks import pinned

# Which states an action leads from, and to which. What is not here is illegal and changes nothing.
MOVES = {
    "submit": {"new": "queued"},
    "start": {"queued": "running"},
    "finish": {"running": "done", "cancelling": "done"},
    "fail": {"running": "error", "cancelling": "error"},
    "cancel": {"queued": "cancelled", "running": "cancelling", "cancelling": "cancelling", "interrupted": "cancelling"},
    "stop": {"running": "cancelled", "cancelling": "cancelled"},
    "restart": {"queued": "interrupted", "running": "interrupted", "cancelling": "cancelled", "interrupted": "interrupted", "done": "done", "error": "error", "cancelled": "cancelled"},
    "resume": {"queued": "queued", "running": "running", "cancelling": "cancelling", "interrupted": "queued", "error": "queued", "cancelled": "queued"},
}
STATES = ["new", "queued", "running", "cancelling", "interrupted", "done", "error", "cancelled"]


def move(state: str, action: str | None) -> tuple[str, bool]:
    """The state after an action, and whether it was legal."""
    after = MOVES.get(action or "", {}).get(state)
    return (state, False) if after is None else (after, True)


def is_fresh(last: tuple | None, now: int, version: str | None, ttl: int) -> bool:
    """Whether what is known of a job still holds: within the time to live, and of the same version."""
    return last is not None and now - last[0] < ttl and version == last[1]


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The last four columns of each row: key, time, version and action."""
    for batch in batches:
        n = batch.num_columns
        yield batch, list(zip(*(batch.column(n - i).to_pylist() for i in (4, 3, 2, 1)), strict=True))


def _summary(batches: Iterator[pa.RecordBatch], ttl: int) -> Iterator[pa.RecordBatch]:
    """Of a partition's first and last key: first and last time and version, and for each state before the state after."""
    found: list[list] = []
    for _, rows in _keyed(batches):
        for key, now, version, action in rows:
            if not found or found[-1][0] != key:
                if len(found) == 2:
                    found.pop()
                found.append([key, now, version, now, version, list(STATES)])
                last = found[-1]
            else:
                last = found[-1]
                if not is_fresh((last[3], last[4]), now, version, ttl):
                    last[5] = ["new"] * len(STATES)
            last[3:] = [now, version, [move(s, action)[0] for s in last[5]]]
    p = TaskContext.get().partitionId()
    rows = [dict(zip(_SUMMARY.names, (p, i, *r), strict=True)) for i, r in enumerate(found)]
    yield pa.RecordBatch.from_pylist(rows, _SUMMARY)


_SUMMARY = pa.schema([("part", pa.int32()), ("place", pa.int32()), ("key", pa.string()), ("first", pa.int64()), ("first_version", pa.string()), ("last", pa.int64()), ("version", pa.string()), ("after", pa.list_(pa.string()))])


def carried(summary: list, ttl: int) -> dict[int, tuple]:
    """For each partition whose first key has rows before it: key, last time and version, and state there."""
    out, known = {}, None
    for r in sorted(summary, key=lambda r: (r.part, r.place)):
        state = "new"
        if known is not None and known[0] == r.key:
            out[r.part] = known
            state = known[3] if is_fresh(known[1:3], r.first, r.first_version, ttl) else "new"
        known = (r.key, r.last, r.version, r.after[STATES.index(state)])
    return out


def _replay(batches: Iterator[pa.RecordBatch], ttl: int, starts: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
    known = starts.get(TaskContext.get().partitionId())
    for batch, rows in _keyed(batches):
        out = []
        for key, now, version, action in rows:
            fresh = known is not None and known[0] == key and is_fresh(known[1:3], now, version, ttl)
            before = known[3] if fresh else "new"
            after, legal = move(before, action)
            known = (key, now, version, after)
            out.append((before, after, legal))
        before, after, legal = zip(*out, strict=True) if out else ((), (), ())
        told = batch.select(range(batch.num_columns - 4))
        for name, values, kind in (("before", before, pa.string()), ("status", after, pa.string()), ("legal", legal, pa.bool_())):
            told = told.append_column(name, pa.array(values, kind))
        yield told


def job_states(events: DataFrame, key: str, action: str, version: str, ts: str = "ts", tie: str = "event_id", seconds: int = 30 * 86_400) -> DataFrame:
    """Adds before, status and legal to each event of a job, by time and tie. What is known of a job ends after so many
    seconds without an event, and with another version. Rows without a time are left out; null keys are one job.

    The table is sorted by job and time over all partitions and kept; each partition is one function from states to states
    for the job that it shares with its neighbours, of which the driver gets one or two rows each, and then replayed
    from the right state. So a job that holds a third of all events is dealt over as many tasks as its rows need."""
    columns = events.columns
    inner = events.toDF(*[f"_c{i}" for i in range(len(columns))])  # whatever the columns are called
    at = {c: F.col(f"_c{columns.index(c)}") for c in (key, action, version, ts, tie)}
    rows = inner.select("*", F.coalesce(at[key].cast("string"), F.lit("")).alias("_key"), F.unix_micros(at[ts].cast("timestamp")).alias("_micros"), at[version].cast("string").alias("_version"), at[action].alias("_action"))
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["_key", "_micros", f"_c{columns.index(tie)}"]
    sorted_ = rows.filter("_micros is not null").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    sorted_, ttl = pinned(sorted_), seconds * 1_000_000
    summary = sorted_.mapInArrow(lambda b: _summary(b, ttl), "part int, place int, key string, first long, first_version string, last long, version string, after array<string>")
    starts = carried(summary.collect(), ttl)  # two rows for each partition at most
    schema = inner.schema.add("before", StringType()).add("status", StringType()).add("legal", BooleanType())
    return sorted_.mapInArrow(lambda b: _replay(b, ttl, starts), schema).toDF(*columns, "before", "status", "legal")
