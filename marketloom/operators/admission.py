"""Exact sliding admission: an event is admitted if fewer than `limit` admitted events lie in the window before it."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType

#: Seconds by which a key's events are cut into spans that are looked at side by side.
SPAN = 6 * 3600


def step(held: deque, now: int, limit: int, window: int) -> int:
    """0 if an event is admitted (held, the times of those admitted, gets it), else the seconds to wait; in microseconds."""
    while held and held[0] <= now - window:
        held.popleft()
    if len(held) >= limit:
        return max(1, (window - (now - held[0])) // 1_000_000) if limit else max(1, window // 1_000_000)
    held.append(now)
    return 0


def with_run(events: DataFrame, key: str, micros: str, window: int, span: int = SPAN) -> DataFrame:
    """Adds `_run`, the time at which a key's events last began after a pause of a whole window or more: nothing that was
    admitted before can count any more, so each run is admitted by itself. Runs are found span by span; only one row
    for each span is then looked at by key."""
    cut = F.floor(F.col(micros) / (span * 1_000_000)).cast("long")
    rows = events.withColumn("_span", cut)
    inside = Window.partitionBy(key, "_span").orderBy(micros)
    gap = F.col(micros) - F.lag(micros).over(inside)
    rows = rows.withColumn("_begins", F.when(gap >= window, F.col(micros)))
    rows = rows.withColumn("_inner", F.max("_begins").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = rows.groupBy(key, "_span").agg(F.min(micros).alias("_first"), F.max(micros).alias("_last"), F.max("_begins").alias("_within"))
    order = Window.partitionBy(key).orderBy("_span")
    before = F.lag("_last").over(order)
    own = F.when(before.isNull() | (F.col("_first") - before >= window), F.col("_first"))
    spans = spans.withColumn("_own", own).withColumn("_start", F.greatest("_own", F.max(F.coalesce("_within", "_own")).over(order.rowsBetween(Window.unboundedPreceding, -1))))
    spans = spans.select(F.col(key).alias("_k"), F.col("_span").alias("_s"), "_start")
    joined = rows.join(spans, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_span") == F.col("_s")))
    return joined.withColumn("_run", F.coalesce("_inner", "_start")).drop("_span", "_begins", "_inner", "_k", "_s", "_start")


def _decide(batches: Iterator[pa.RecordBatch], limit: int, window: int) -> Iterator[pa.RecordBatch]:
    """Rows come by key, run and time; of a run only the admitted times of one window are kept."""
    at, held = None, deque()
    for batch in batches:
        n = batch.num_columns
        waits = []
        for key, run, now in zip(*(batch.column(n - i).to_pylist() for i in (3, 2, 1)), strict=True):
            if (key, run) != at:
                at, held = (key, run), deque()
            waits.append(step(held, now, limit, window))
        rows = batch.select(range(n - 3))
        rows = rows.append_column("admitted", pa.array([w == 0 for w in waits], pa.bool_()))
        yield rows.append_column("retry_after", pa.array([w or None for w in waits], pa.int64()))


def admitted(events: DataFrame, key: str, ts: str = "ts", tie: str = "event_id", limit: int = 10, seconds: int = 60) -> DataFrame:
    """Adds admitted, and retry_after (whole seconds, one at least) to those rejected. Events of one key are taken by time and
    tie; a rejected event doesn't count against later ones. Rows without a time are left out; null keys are one key.
    A run of events without a pause of the window's length is decided in one task, in one pass, with `limit` times held."""
    window, columns = seconds * 1_000_000, events.columns
    inner = events.toDF(*[f"_c{i}" for i in range(len(columns))])  # whatever the columns are called
    at = {c: f"_c{columns.index(c)}" for c in (key, ts, tie)}
    rows = inner.withColumn("_micros", F.unix_micros(F.col(at[ts]).cast("timestamp"))).filter("_micros is not null").withColumn("_key", F.col(at[key]).cast("string"))
    dealt = with_run(rows, "_key", "_micros", window).repartition("_key", "_run").sortWithinPartitions("_key", "_run", "_micros", at[tie])
    dealt = dealt.select(*inner.columns, "_key", "_run", "_micros")
    schema = inner.schema.add("admitted", BooleanType()).add("retry_after", LongType())
    return dealt.mapInArrow(lambda batches: _decide(batches, limit, window), schema).toDF(*columns, "admitted", "retry_after")
