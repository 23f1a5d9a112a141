"""Admission and job states: batch forms against sequential loops, streams against the batch forms, over a restart."""

import datetime
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from marketloom.operators import admission, jobs
from marketloom.sources.tables import job_events
from marketloom.streaming import state

SMALL = "/root/testdata/sf0.001"
START = datetime.datetime(2024, 1, 1)


def loop_admits(rows, limit, seconds):
    """rows: (event_id, key, microseconds). One list of admitted times for each key, from first to last."""
    held, out = {}, {}
    for event_id, key, now in sorted(rows, key=lambda r: (str(r[1]), r[2], r[0])):
        times = held.setdefault(key, [])
        inside = [t for t in times if t > now - seconds * 1_000_000]
        ok = len(inside) < limit
        out[event_id] = ok
        if ok:
            times.append(now)
    return out


@pytest.mark.parametrize(("limit", "seconds"), [(1, 60), (3, 60), (5, 600), (2, 30_000)])
def test_admission_is_a_loop(spark, limit, seconds):
    """Busy and quiet keys, equal times, pauses of exactly a window, and a key with half of all rows."""
    rng, rows, at = random.Random(limit), [], {}
    for i in range(3_000):
        key = rng.choice(["hot", "hot", "hot", "a", "b", None])
        at[key] = at.get(key, 0) + rng.choice([0, 1, 7, 59, 60, 61, 3_000, 40_000]) * 1_000_000 // rng.choice([1, 1, 30])
        rows.append((i, key, START + datetime.timedelta(microseconds=at[key])))
    frame = spark.createDataFrame(rows, "event_id long, key string, ts timestamp").withColumn("x.y", F.lit(1)).repartition(5)
    got = {r.event_id: r.admitted for r in admission.admitted(frame, "key", limit=limit, seconds=seconds).collect()}
    assert got == loop_admits([(i, k, int((t - START).total_seconds() * 1e6)) for i, k, t in rows], limit, seconds)
    assert admission.admitted(frame.filter("event_id < 0"), "key").count() == 0


def test_a_step_tells_how_long_to_wait():
    held = deque()
    assert [admission.step(held, t * 1_000_000, 2, 60_000_000) for t in (0, 10, 20, 59, 60, 61)] == [0, 0, 40, 1, 0, 9]
    assert admission.step(deque(), 5, 0, 60_000_000) == 60


def loop_states(rows, seconds):
    known, out = {}, {}
    for event_id, job, micros, version, action in sorted(rows, key=lambda r: (str(r[1]), r[2], r[0])):
        last = known.get(job)
        before = last[2] if last and micros - last[0] < seconds * 1_000_000 and last[1] == version else "new"
        after = jobs.MOVES.get(action, {}).get(before)
        out[event_id] = (before, after or before, after is not None)
        known[job] = (micros, version, after or before)
    return out


def test_job_states_are_a_loop(spark):
    """A job with most of all rows lies over several partitions; versions change and the time to live passes."""
    rng, rows, at = random.Random(2), [], {}
    for i in range(4_000):
        job = rng.choice(["hot"] * 8 + ["a", "b", None])
        at[job] = at.get(job, 0) + rng.choice([0, 1, 30, 3_599, 3_600, 9_000])
        rows.append((i, job, START + datetime.timedelta(seconds=at[job]), str(i // 900), rng.choice([*jobs.MOVES, None, "odd"])))
    frame = spark.createDataFrame(rows, "event_id long, job string, ts timestamp, version string, action string").withColumn("x.y", F.lit(1)).repartition(6)
    want = loop_states([(i, j or "", int((t - START).total_seconds() * 1e6), v, a) for i, j, t, v, a in rows], 3_600)
    got = {r.event_id: (r.before, r.status, r.legal) for r in jobs.job_states(frame, "job", "action", "version", seconds=3_600).collect()}
    assert got == want
    assert jobs.job_states(frame.filter("event_id < 0"), "job", "action", "version").count() == 0


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run_once(spark, folder, schema, make, out, kept):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = make(stream).writeStream.format("parquet").option("checkpointLocation", kept).trigger(availableNow=True).start(out)
    query.awaitTermination()


def test_streams_equal_the_batch_forms_after_a_restart(rocks, tmp_path):
    """The second half arrives in a new query on the first one's checkpoint."""
    events = job_events(rocks, SMALL).withColumn("ts", F.col("ts").cast("timestamp"))
    folder = str(tmp_path / "in")
    admit = lambda s: state.limited(s, "kind", 2, 3_600, late="1 hour")
    move = lambda s: state.job_outcomes(s, "job", "action", "version", 5 * 86_400, late="1 hour")
    for half in (events.filter("event_id < 400"), events.filter("event_id >= 400")):
        half.coalesce(1).write.mode("append").parquet(folder)
        for name, make in (("admit", admit), ("move", move)):
            run_once(rocks, folder, events.schema, make, str(tmp_path / name), str(tmp_path / f"{name}-kept"))
    got = {r.event_id: (r.admitted, r.retry_after) for r in rocks.read.parquet(str(tmp_path / "admit")).collect()}
    batch = admission.admitted(events, "kind", limit=2, seconds=3_600).collect()
    assert got == {r.event_id: (r.admitted, r.retry_after or 0) for r in batch} and len(got) == events.count()
    got = {r.event_id: (r.before, r.status, r.outcome) for r in rocks.read.parquet(str(tmp_path / "move")).collect()}
    batch = jobs.job_states(events, "job", "action", "version", seconds=5 * 86_400).collect()
    assert got == {r.event_id: (r.before, r.status, "legal" if r.legal else "illegal") for r in batch}


def test_late_and_illegal_events_are_told_apart(rocks, tmp_path):
    folder, schema = str(tmp_path / "in"), "event_id long, ts timestamp, job string, action string, version string"
    parts = [[(1, 0, "submit"), (2, 100, "start")], [(3, 50, "finish"), (4, 120, "submit"), (5, 130, "finish")]]
    for n, part in enumerate(parts):
        rows = [(i, START + datetime.timedelta(seconds=s), "j", a, "1") for i, s, a in part]
        rocks.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        run_once(rocks, folder, schema, lambda s: state.job_outcomes(s, "job", "action", "version", 3_600, late="1 hour"), str(tmp_path / "out"), str(tmp_path / "kept"))
    got = {r.event_id: (r.status, r.outcome) for r in rocks.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: ("queued", "legal"), 2: ("running", "legal"), 3: ("running", "late"), 4: ("running", "illegal"), 5: ("done", "legal")}
