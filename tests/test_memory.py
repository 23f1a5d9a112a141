"""Identity memory: keys, replays of puts and deletes, versions, ages, and what is unknown against what is nothing."""

import datetime

from pyspark.sql import functions as F

from marketloom.operators import memory

DAY = datetime.timedelta(days=1)
START = datetime.datetime(2024, 1, 1)
LOG = "identity_key string, source string, url string, version string, confidence string, ts timestamp, seq long, deleted boolean"
ASKED = "request long, identity_key string, source string, as_of timestamp, version string"


def test_keys_and_versions_don_t_depend_on_script_case_or_spaces(spark):
    rows = [(1, "EPСС2614", "Hubber", "Ортез Example EPСС2614", "Example", "EPСС2614"), (2, "EPCC2614", " hubber ", "ортез  example EPCC2614", "EXAMPLE", "EPCC2614"), (3, "EPCC2614", None, "Ортез Example EPCC2614", "Example", "EPCC2614"),
            (4, "EPCC2614", None, "Інший товар", "Example", None), (5, "EPCC2614", "Hubber", "Новий товар", "Example", None), (6, None, None, None, None, None)]
    got = {r.i: (r.identity_key, r.identity_version) for r in memory.with_identity(spark.createDataFrame(rows, "i int, article string, supplier string, name string, brand string, model string")).collect()}
    assert got[1] == got[2] and got[3][0] not in (got[1][0], got[4][0]) and got[3][1] == got[1][1]
    assert got[5][0] == got[1][0] and got[5][1] != got[1][1] and len({len(v[1]) for v in got.values()} | {24}) == 1


def test_recall_as_of_any_time(spark):
    log = [
        ("k", "prom", "u1", "v1", "CONFIRMED", START, 1, False), ("k", "prom", "u2", "v1", "PROBABLE", START + 5 * DAY, 2, False), ("k", "prom", "u1", "v1", "CONFIRMED", START + 10 * DAY, 3, True),
        ("k", "prom", "u1", "v2", "PROBABLE", START + 20 * DAY, 4, False), ("k", "prom", "u3", "v1", "CONFIRMED", START + 20 * DAY, 5, False), ("k", "prom", "u3", "v1", "CONFIRMED", START + 20 * DAY, 6, True), ("k", "hotline", "u9", "v1", "CONFIRMED", START, 7, False), ("other", "prom", "u8", "v1", "CONFIRMED", START, 8, False),
    ]
    asked = [(1, 0, None), (2, 6, None), (3, 10, None), (4, 21, None), (5, 21, "v1"), (6, 36, None), (7, 35, "v1"), (8, -1, None)]
    frame = spark.createDataFrame(log + log[:2], LOG)
    got: dict = {}
    for r in memory.recalled(frame, spark.createDataFrame([(i, "k", "prom", START + d * DAY, v) for i, d, v in asked], ASKED)).orderBy("request", "rank").collect():
        got.setdefault(r.request, []).append(r.url)
    assert got == {1: ["u1"], 2: ["u1", "u2"], 3: ["u2"], 4: ["u1", "u2"], 5: ["u2"], 6: ["u1"], 7: ["u2"]}
    left = memory.current(frame, ["identity_key", "source", "url"]).collect()
    assert {(r.source, r.url, r.version) for r in left if r.identity_key == "k"} == {("prom", "u1", "v2"), ("prom", "u2", "v1"), ("hotline", "u9", "v1")}
    assert memory.recalled(frame.filter("seq < 0"), spark.createDataFrame([(1, "k", "prom", START, None)], ASKED)).count() == 0


def test_nothing_is_told_from_unknown(spark):
    log = spark.createDataFrame([("a", START, 1, ["prom"]), ("a", START + DAY, 2, []), ("b", START, 3, ["hotline"])], "key string, ts timestamp, seq long, sources array<string>")
    asked = spark.createDataFrame([(1, "a", START), (2, "a", START + 2 * DAY), (3, "b", START + 3 * DAY), (4, "c", START), (5, "b", START + 2.9 * DAY)], "request long, key string, as_of timestamp")
    got = {r.request: r.sources for r in memory.latest_value(log, asked, "sources", 3).collect()}
    assert got == {1: ["prom"], 2: [], 3: None, 4: None, 5: ["hotline"]}


def test_only_sure_and_priced_identities_are_saved(spark):
    rows = [(1, "PASS", "CONFIRMED", 10.0, [], False), (2, "PASS", "CONFIRMED", None, [], True), (3, "PASS", "PROBABLE", 10.0, [], True), (4, "PASS", "PROBABLE", 10.0, [], False), (5, "CONFLICT", "CONFLICT", 10.0, ["x"], True), (6, "PASS", "PROBABLE", 1.0, ["x"], True)]
    frame = spark.createDataFrame(rows, "i int, verdict string, identity string, price double, conflicts array<string>, strong boolean")
    assert [r.i for r in memory.worth_saving(frame).collect()] == [1]
    assert sorted(r.i for r in memory.worth_saving(frame, probable=True).collect()) == [1, 3]
    flags = memory.refreshed(spark.createDataFrame([(True, 2), (False, 2), (False, 0)], "found boolean, urls int"), F.col("found"), F.col("urls")).collect()
    assert [(r.repair_required, r.discovery_gap) for r in flags] == [(False, False), (True, False), (False, True)]
