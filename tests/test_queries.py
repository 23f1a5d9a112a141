"""Every registered market query against its SQL, and the awkward rows that the test tables lack."""

import glob
import os

import duckdb
import pytest

from marketloom.functions import scalars
from marketloom.operators import market, matching
from marketloom.plans import registry
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if value is None or value != value:
        return ""
    return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def _rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(_plain(v) for v in r) for r in frame[columns].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_is_its_sql(spark, tables, name):
    assert _rows(registry.queries()[name](spark, SMALL).toPandas()) == _rows(tables.execute(registry.oracle_sql()[name]).df())


OFFER = "article string, source string, domain string, url string, price double, currency string, confidence string"


def _assessed(spark, rows, own):
    offers = spark.createDataFrame(rows, OFFER)
    return market.assess(offers, spark.createDataFrame(own, "article string, own_price double")).orderBy("article").collect()


def test_missing_own_prices_and_null_values(spark):
    rows = [(a, s, None, None, 100.0, "UAH", "CONFIRMED") for a in "ABC" for s in ("x", "y")]
    rows += [("A", "z", None, None, None, None, None), ("D", "x", None, None, 50.0, "грн.", None), ("E", "x", None, None, 50.0, "USD", "CONFIRMED")]
    got = _assessed(spark, rows, [("A", None), ("B", 0.0), ("C", 120.0), ("D", 50.0), ("E", 50.0)])
    assert [(r.score, r.verdict, r.reason) for r in got] == [
        (0, "🟡", "OWN_PRICE_MISSING"), (0, "🟡", "OWN_PRICE_MISSING"), (0, "🔴", "OWN_PRICE_20.0%_ABOVE_MARKET"),
        (50, "🟡", "BASE_PRICE_SCORE_50"), (0, "⚪", "NO_VALID_MARKET_OFFERS"),
    ]
    assert (got[2].reserve_uah, got[2].reserve_pct) == (-20.0, -20.0)


def test_repeated_missions_and_offers_without_mission(spark):
    offers = spark.createDataFrame([("A", "x", None, None, p, "UAH", "CONFIRMED") for p in (10.0, 11.0, 40.0)] + [("Z", "x", None, None, 5.0, "UAH", "CONFIRMED")], OFFER)
    missions = spark.createDataFrame([("A", 10.5), ("A", 10.5)], "article string, own_price double")
    flagged = market.flag_outliers(offers, missions).orderBy("price").collect()
    assert [(r.article, r.price, r.suspicious) for r in flagged] == [("Z", 5.0, False), ("A", 10.0, False), ("A", 11.0, False), ("A", 40.0, True)]
    assert [r.reference for r in flagged] == [None, 11.0, 10.5, 10.5]
    assert [r.valid for r in market.assess(offers, missions).collect()] == [2, 2]


def test_web_shops_without_domain_are_told_apart_by_url(spark):
    rows = [("A", "web_shops", None, u, 10.0, "UAH", "CONFIRMED") for u in ("http://a", "http://b", None)]
    assert market.representatives(spark.createDataFrame(rows, OFFER)).count() == 3


def test_urls_keep_selectors_and_keys_tell_missing_parts(spark):
    row = spark.sql("""SELECT 'HTTPS://Shop.UA/p/?ref=1&utm_id=3&srsltid=x&b=2&VED=1#f' AS url, 'not a url' AS odd""")
    got = row.select(scalars.canonical_url(F.col("url")), scalars.canonical_url(F.col("odd"))).first()
    assert tuple(got) == ("https://shop.ua/p/?ref=1&b=2", "not a url")
    keys = spark.sql("SELECT 'a' AS x, CAST(NULL AS STRING) AS y").select(scalars.identity_key(F.col("x"), F.col("y")), scalars.identity_key(F.col("y"), F.col("x"))).first()
    assert keys[0] != keys[1]
    stock = spark.sql("SELECT explode(array('Available', 'Недоступний', 'in-stock!', '', 'отсутствует', 'Out_of-Stock')) AS t").select(scalars.availability_state(F.col("t"))).collect()
    assert [r[0] for r in stock] == ["IN_STOCK", "OUT_OF_STOCK", "IN_STOCK", "UNKNOWN", "OUT_OF_STOCK", "OUT_OF_STOCK"]


def test_strong_identifier_passes_and_conflicts_come_first(spark):
    rows = [("drill", "Polax", "polax drill bz425m", "bz425m1"), ("drill bz425m1 green", "Polax", "polax bz-425m1", "bz425m1"), ("drill bz425m1", "Polax", "polax bz425m1 used", "bz425m1"), (None, None, None, None)]
    got = matching.validated(spark.createDataFrame(rows, "source string, brand string, title string, identifier string")).collect()
    assert [(r.identity, r.verdict) for r in got][1:3] == [("CONFIRMED", "PASS"), ("CONFLICT", "CONFLICT")]
    assert got[3].verdict in ("CONFLICT", "REJECT")
