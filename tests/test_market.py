import pytest
from pyspark.sql import functions as F

from marketloom.functions import scalars
from marketloom.operators import market
from marketloom.plans import registry


def _offers(spark, rows):
    return spark.createDataFrame(rows, "article string, source string, domain string, price double, currency string, confidence string")


def _missions(spark, rows):
    return spark.createDataFrame(rows, "article string, own_price double")


def test_balanced_market_has_four_sources(spark):
    prices = [("prom", None, 90.0), ("prom", None, 110.0), ("epicentr", None, 120.0), ("web_shops", "shop-a", 80.0), ("web_shops", "shop-b", 100.0)]
    rows = _offers(spark, [("A", s, d, p, "UAH", "CONFIRMED") for s, d, p in prices])
    got = market.assess(rows, _missions(spark, [("A", 100.0)])).first()
    assert (got.sources, got.market_min, got.market_median, got.market_max, got.score) == (4, 80.0, 100.0, 120.0, 50)


@pytest.mark.parametrize("own, score", [(85.0, 100), (100.0, 50), (120.0, 0)])
def test_price_score(spark, own, score):
    assert spark.range(1).select(market.price_score(F.lit(own), F.lit(100.0))).first()[0] == score


def test_outlier_is_flagged_and_left_out(spark):
    rows = _offers(spark, [("A", s, None, p, "UAH", "CONFIRMED") for s, p in (("x", 100.0), ("y", 1000.0), ("z", 1100.0))])
    got = market.assess(rows, _missions(spark, [("A", 1000.0)])).first()
    assert (got.suspicious, got.market_min, got.market_max) == (1, 1000.0, 1100.0)


def test_no_offers_and_other_currencies(spark):
    rows = _offers(spark, [("A", "x", None, 10.0, "USD", "CONFIRMED"), ("A", "y", None, 10.0, "UAH", "CONFLICT")])
    got = market.assess(rows, _missions(spark, [("A", 10.0), ("B", None)])).orderBy("article").collect()
    assert [(r.sources, r.verdict, r.confidence) for r in got] == [(0, "⚪", "Немає даних")] * 2


def test_discount(spark):
    assert spark.range(1).select(scalars.discount_percent(F.lit(649.0), F.lit(445.0))).first()[0] == 31.43


def test_every_query_runs_and_names_match(spark):
    assert set(registry.oracle_sql()) <= set(registry.queries())
    for name in ("price_summary", "canonical_urls", "latest_state"):
        assert registry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
