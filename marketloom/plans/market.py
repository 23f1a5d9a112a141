"""Queries on offers and prices, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.functions import scalars
from marketloom.operators import market
from marketloom.sources.tables import OFFER_KEY, missions, offers, table

OFFERS_SQL = """
offers AS (
  SELECT l_orderkey, l_linenumber, l_partkey AS article, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate,
         CASE WHEN l_returnflag = 'N' THEN r_name ELSE 'web_shops' END AS source,
         CASE WHEN l_returnflag = 'N' THEN NULL ELSE lower(s_name) END AS domain,
         l_extendedprice / l_quantity AS price,
         CASE WHEN l_orderkey % 17 = 0 THEN 'USD' WHEN l_linestatus = 'F' THEN '₴' ELSE 'UAH' END AS currency,
         1 - l_discount AS match,
         CASE WHEN l_quantity <= 20 THEN 'CONFIRMED' WHEN l_quantity <= 35 THEN 'PROBABLE' WHEN l_quantity <= 43 THEN 'AMBIGUOUS' ELSE 'CONFLICT' END AS confidence
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), accepted AS (SELECT * FROM offers WHERE confidence IN ('CONFIRMED', 'PROBABLE') AND currency <> 'USD')"""

FLAGGED_SQL = OFFERS_SQL + """, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY article ORDER BY price) AS n FROM accepted
), refs AS (
  SELECT a.article, a.n, median(b.price) AS reference, count(*) AS peers
  FROM numbered a JOIN (SELECT article, n, price FROM numbered UNION ALL SELECT p_partkey, -1, p_retailprice FROM part) b
    ON a.article = b.article AND a.n <> b.n GROUP BY 1, 2
), flagged AS (
  SELECT x.*, p_retailprice AS own_price, reference,
         peers >= 2 AND reference > 0 AND greatest(price / reference, reference / price) > 3.0 AS suspicious
  FROM numbered x JOIN refs USING (article, n) JOIN part ON p_partkey = x.article
), reps AS (
  SELECT article, CASE WHEN source = 'web_shops' THEN 'web' ELSE 'marketplace' END AS kind,
         CASE WHEN source = 'web_shops' THEN coalesce(domain, 'web') ELSE source END AS name, median(price) AS price, count(*) AS offers
  FROM flagged WHERE NOT suspicious GROUP BY 1, 2, 3
)"""

ASSESS_SQL = FLAGGED_SQL + """, market AS (
  SELECT article, min(price) AS market_min, median(price) AS market_median, avg(price) AS market_avg, max(price) AS market_max, count(*) AS sources FROM reps GROUP BY 1
), counts AS (
  SELECT article, count(*) FILTER (NOT suspicious) AS valid, count(*) FILTER (suspicious) AS suspicious,
         count(*) FILTER (NOT suspicious AND abs(price - own_price) <= 1) AS same_price,
         count(*) FILTER (NOT suspicious AND confidence = 'CONFIRMED') AS confirmed FROM flagged GROUP BY 1
), based AS (
  SELECT p_partkey AS article, p_retailprice AS own_price, coalesce(sources, 0) AS sources, market_min, market_median, market_avg, market_max,
         coalesce(valid, 0) AS valid, coalesce(c.suspicious, 0) AS suspicious, coalesce(same_price, 0) AS same_price, confirmed,
         (p_retailprice - market_median) / market_median * 100 AS delta
  FROM part LEFT JOIN market m ON m.article = p_partkey LEFT JOIN counts c ON c.article = p_partkey
), scored AS (
  SELECT *, CASE WHEN market_median IS NULL THEN 0 ELSE CAST(round_even(CASE WHEN delta <= -15 THEN 100.0 WHEN delta >= 20 THEN 0.0 WHEN delta <= 0 THEN 50 + (-delta / 15) * 50 ELSE 50 - (delta / 20) * 50 END, 0) AS INTEGER) END AS raw FROM based
), guarded AS (
  SELECT *, CASE WHEN sources >= 2 AND delta >= 10 THEN least(raw, 39) ELSE raw END AS score FROM scored
), assessed AS (
  SELECT *, CASE WHEN sources = 0 AND suspicious > 0 THEN '⚠️' WHEN sources = 0 THEN '⚪' WHEN sources >= 2 AND delta >= 10 THEN '🔴'
         WHEN sources = 1 AND score >= 85 THEN '🟡' WHEN confirmed = 0 AND score >= 65 THEN '🟡'
         WHEN score >= 85 THEN '🔥' WHEN score >= 65 THEN '🟢' WHEN score >= 40 THEN '🟡' ELSE '🔴' END AS verdict,
         CASE WHEN sources >= 4 AND confirmed > 0 THEN 'Висока' WHEN sources >= 2 THEN 'Середня' WHEN sources = 1 THEN 'Низька' ELSE 'Немає даних' END AS confidence
  FROM guarded
)"""


def _rounded(df, *columns):
    """To thousandths, by the same arithmetic as the SQL."""
    return df.withColumns({c: F.floor(F.col(c) * 1000 + 0.5) / 1000 for c in columns})


def price_summary(spark, d):
    rows = market.assess(offers(spark, d), missions(spark, d)).drop("confirmed", "probable", "reason", "reserve_uah", "reserve_pct")
    return _rounded(rows, "market_min", "market_median", "market_max")


def price_outliers(spark, d):
    flagged = market.flag_outliers(market.accepted(offers(spark, d)), missions(spark, d))
    return _rounded(flagged.select(*OFFER_KEY, "price", "reference", "suspicious"), "price", "reference")


def balanced_representatives(spark, d):
    flagged = market.flag_outliers(market.accepted(offers(spark, d)), missions(spark, d))
    return _rounded(market.representatives(flagged.filter(~F.col("suspicious"))), "price")


def keep_best_dedup(spark, d):
    """One offer per product, source, domain and whole price: the best match, the key columns break ties."""
    rows = market.accepted(offers(spark, d)).withColumn("whole", F.floor("price").cast("long"))
    order = [F.desc("match"), *OFFER_KEY]
    return market.best_offers(rows, ["article", "source", "domain", "whole"], order).select(*OFFER_KEY, "source", "domain", "whole")


def price_card_counts(spark, d):
    rows = market.accepted(offers(spark, d)).withColumn("cents", F.round(F.col("price") * 100).cast("long"))
    return rows.groupBy("article", "source", "cents").agg(F.count(F.lit(1)).alias("cards"))


def market_summary(spark, d):
    """Per product, each source's distinct prices in rising order with their numbers, sources joined in order."""
    cards = market.accepted(offers(spark, d)).withColumn("whole", F.floor("price").cast("long")).groupBy("article", "source", "whole").count()
    text = F.concat(F.col("whole").cast("string"), F.lit(" грн"), F.when(F.col("count") > 1, F.concat(F.lit(" ×"), F.col("count").cast("string"))).otherwise(""))
    by_source = cards.withColumn("text", text).groupBy("article", "source").agg(F.array_sort(F.collect_list(F.struct("whole", "text"))).alias("x"))
    line = F.concat("source", F.lit(": "), F.array_join(F.transform("x", lambda v: v["text"]), ", "))
    joined = by_source.groupBy("article").agg(F.array_sort(F.collect_list(F.struct("source", line.alias("line")))).alias("x"))
    return joined.select("article", F.array_join(F.transform("x", lambda v: v["line"]), " | ").alias("summary"))


def coverage_by_source(spark, d):
    """Products with a priced offer per planned source, and their share of all products."""
    planned = table(spark, d, "region").select(F.col("r_name").alias("source")).union(spark.createDataFrame([("web_shops",)], "source string"))
    total = missions(spark, d).agg(F.count(F.lit(1)).alias("total"))
    seen = market.accepted(offers(spark, d)).groupBy("source").agg(F.countDistinct("article").alias("products"))
    return planned.join(seen, "source", "left").join(F.broadcast(total)).select(  # total is one row
        "source", F.coalesce("products", F.lit(0)).alias("products"), scalars.rounded(F.coalesce("products", F.lit(0)) * 100.0 / F.col("total"), 1).alias("percent")
    )


def _sources_of(spark, d):
    found = market.accepted(offers(spark, d)).groupBy("article").agg(F.countDistinct("source").alias("n"))
    return missions(spark, d).select("article").join(found, "article", "left").select("article", F.coalesce("n", F.lit(0)).alias("n"))


def source_count_histogram(spark, d):
    """How many products have exactly n sources, for every n from 0 to the number of planned sources."""
    k = spark.range(0, 7).select(F.col("id").alias("n"))
    counted = _sources_of(spark, d).groupBy("n").agg(F.count(F.lit(1)).alias("products"))
    return k.join(counted, "n", "left").select("n", F.coalesce("products", F.lit(0)).alias("products"))


def all_sources(spark, d):
    return _sources_of(spark, d).agg(F.count_if(F.col("n") == 6).alias("products"), scalars.rounded(F.count_if(F.col("n") == 6) * 100.0 / F.count(F.lit(1)), 1).alias("percent"))


def market_pivot(spark, d):
    """One row per product with its number of distinct whole prices at each marketplace."""
    rows = market.accepted(offers(spark, d)).withColumn("whole", F.floor("price"))
    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    wide = rows.groupBy("article").pivot("source", names).agg(F.countDistinct("whole"))
    return wide.select("article", *[F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias(n.lower().replace(" ", "_")) for n in names])


def verdict_counts(spark, d):
    return market.assess(offers(spark, d), missions(spark, d)).groupBy("verdict").agg(F.count(F.lit(1)).alias("products"))


def verdict_sort(spark, d):
    """The report's order: verdict by urgency, then falling score, then article."""
    places = F.create_map(*[x for i, v in enumerate("🔥 🟢 🟡 ⚠️ 🔴 ⚪".split()) for x in (F.lit(v), F.lit(i))])
    rows = market.assess(offers(spark, d), missions(spark, d)).select("article", "verdict", "score", F.coalesce(F.element_at(places, F.col("verdict")), F.lit(99)).alias("place"))
    return rows.orderBy("place", F.desc_nulls_last("score"), "article")


def candidate_topn(spark, d):
    """The eight best offers of each product by match, cheaper first; the key columns break ties."""
    order = Window.partitionBy("article").orderBy(F.desc("match"), "price", *OFFER_KEY)
    return offers(spark, d).withColumn("rank", F.row_number().over(order)).filter("rank <= 8").select(*OFFER_KEY, "rank")


def per_host_cap(spark, d):
    """At most two offers of a domain for a product, then at most five for the product, in order of arrival."""
    rows = offers(spark, d).filter("domain is not null")
    arrival = [F.col(c) for c in ("l_shipdate", *[k for k in OFFER_KEY if k != "l_shipdate"])]
    two = rows.withColumn("a", F.row_number().over(Window.partitionBy("article", "domain").orderBy(*arrival))).filter("a <= 2")
    return two.withColumn("rank", F.row_number().over(Window.partitionBy("article").orderBy(*arrival))).filter("rank <= 5").select(*OFFER_KEY, "rank")


def first_nonempty_tier(spark, d):
    """The offers of each product's first tier of trust that has any."""
    tier = F.when(F.col("confidence") == "CONFIRMED", 1).when(F.col("confidence") == "PROBABLE", 2).otherwise(3)
    rows = offers(spark, d).withColumn("tier", tier)
    first = F.min("tier").over(Window.partitionBy("article"))
    return rows.withColumn("first", first).filter("tier = first").groupBy("article", "tier").agg(F.count(F.lit(1)).alias("offers"))


def provider_recovery(spark, d):
    """Marketplace offers of a product, and web shops' only where the marketplaces have fewer than ten."""
    n = F.count_if(F.col("source") != "web_shops").over(Window.partitionBy("article"))
    rows = offers(spark, d).withColumn("n", n).filter((F.col("source") != "web_shops") | (F.col("n") < 10))
    return rows.groupBy("article").agg(F.count(F.lit(1)).alias("offers"), F.count_if(F.col("source") == "web_shops").alias("recovered"))


def price_ratio_guard(spark, d):
    """Web-shop offers whose price is over three times the own price or under a third of it."""
    rows = offers(spark, d).filter("source = 'web_shops'").join(missions(spark, d).select("article", "own_price"), "article")
    ratio = F.greatest(F.col("price") / F.col("own_price"), F.col("own_price") / F.col("price"))
    return rows.groupBy("article").agg(F.count_if(ratio > 3).alias("guarded"), F.count_if(ratio <= 3).alias("kept"))


def scan_counters(spark, d):
    known = scalars.currency_code(F.col("currency")) == "UAH"
    return offers(spark, d).groupBy("source").agg(
        *[F.count_if(F.col("confidence") == c).alias(c.lower()) for c in ("CONFIRMED", "PROBABLE", "AMBIGUOUS", "CONFLICT")],
        F.count_if(~known).alias("other_currency"), F.count_if(known & F.col("confidence").isin(market.CONFIRMING)).alias("accepted"),
    )


def identity_keys(spark, d):
    return missions(spark, d).select("article", scalars.identity_key(F.col("article"), F.col("name"), F.col("brand")).alias("identity_key"))


def category_path(spark, d):
    """Each nation's path from its region, root first."""
    t = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.select("n_nationkey", F.concat_ws(" / ", "r_name", "n_name").alias("path"))


KEY = "l_orderkey, l_linenumber, article, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate"
ARRIVAL = "l_shipdate, l_orderkey, l_linenumber, article, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax"
QUERIES = {
    price_summary: f"WITH {ASSESS_SQL} SELECT article, own_price, sources, floor(market_min * 1000 + 0.5) / 1000 AS market_min, floor(market_median * 1000 + 0.5) / 1000 AS market_median, round(market_avg, 2) AS market_avg, floor(market_max * 1000 + 0.5) / 1000 AS market_max, valid, suspicious, same_price, score, verdict, confidence FROM assessed",
    price_outliers: f"WITH {FLAGGED_SQL} SELECT {KEY}, floor(price * 1000 + 0.5) / 1000 AS price, floor(reference * 1000 + 0.5) / 1000 AS reference, suspicious FROM flagged",
    balanced_representatives: f"WITH {FLAGGED_SQL} SELECT article, kind, name, floor(price * 1000 + 0.5) / 1000 AS price, offers FROM reps",
    keep_best_dedup: f"WITH {OFFERS_SQL} SELECT {KEY}, source, domain, CAST(floor(price) AS BIGINT) AS whole FROM accepted QUALIFY row_number() OVER (PARTITION BY article, source, domain, floor(price) ORDER BY match DESC, {KEY}) = 1",
    price_card_counts: f"WITH {OFFERS_SQL} SELECT article, source, CAST(round(price * 100) AS BIGINT) AS cents, count(*) AS cards FROM accepted GROUP BY ALL",
    market_summary: f"WITH {OFFERS_SQL}, cards AS (SELECT article, source, CAST(floor(price) AS BIGINT) AS whole, count(*) AS n FROM accepted GROUP BY ALL), lines AS (SELECT article, source, source || ': ' || string_agg(whole || ' грн' || CASE WHEN n > 1 THEN ' ×' || n ELSE '' END, ', ' ORDER BY whole) AS line FROM cards GROUP BY article, source) SELECT article, string_agg(line, ' | ' ORDER BY source) AS summary FROM lines GROUP BY article",
    coverage_by_source: f"WITH {OFFERS_SQL}, planned AS (SELECT r_name AS source FROM region UNION ALL SELECT 'web_shops'), seen AS (SELECT source, count(DISTINCT article) AS n FROM accepted GROUP BY 1) SELECT source, coalesce(n, 0) AS products, round(coalesce(n, 0) * 100.0 / (SELECT count(*) FROM part), 1)::DOUBLE AS percent FROM planned LEFT JOIN seen USING (source)",
    source_count_histogram: f"WITH {OFFERS_SQL}, s AS (SELECT p_partkey, count(DISTINCT source) AS n FROM part LEFT JOIN accepted ON article = p_partkey GROUP BY 1) SELECT k.n::BIGINT AS n, count(p_partkey) AS products FROM range(0, 7) k(n) LEFT JOIN s ON s.n = k.n GROUP BY 1",
    all_sources: f"WITH {OFFERS_SQL}, s AS (SELECT p_partkey, count(DISTINCT source) AS n FROM part LEFT JOIN accepted ON article = p_partkey GROUP BY 1) SELECT count(*) FILTER (n = 6) AS products, round(count(*) FILTER (n = 6) * 100.0 / count(*), 1)::DOUBLE AS percent FROM s",
    market_pivot: "WITH " + OFFERS_SQL + " SELECT article, " + ", ".join(f"count(DISTINCT floor(price)) FILTER (source = '{n}') AS {n.lower().replace(' ', '_')}" for n in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + " FROM accepted GROUP BY article",
    verdict_counts: f"WITH {ASSESS_SQL} SELECT verdict, count(*) AS products FROM assessed GROUP BY 1",
    verdict_sort: f"WITH {ASSESS_SQL} SELECT article, verdict, score, CASE verdict WHEN '🔥' THEN 0 WHEN '🟢' THEN 1 WHEN '🟡' THEN 2 WHEN '⚠️' THEN 3 WHEN '🔴' THEN 4 WHEN '⚪' THEN 5 ELSE 99 END AS place FROM assessed ORDER BY place, score DESC NULLS LAST, article",
    candidate_topn: f"WITH {OFFERS_SQL} SELECT {KEY}, CAST(row_number() OVER (PARTITION BY article ORDER BY match DESC, price, {KEY}) AS INTEGER) AS rank FROM offers QUALIFY rank <= 8",
    per_host_cap: f"WITH {OFFERS_SQL}, two AS (SELECT * FROM offers WHERE domain IS NOT NULL QUALIFY row_number() OVER (PARTITION BY article, domain ORDER BY {ARRIVAL}) <= 2) SELECT {KEY}, CAST(row_number() OVER (PARTITION BY article ORDER BY {ARRIVAL}) AS INTEGER) AS rank FROM two QUALIFY rank <= 5",
    first_nonempty_tier: f"WITH {OFFERS_SQL}, t AS (SELECT *, CASE confidence WHEN 'CONFIRMED' THEN 1 WHEN 'PROBABLE' THEN 2 ELSE 3 END AS tier FROM offers), m AS (SELECT *, min(tier) OVER (PARTITION BY article) AS first FROM t) SELECT article, tier, count(*) AS offers FROM m WHERE tier = first GROUP BY 1, 2",
    provider_recovery: f"WITH {OFFERS_SQL}, m AS (SELECT *, count(*) FILTER (source <> 'web_shops') OVER (PARTITION BY article) AS n FROM offers) SELECT article, count(*) AS offers, count(*) FILTER (source = 'web_shops') AS recovered FROM m WHERE source <> 'web_shops' OR n < 10 GROUP BY 1",
    price_ratio_guard: f"WITH {OFFERS_SQL} SELECT article, count(*) FILTER (greatest(price / p_retailprice, p_retailprice / price) > 3) AS guarded, count(*) FILTER (greatest(price / p_retailprice, p_retailprice / price) <= 3) AS kept FROM offers JOIN part ON p_partkey = article WHERE source = 'web_shops' GROUP BY 1",
    scan_counters: f"WITH {OFFERS_SQL} SELECT source, count(*) FILTER (confidence = 'CONFIRMED') AS confirmed, count(*) FILTER (confidence = 'PROBABLE') AS probable, count(*) FILTER (confidence = 'AMBIGUOUS') AS ambiguous, count(*) FILTER (confidence = 'CONFLICT') AS conflict, count(*) FILTER (currency = 'USD') AS other_currency, count(*) FILTER (currency <> 'USD' AND confidence IN ('CONFIRMED', 'PROBABLE')) AS accepted FROM offers GROUP BY 1",
    identity_keys: "SELECT p_partkey AS article, sha256('=' || p_partkey || chr(31) || '=' || lower(trim(p_name)) || chr(31) || '=' || lower(trim(p_brand))) AS identity_key FROM part",
    category_path: "SELECT n_nationkey, r_name || ' / ' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey",
}
