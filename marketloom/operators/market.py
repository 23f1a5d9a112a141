"""Market statistics: currency gate, consensus outliers, representatives, scores and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions import scalars

OUTLIER_RATIO = 3.0
CONFIRMING = ["CONFIRMED", "PROBABLE"]


def accepted(offers: DataFrame) -> DataFrame:
    """Offers whose identity is trusted or not judged, and whose price, if they have one, is in the home currency."""
    trusted = F.col("confidence").isNull() | F.col("confidence").isin(CONFIRMING)
    return offers.filter(trusted & (F.col("price").isNull() | (scalars.currency_code(F.col("currency")) == "UAH")))


def own_prices(missions: DataFrame) -> DataFrame:
    """One row per article, however often it is listed: its own price, null if missing or not above 0."""
    return missions.groupBy("article").agg(F.max(F.when(F.col("own_price") > 0, F.col("own_price"))).alias("own_price"))


def flag_outliers(offers: DataFrame, missions: DataFrame, ratio: float = OUTLIER_RATIO, least: int = 2) -> DataFrame:
    """Adds own_price, reference (median of the product's other prices and its own price) and suspicious (the price is
    more than ratio times off a reference of least prices or more). Offers without price have no reference.

    Prices and own price are ranked together in one shuffle by product. Leaving one of m sorted values out, the median is
    taken from the values at the three places from m/2 on, moved by one for those not above them; nothing is gathered."""
    own = own_prices(missions)
    priced = offers.join(own, "article", "left").withColumn("_own", F.lit(False))
    extra = own.filter("own_price is not null").select("article", "own_price", F.col("own_price").alias("price"), F.lit(True).alias("_own"))
    rows = priced.unionByName(extra, allowMissingColumns=True)
    # One order for all windows, so a task sorts once.
    by = Window.partitionBy("article").orderBy(F.col("price").asc_nulls_last())
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    m, r = F.count("price").over(whole), F.row_number().over(by)
    ranked = rows.withColumns({"_m": m, "_r": r})
    middle = {f"_v{i}": F.max(F.when(F.col("_r") == F.floor(F.col("_m") / 2) + i, F.col("price"))).over(whole) for i in range(3)}
    above = lambda i: F.floor(F.col("_m") / 2) + i < F.col("_r")
    pick = lambda i: F.when(above(i), F.col(f"_v{i}")).otherwise(F.col(f"_v{i + 1}"))
    reference = F.when((F.col("_m") >= 2) & F.col("price").isNotNull(), (pick(0) + F.when(F.col("_m") % 2 == 1, pick(1)).otherwise(pick(0))) / 2)
    off = F.greatest(F.col("price") / reference, reference / F.col("price"))
    suspicious = F.coalesce((F.col("_m") - 1 >= least) & (reference > 0) & (off > ratio), F.lit(False))
    flagged = ranked.withColumns(middle).withColumn("reference", reference).withColumn("suspicious", suspicious)
    return flagged.filter(~F.col("_own")).drop("_own", "_m", "_r", "_v0", "_v1", "_v2")


def representatives(offers: DataFrame) -> DataFrame:
    """The median price and the number of offers of each independent source of a product."""
    web = F.col("source") == "web_shops"
    named = F.coalesce(*[F.lower(F.nullif(F.trim(F.col(c)), F.lit(""))) for c in ("domain", "url") if c in offers.columns], F.lit("web"))
    return (
        offers.filter("price is not null").withColumn("kind", F.when(web, "web").otherwise("marketplace"))
        .withColumn("name", F.when(web, named).otherwise(F.col("source")))
        .groupBy("article", "kind", "name")
        .agg(F.median("price").alias("price"), F.count(F.lit(1)).alias("offers"))
    )


def price_score(own: Column, median: Column) -> Column:
    """100 from 15 % below the market on, 0 from 20 % above it on, 50 at the market, linear between; half-even. 0 where
    a price is missing."""
    delta = (own - median) / median * 100
    score = F.bround(
        F.when(delta <= -15, 100.0).when(delta >= 20, 0.0).when(delta <= 0, 50 + (-delta / 15) * 50).otherwise(50 - (delta / 20) * 50), 0
    ).cast("int")
    return F.coalesce(score, F.lit(0))


def verdict(score: Column) -> Column:
    return F.when(score >= 85, "🔥").when(score >= 65, "🟢").when(score >= 40, "🟡").otherwise("🔴")


def assess(offers: DataFrame, missions: DataFrame, red: float = 10.0, tolerance: float = 1.0) -> DataFrame:
    """One row per mission: market statistics over its sources' representatives, score, verdict with its reason,
    reserve to the market and confidence. red: percent above the market from which a verdict is red; tolerance: how far
    off a price still counts as the same."""
    flagged = flag_outliers(accepted(offers), missions).filter("price is not null")
    market = representatives(flagged.filter(~F.col("suspicious"))).groupBy("article").agg(
        F.min("price").alias("market_min"), F.median("price").alias("market_median"), F.avg("price").alias("market_avg"),
        F.max("price").alias("market_max"), F.count(F.lit(1)).alias("sources"),
    )
    counts = flagged.groupBy("article").agg(
        F.count_if(~F.col("suspicious")).alias("valid"), F.count_if("suspicious").alias("suspicious"),
        F.count_if(~F.col("suspicious") & (F.abs(F.col("price") - F.col("own_price")) <= tolerance)).alias("same_price"),
        F.count_if(~F.col("suspicious") & (F.col("confidence") == "CONFIRMED")).alias("confirmed"),
        F.count_if(~F.col("suspicious") & (F.col("confidence") == "PROBABLE")).alias("probable"),
    )
    own = F.when(F.col("own_price") > 0, F.col("own_price"))
    median = F.col("market_median")
    delta = (own - median) / median * 100
    sources, base = F.coalesce("sources", F.lit(0)), verdict(F.col("score"))
    over = F.coalesce((sources >= 2) & (delta >= red), F.lit(False))
    rules = [
        ((sources == 0) & (F.coalesce("suspicious", F.lit(0)) > 0), "⚠️", F.lit("NO_VALID_OFFERS_SUSPICIOUS_ONLY")),
        (sources == 0, "⚪", F.lit("NO_VALID_MARKET_OFFERS")),
        (own.isNull(), "🟡", F.lit("OWN_PRICE_MISSING")),
        (over, "🔴", F.format_string("OWN_PRICE_%.1f%%_ABOVE_MARKET", delta)),
        ((sources == 1) & (base == "🔥"), "🟡", F.lit("ONLY_ONE_INDEPENDENT_SOURCE")),
        ((F.col("confirmed") == 0) & base.isin("🔥", "🟢"), "🟡", F.lit("NO_CONFIRMED_IDENTITY")),
    ]
    guarded, reason = base, F.concat(F.lit("BASE_PRICE_SCORE_"), F.col("score").cast("string"))
    for condition, sign, why in reversed(rules):
        guarded, reason = F.when(condition, F.lit(sign)).otherwise(guarded), F.when(condition, why).otherwise(reason)
    reserve = scalars.rounded(median - own, 2)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        missions.join(market, "article", "left").join(counts, "article", "left")
        .withColumn("score", F.when(over, F.least(price_score(own, median), F.lit(39))).otherwise(price_score(own, median)))
        .select(
            "article", F.col("own_price"), sources.alias("sources"), "market_min", "market_median", scalars.rounded(F.col("market_avg"), 2).alias("market_avg"), "market_max",
            zero("valid"), zero("suspicious"), zero("same_price"), zero("confirmed"), zero("probable"), "score", guarded.alias("verdict"), reason.alias("reason"),
            reserve.alias("reserve_uah"), scalars.rounded(reserve / median * 100, 2).alias("reserve_pct"),
            F.when((sources >= 4) & (F.col("confirmed") > 0), "Висока").when(sources >= 2, "Середня").when(sources == 1, "Низька").otherwise("Немає даних").alias("confidence"),
        )
    )


def best_offers(offers: DataFrame, keys: list, order: list) -> DataFrame:
    """The best row of each key; order breaks ties."""
    return offers.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
