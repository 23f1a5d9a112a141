"""Memory of identities as a log of puts and deletes, read as of any time: by key, version and age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions import folding

#: Days for which identities and searches, and hours for which pages, are believed.
IDENTITY_DAYS, SEARCH_DAYS, PAGE_HOURS = 30, 3, 24
#: URLs of an identity that are taken up again.
MOST = 24
# Confidences from the best on.
CONFIDENCES = ["CONFIRMED", "PROBABLE"]


def _text(c: str) -> Column:
    return folding.fold(F.col(c)).alias(c)


def with_identity(missions: DataFrame) -> DataFrame:
    """Adds identity_key and identity_version to missions (article, and supplier, name, brand, model as far as known). The key
    is the supplier's article; without a supplier the product's public fields tell equal articles apart. The version is that
    of the public fields, so what was known ends when they change. Texts count as folded: letters of either script, case
    and spaces don't matter."""
    fields = [c for c in ("article", "supplier", "name", "brand", "model")]
    known = missions.withColumns({f"_{c}": folding.fold(F.col(c).cast("string")) if c in missions.columns else F.lit("") for c in fields})
    packed = lambda *names: F.to_json(F.struct(*[F.col(f"_{c}").alias(c) for c in names]))
    own = F.when((F.col("_supplier") != "") & (F.col("_article") != ""), packed("article", "supplier")).otherwise(packed("article", "brand", "model", "name"))
    version = F.substring(F.sha2(packed("brand", "model", "name"), 256), 1, 24)
    return known.withColumns({"identity_key": F.sha2(own, 256), "identity_version": version}).drop(*[f"_{c}" for c in fields])


def worth_saving(validated: DataFrame, probable: bool = False) -> DataFrame:
    """Priced offers that pass with a CONFIRMED identity; if wanted also PROBABLE ones without conflicts whose match is strong.
    Needs verdict, identity, price, conflicts and strong."""
    sure = F.col("identity") == "CONFIRMED"
    likely = (F.col("identity") == "PROBABLE") & (F.size("conflicts") == 0) & F.col("strong") if probable else F.lit(False)
    return validated.filter((F.col("verdict") == "PASS") & (sure | likely) & F.col("price").isNotNull())


def current(log: DataFrame, keys: list[str], seconds: Column | None = None) -> DataFrame:
    """What a log (keys, ts, seq, deleted and more) leaves: each key's last row, unless it is a delete. Equal times go by seq."""
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("ts", "seq")).alias("_x"))
    return last.select(*keys, "_x.*").filter(~F.col("deleted"))


def recalled(log: DataFrame, requests: DataFrame, days: float = IDENTITY_DAYS, most: int = MOST) -> DataFrame:
    """The URLs known for each request (request, identity_key, source, as_of, version: null for any): the log's rows (identity_key,
    source, url, version, confidence, ts, seq, deleted) up to as_of, the last of each URL, if it is no delete, at most so
    many days old, and of that version. The best confidence and the newest come first; equal ones by URL.

    A request meets its own key's rows alone, and only one row for each URL goes on, so nothing is gathered."""
    asked = requests.select("request", "identity_key", "source", "as_of", F.col("version").alias("_version"))
    seen = log.join(asked, ["identity_key", "source"]).filter(F.col("ts") <= F.col("as_of"))
    last = seen.groupBy("request", "url", "as_of", "_version").agg(F.max_by(F.struct("confidence", "version", "ts", "deleted"), F.struct("ts", "seq")).alias("x"))
    fresh = last.select("request", "url", "as_of", "_version", "x.*").filter(~F.col("deleted") & (F.col("ts") >= F.col("as_of") - F.make_dt_interval(secs=F.lit(days * 86_400.0))))
    fresh = fresh.filter(F.col("_version").isNull() | (F.col("version") == F.col("_version")))
    trust = F.coalesce(*[F.when(F.col("confidence") == c, i) for i, c in enumerate(CONFIDENCES)], F.lit(len(CONFIDENCES)))
    order = Window.partitionBy("request").orderBy(trust, F.desc("ts"), "url")
    return fresh.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("request", "rank", "url", "confidence", "version", "ts")


def latest_value(log: DataFrame, requests: DataFrame, value: str, days: float) -> DataFrame:
    """Requests (request, key, as_of) with the last value of their key (log: key, ts, seq and the value) that is younger than so
    many days at as_of, else null. An empty array is a value: it says that there is nothing, where null says nothing."""
    seen = log.join(requests.select("request", "key", "as_of"), "key").filter(F.col("ts") <= F.col("as_of"))
    last = seen.groupBy("request", "as_of").agg(F.max_by(F.struct(F.col(value), "ts"), F.struct("ts", "seq")).alias("x"))
    young = last.filter(F.col("as_of") - F.col("x.ts") < F.make_dt_interval(secs=F.lit(days * 86_400.0))).select("request", F.col(f"x.{value}").alias(value))
    return requests.join(young, "request", "left")


def refreshed(requests: DataFrame, found: Column, urls: Column) -> DataFrame:
    """Adds, for a refresh that follows known URLs alone and found nothing, whether they need repair or none was known."""
    return requests.withColumns({"repair_required": ~found & (urls > 0), "discovery_gap": ~found & (urls == 0)})
