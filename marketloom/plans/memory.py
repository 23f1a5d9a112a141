"""Queries on the memory of identities, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.operators import memory
from marketloom.sources.tables import table


def identity_log(spark, d):
    """Puts and deletes of URLs of identities, from events: an identity for each user, a source for each type."""
    n, value = F.col("event_id"), F.col("value")
    return table(spark, d, "events").select(
        F.col("user_id").alias("identity_key"), F.col("event_type").alias("source"), F.concat(F.lit("https://shop.ua/p"), (n % 7).cast("string")).alias("url"), F.floor(n / 5_000).cast("string").alias("version"),
        F.when(value > 100, "CONFIRMED").when(value > 30, "PROBABLE").otherwise("AMBIGUOUS").alias("confidence"), F.col("ts").cast("timestamp").alias("ts"), n.alias("seq"), (n % 10 == 0).alias("deleted"),
    )


def requests(spark, d):
    """A request for each user and type, at a time of its own; every third wants any version."""
    user = F.col("identity_key")
    as_of = F.lit("2024-01-12").cast("timestamp") + F.make_dt_interval(hours=(user % 300).cast("int"))
    rows = identity_log(spark, d).select("identity_key", "source").distinct()
    return rows.select(F.concat_ws(":", user.cast("string"), "source").alias("request"), "identity_key", "source", as_of.alias("as_of"), F.when(user % 3 > 0, (user % 2).cast("string")).alias("version"))


def mission_identities(spark, d):
    """Keys and versions of products; even ones have a supplier, and the brand is written with letters of two scripts."""
    n = F.col("p_partkey")
    rows = table(spark, d, "part").select(
        n.alias("id"), F.concat(F.lit("EPСС"), n.cast("string")).alias("article"), F.when(n % 2 == 0, "Hubber ").alias("supplier"), F.upper("p_name").alias("name"), F.lit("NІKE").alias("brand"), F.col("p_type").alias("model"), F.lit(1).alias("_key")
    )
    return memory.with_identity(rows).select("id", "identity_key", "identity_version")


def identity_recall(spark, d):
    """The URLs known for each request as of its time: not deleted, at most five days old, of the version asked for."""
    return memory.recalled(identity_log(spark, d), requests(spark, d), days=5, most=3).select("request", F.col("rank").cast("long").alias("rank"), "url", "confidence", "version")


def current_identities(spark, d):
    """What the log leaves of each identity: the last row of each URL that wasn't deleted."""
    rows = memory.current(identity_log(spark, d), ["identity_key", "source", "url"])
    return rows.select("identity_key", "source", "url", "confidence", F.col("seq").alias("event_id"))


def discovery_memory(spark, d):
    """What a user's last full search found, if it is younger than ten days: unknown, nothing or sources; and what a refresh
    by known URLs alone comes to."""
    n = F.col("event_id")
    log = table(spark, d, "events").filter("event_type in ('view', 'purchase')").select(
        F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), n.alias("seq"),
        F.when(n % 3 == 0, F.array().cast("array<string>")).when(n % 3 == 1, F.array(F.lit("prom"))).otherwise(F.array(F.lit("hotline"), F.lit("prom"))).alias("sources"),
    )
    asked = table(spark, d, "events").select("user_id").distinct().select(F.col("user_id").alias("request"), F.col("user_id").alias("key"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=(F.col("user_id") % 900).cast("int"))).alias("as_of"))
    rows = memory.latest_value(log, asked, "sources", days=10)
    known = F.when(F.col("sources").isNull(), "unknown").when(F.size("sources") == 0, "nothing").otherwise("found")
    urls = F.when(F.col("sources").isNull(), 0).otherwise(F.size("sources"))
    rows = memory.refreshed(rows.withColumns({"known": known, "urls": urls}), F.col("key") % 4 == 0, F.col("urls"))
    return rows.select(F.col("key").alias("user_id"), "known", F.array_join("sources", ",").alias("sources"), "repair_required", "discovery_gap")


LOG_SQL = """log AS (SELECT user_id AS identity_key, event_type AS source, 'https://shop.ua/p' || (event_id % 7) AS url, (event_id // 5000)::VARCHAR AS version, CASE WHEN value > 100 THEN 'CONFIRMED' WHEN value > 30 THEN 'PROBABLE' ELSE 'AMBIGUOUS' END AS confidence,
  ts, event_id AS seq, event_id % 10 = 0 AS deleted FROM events)"""
QUERIES = {
    mission_identities: """WITH f AS (SELECT p_partkey AS id, 'epcc' || p_partkey AS article, CASE WHEN p_partkey % 2 = 0 THEN 'hubber' END AS supplier, lower(p_name) AS name, lower(p_type) AS model FROM part)
      SELECT id, sha256(CASE WHEN supplier IS NOT NULL THEN '{"article":"' || article || '","supplier":"' || supplier || '"}' ELSE '{"article":"' || article || '","brand":"nike","model":"' || model || '","name":"' || name || '"}' END) AS identity_key,
        left(sha256('{"brand":"nike","model":"' || model || '","name":"' || name || '"}'), 24) AS identity_version FROM f""",
    identity_recall: f"""WITH {LOG_SQL}, asked AS (SELECT DISTINCT identity_key, source, TIMESTAMP '2024-01-12' + to_hours(identity_key % 300) AS as_of, CASE WHEN identity_key % 3 > 0 THEN (identity_key % 2)::VARCHAR END AS wanted FROM log),
      last AS (SELECT a.as_of, a.wanted, l.* FROM asked a JOIN log l USING (identity_key, source) WHERE l.ts <= a.as_of QUALIFY row_number() OVER (PARTITION BY identity_key, source, url ORDER BY ts DESC, seq DESC) = 1)
      SELECT identity_key || ':' || source AS request, row_number() OVER (PARTITION BY identity_key, source ORDER BY CASE confidence WHEN 'CONFIRMED' THEN 0 WHEN 'PROBABLE' THEN 1 ELSE 2 END, ts DESC, url) AS rank, url, confidence, version
      FROM last WHERE NOT deleted AND ts >= as_of - INTERVAL 5 DAY AND (wanted IS NULL OR version = wanted) QUALIFY rank <= 3""",
    current_identities: f"WITH {LOG_SQL}, last AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY identity_key, source, url ORDER BY ts DESC, seq DESC) = 1) SELECT identity_key, source, url, confidence, seq AS event_id FROM last WHERE NOT deleted",
    discovery_memory: """WITH asked AS (SELECT DISTINCT user_id, TIMESTAMP '2024-01-01' + to_hours(user_id % 900) AS as_of FROM events),
      last AS (SELECT a.user_id, a.as_of, e.ts, e.event_id FROM asked a JOIN events e USING (user_id) WHERE e.event_type IN ('view', 'purchase') AND e.ts <= a.as_of QUALIFY row_number() OVER (PARTITION BY a.user_id ORDER BY e.ts DESC, e.event_id DESC) = 1),
      found AS (SELECT a.user_id, CASE l.event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'prom' WHEN 2 THEN 'hotline,prom' END AS s FROM asked a LEFT JOIN last l ON l.user_id = a.user_id AND a.as_of - l.ts < INTERVAL 10 DAY)
      SELECT user_id, CASE WHEN s IS NULL THEN 'unknown' WHEN s = '' THEN 'nothing' ELSE 'found' END AS known, s AS sources, user_id % 4 <> 0 AND coalesce(s, '') <> '' AS repair_required, user_id % 4 <> 0 AND coalesce(s, '') = '' AS discovery_gap FROM found""",
}
