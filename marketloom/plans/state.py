"""Queries on jobs, events, pages and captured values, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.functions import scalars
from marketloom.operators import admission, jobs
from marketloom.sources.tables import job_events, table

BLOCKED = ["example.org", "spam.test"]


def latest_state(spark, d):
    """The last event of each user; the larger id on equal times."""
    last = F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id"))
    return table(spark, d, "events").groupBy("user_id").agg(last.alias("x")).select("user_id", "x.*")


def fifo_head(spark, d):
    """The earliest waiting event of each type."""
    first = F.min(F.struct("ts", "event_id", "user_id"))
    return table(spark, d, "events").groupBy("event_type").agg(first.alias("x")).select("event_type", "x.event_id", "x.user_id")


def source_timing(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(
        F.count("value").alias("samples"), F.round(F.avg("value"), 3).alias("average"), F.max("value").alias("longest")
    )


def usage_cost(spark, d):
    rows = table(spark, d, "events").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_type") == "view").alias("hits"))
    return rows.select(
        "total", "hits", (F.col("total") - F.col("hits")).alias("api"), F.round(F.col("hits") * 100.0 / F.col("total"), 2).alias("hit_percent"),
        F.round((F.col("total") - F.col("hits")) / 1000, 6).alias("cost"), F.round(F.col("hits") / 1000, 6).alias("saved"),
    )


def reason_top5(spark, d):
    """Each user's five commonest event types, first seen first among equals."""
    rows = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ts", "event_id")).alias("first"))
    order = Window.partitionBy("user_id").orderBy(F.desc("n"), "first")
    return rows.withColumn("rank", F.row_number().over(order)).filter("rank <= 5").select("user_id", "event_type", "n", "rank")


def identity_rank_ttl(spark, d):
    """The three newest purchases or views of a user within 10 days before 2024-02-01, purchases first."""
    rows = table(spark, d, "events").filter("event_type in ('purchase', 'view') and ts <= timestamp '2024-02-01' and ts >= timestamp '2024-01-22'")
    order = Window.partitionBy("user_id").orderBy(F.when(F.col("event_type") == "purchase", 0).otherwise(1), F.desc("ts"), F.desc("event_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter("rank <= 3").select("user_id", "event_id", "rank")


def rate_window(spark, d):
    """How many of a user's events fall into the hour up to each event."""
    hour = Window.partitionBy("user_id").orderBy(F.col("ts").cast("timestamp").cast("long")).rangeBetween(-3599, 0)
    return table(spark, d, "events").select("event_id", "user_id", F.count(F.lit(1)).over(hour).alias("in_hour"))


def sliding_admission(spark, d):
    """Whether each event is admitted: two admitted ones of its type within an hour are the limit; else how long to wait."""
    rows = admission.admitted(job_events(spark, d), "kind", limit=2, seconds=3600)
    return rows.select("event_id", "kind", "admitted", F.coalesce("retry_after", F.lit(0)).alias("retry_after"))


def job_history(spark, d):
    """The state before and after each event of a job; what is known ends after five days without one, or with the version."""
    return jobs.job_states(job_events(spark, d), "job", "action", "version", seconds=5 * 86_400).select("event_id", "job", "action", "before", "status", "legal")


def resume_antijoin(spark, d):
    """Orders without any line item yet returned: what is left to do."""
    done = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(done, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


def duplicate_jobs(spark, d):
    """Customers with an open order who placed another order on the same day."""
    rows = table(spark, d, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderstatus")
    found = rows.groupBy("o_custkey", "day").agg(F.count(F.lit(1)).alias("orders"), F.count_if(F.col("o_orderstatus") == "O").alias("active"))
    return found.filter("orders > 1 and active > 0")


def repair_targets(spark, d):
    """Of the types that a user had before, the allowed ones that the user's last hundred ids lack."""
    rows = table(spark, d, "events").withColumn("late", F.col("event_id") >= F.lit(500))
    sets = rows.groupBy("user_id").agg(F.collect_set(F.when(~F.col("late"), F.col("event_type"))).alias("prior"), F.collect_set(F.when(F.col("late"), F.col("event_type"))).alias("now"))
    allowed = F.array(*[F.lit(x) for x in ("click", "purchase", "view")])
    return sets.select("user_id", F.array_join(F.array_sort(F.array_except(F.array_intersect("prior", allowed), "now")), ",").alias("targets"))


def canonical_urls(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", scalars.canonical_url(url).alias("canonical"), scalars.host(url).alias("host"))


def suffix_domains(spark, d):
    """Pages by the registered domain that their host ends in."""
    host = scalars.host(F.col("url"))
    parts = F.split(host, "[.]")
    domain = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".")
    return table(spark, d, "pages").groupBy(domain.alias("domain")).agg(F.count(F.lit(1)).alias("pages"))


def blocked_antijoin(spark, d):
    host = scalars.host(F.col("url"))
    blocked = F.lit(False)
    for b in BLOCKED:
        blocked = blocked | (host == b) | host.endswith(f".{b}")
    return table(spark, d, "pages").filter(~blocked).select("page_id", host.alias("host"))


def html_titles(spark, d):
    return table(spark, d, "pages").select("page_id", scalars.page_title(F.col("html")).alias("title"))


def captured_values(spark, d):
    """Number, price, currency, availability and discount parsing over fixed examples."""
    rows = [("1 234,50", "12.999,00 грн", "грн.", "В наявності", 649.0, 445.0), ("-3", "1.234.567", "usd", "Sold out", 10.0, 12.0), ("x", "free", None, "?", None, 5.0), ("0", "99", "", "OutOfStock InStock", 0.0, 1.0)]
    t = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, number string, price string, currency string, stock string, old double, now double")
    return t.select(
        "id", scalars.parse_number(F.col("number")).alias("number"), scalars.parse_page_price(F.col("price")).alias("price"), scalars.currency_code(F.col("currency")).alias("currency"),
        scalars.availability_state(F.col("stock")).alias("stock"), scalars.discount_percent(F.col("old"), F.col("now")).alias("discount"),
    )


HOST_SQL = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www[.]', '')"
JOB_EVENTS_SQL = """job_events AS (SELECT event_id, epoch_us(ts) AS us, user_id AS job, event_type AS kind, CASE WHEN event_id % 13 = 0 THEN 'restart' WHEN event_id % 11 = 0 THEN 'resume' WHEN event_id % 17 = 0 THEN 'stop'
  WHEN event_type = 'signup' THEN 'submit' WHEN event_type = 'click' THEN 'start' WHEN event_type = 'purchase' THEN 'finish' WHEN event_type = 'error' THEN 'fail' ELSE 'cancel' END AS action, event_id // 2500 AS version FROM events)"""
MOVE_SQL = """CASE WHEN a = 'submit' AND b = 'new' THEN 'queued' WHEN a = 'start' AND b = 'queued' THEN 'running' WHEN a = 'finish' AND b IN ('running', 'cancelling') THEN 'done' WHEN a = 'fail' AND b IN ('running', 'cancelling') THEN 'error'
  WHEN a = 'cancel' AND b = 'queued' THEN 'cancelled' WHEN a = 'cancel' AND b IN ('running', 'cancelling', 'interrupted') THEN 'cancelling' WHEN a = 'stop' AND b IN ('running', 'cancelling') THEN 'cancelled'
  WHEN a = 'restart' AND b IN ('queued', 'running') THEN 'interrupted' WHEN a = 'restart' AND b = 'cancelling' THEN 'cancelled' WHEN a = 'restart' AND b <> 'new' THEN b
  WHEN a = 'resume' AND b IN ('queued', 'running', 'cancelling') THEN b WHEN a = 'resume' AND b IN ('interrupted', 'error', 'cancelled') THEN 'queued' END"""
QUERIES = {
    sliding_admission: f"""WITH RECURSIVE {JOB_EVENTS_SQL}, n AS (SELECT event_id, kind, us, row_number() OVER (PARTITION BY kind ORDER BY us, event_id) AS rn FROM job_events), steps AS (
        SELECT event_id, kind, us, rn, true AS admitted, 0::BIGINT AS retry_after, [us] AS held FROM n WHERE rn = 1
        UNION ALL SELECT event_id, kind, us, rn, len(h) < 2, CASE WHEN len(h) < 2 THEN 0 ELSE greatest(1, (3600000000 - (us - h[1])) // 1000000) END, CASE WHEN len(h) < 2 THEN list_append(h, us) ELSE h END
        FROM (SELECT n.*, list_filter(s.held, lambda t: t > n.us - 3600000000) AS h FROM steps s JOIN n ON n.kind = s.kind AND n.rn = s.rn + 1))
      SELECT event_id, kind, admitted, retry_after FROM steps""",
    job_history: f"""WITH RECURSIVE {JOB_EVENTS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY us, event_id) AS rn, us - lag(us) OVER w < 432000000000 AND version = lag(version) OVER w AS fresh FROM job_events WINDOW w AS (PARTITION BY job ORDER BY us, event_id)), steps AS (
        SELECT event_id, job, action, rn, 'new' AS before, CASE action WHEN 'submit' THEN 'queued' ELSE 'new' END AS status, action = 'submit' AS legal FROM n WHERE rn = 1
        UNION ALL SELECT event_id, job, a, rn, b, coalesce({MOVE_SQL}, b), {MOVE_SQL} IS NOT NULL FROM (SELECT n.event_id, n.job, n.rn, n.action AS a, CASE WHEN n.fresh THEN s.status ELSE 'new' END AS b FROM steps s JOIN n ON n.job = s.job AND n.rn = s.rn + 1))
      SELECT event_id, job, action, before, status, legal FROM steps""",
    latest_state: "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    fifo_head: "SELECT event_type, event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) = 1",
    source_timing: "SELECT event_type, count(value) AS samples, round(avg(value), 3) AS average, max(value) AS longest FROM events GROUP BY 1",
    usage_cost: "WITH x AS (SELECT count(*) AS total, count(*) FILTER (event_type = 'view') AS hits FROM events) SELECT total, hits, total - hits AS api, round(hits * 100.0 / total, 2)::DOUBLE AS hit_percent, round((total - hits) / 1000, 6) AS cost, round(hits / 1000, 6) AS saved FROM x",
    reason_top5: "WITH x AS (SELECT user_id, event_type, count(*) AS n, min((ts, event_id)) AS first FROM events GROUP BY 1, 2) SELECT user_id, event_type, n, CAST(row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS INTEGER) AS rank FROM x QUALIFY rank <= 5",
    identity_rank_ttl: "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 ELSE 1 END, ts DESC, event_id DESC) AS INTEGER) AS rank FROM events WHERE event_type IN ('purchase', 'view') AND ts <= TIMESTAMP '2024-02-01' AND ts >= TIMESTAMP '2024-01-22' QUALIFY rank <= 3",
    rate_window: "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS in_hour FROM events",
    resume_antijoin: "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    duplicate_jobs: "SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS orders, count(*) FILTER (o_orderstatus = 'O') AS active FROM orders GROUP BY 1, 2 HAVING orders > 1 AND active > 0",
    repair_targets: "SELECT user_id, coalesce(string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (early AND NOT late), '') AS targets FROM (SELECT user_id, event_type, bool_or(event_id < 500) AND event_type IN ('click', 'purchase', 'view') AS early, bool_or(event_id >= 500) AS late FROM events GROUP BY 1, 2) GROUP BY 1",
    suffix_domains: f"WITH h AS (SELECT string_split({HOST_SQL}, '.') AS p FROM pages) SELECT array_to_string(p[greatest(len(p) - 1, 1):], '.') AS domain, count(*) AS pages FROM h GROUP BY 1",
    blocked_antijoin: f"SELECT page_id, {HOST_SQL} AS host FROM pages WHERE NOT ({' OR '.join(f'{HOST_SQL} = {b!r} OR ends_with({HOST_SQL}, {chr(39)}.{b}{chr(39)})' for b in BLOCKED)})",
    html_titles: r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages",
    canonical_urls: f"WITH a AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS bare FROM pages), b AS (SELECT *, list_filter(string_split(CASE WHEN contains(bare, '?') THEN substr(bare, strpos(bare, '?') + 1) ELSE '' END, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[^=]*|gclid|fbclid|ved|sa|source|s?rsltid)(=|$)')) AS kept, split_part(bare, '?', 1) AS front FROM a) SELECT page_id, lower(regexp_extract(front, '^[a-zA-Z]+://[^/]+')) || substr(front, length(regexp_extract(front, '^[a-zA-Z]+://[^/]+')) + 1) || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical, {HOST_SQL} AS host FROM b",
    captured_values: "SELECT * FROM (VALUES (0, 1234.5, 1299900.0::DOUBLE, 'UAH', 'IN_STOCK', 31.43::DOUBLE), (1, -3.0, 1234567.0, 'USD', 'OUT_OF_STOCK', NULL), (2, NULL, NULL, 'UAH', 'UNKNOWN', NULL), (3, 0.0, 99.0, 'UAH', 'OUT_OF_STOCK', NULL)) t(id, number, price, currency, stock, discount)",
}
