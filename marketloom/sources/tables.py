"""The market's missions, offers, jobs and pages, from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What tells one offer from another; shorter keys repeat.
OFFER_KEY = ["l_orderkey", "l_linenumber", "article", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def missions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per product to analyse: article, name, brand, category, own_price."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("article"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"), F.col("p_retailprice").alias("own_price"),
    )


def spread_missions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows in as many partitions as a shuffle has. A product's titles and pages cost far more than its row's shuffle,
    and a table of products alone has few splits: one for millions of titles."""
    rows = missions(spark, sf_dir)
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "article")


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate offers: the key columns, source, domain, price, currency, match and confidence.

    Suppliers, nations and regions are the small dimensions of the schema; Spark broadcasts them by their size."""
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    places = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    places = places.select("s_suppkey", "s_name", "r_name")
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "article")
    market = F.col("l_returnflag") == "N"
    quantity = F.col("l_quantity")
    return lines.join(places, F.col("l_suppkey") == F.col("s_suppkey")).select(
        *OFFER_KEY,
        F.when(market, F.col("r_name")).otherwise("web_shops").alias("source"),
        F.when(market, F.lit(None)).otherwise(F.lower("s_name")).alias("domain"),
        (F.col("l_extendedprice") / quantity).alias("price"),
        F.when(F.col("l_orderkey") % 17 == 0, "USD").when(F.col("l_linestatus") == "F", "₴").otherwise("UAH").alias("currency"),
        (1 - F.col("l_discount")).alias("match"),
        F.when(quantity <= 20, "CONFIRMED").when(quantity <= 35, "PROBABLE").when(quantity <= 43, "AMBIGUOUS").otherwise("CONFLICT").alias("confidence"),
    )


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One offer page's address per product, each kind of address in turn."""
    key = F.col("article").cast("string")
    kinds = [
        ("rozetka.com.ua", "https://WWW.rozetka.com.ua/ua/p", "/?utm_source=x&color=red&gclid=9#top"), ("prom.ua", "https://prom.ua/ua/m-", "-name?ref=a"),
        ("epicentrk.ua", "https://epicentrk.ua/ua/shop/Item-", ".html"), ("hotline.ua", "https://hotline.ua/ru/computer-monitory/x", "/"),
        ("shop.example.ua", "http://shop.example.ua/category/", "?source=a"),
    ]
    turn = F.col("article") % len(kinds)
    pick = lambda value: F.coalesce(*[F.when(turn == i, value(k)) for i, k in enumerate(kinds)])
    return missions(spark, sf_dir).select("article", pick(lambda k: F.lit(k[0])).alias("domain"), pick(lambda k: F.concat(F.lit(k[1]), key, F.lit(k[2]))).alias("url"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight candidate titles per product: alike, and with what speaks against an offer."""
    part = spread_missions(spark, sf_dir)
    other = part.filter("article <= 50").select(F.col("article").alias("_of"), F.split("name", " ")[0].alias("_word"))
    rows = part.withColumn("_of", F.col("article") * 7 % 50 + 1).join(other, "_of").withColumn("candidate", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))))
    k = F.col("candidate")
    alike = F.concat_ws(" ", "brand", "name")
    ends = {1: " used", 2: " 5 pcs", 4: " bundle", 5: " case for tablet", 6: " copy", 7: " 2021"}
    title = F.concat(F.when(k == 3, F.concat_ws(" ", "_word", F.split("name", " ")[1])).otherwise(alike), F.coalesce(*[F.when(k == i, t) for i, t in ends.items()], F.lit("")))
    source = F.concat_ws(" ", "name", F.when(F.col("article") % 2 == 0, "3 pcs 2024").otherwise("plain"))
    return rows.select("article", "candidate", "name", "brand", title.alias("title"), source.alias("source"))


def product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per product: JSON-LD at the root or in @graph, a meta price alone, or embedded prices alone."""
    n, name = F.col("article"), F.col("name")
    text = lambda x: x.cast("string")
    script = lambda body: F.concat(F.lit('<html><script type="application/ld+json">'), body, F.lit("</script></html>"))
    one = F.concat(F.lit('{"@type":"Product","name":"'), name, F.lit('","offers":{"price":"'), text(n + 10), F.lit('.5","availability":"http://schema.org/InStock"}}'))
    graph = F.concat(F.lit('{"@graph":[{"@type":"WebPage"},{"@type":"Product","name":"'), name, F.lit('","offers":[{"price":"'), text(n + 9), F.lit('"},{"price":"'), text(n + 1), F.lit('","availability":"InStock"}]}]}'))
    meta = F.concat(F.lit('<meta property="product:price:amount" content="'), text(n + 3), F.lit('">'))
    page = F.when(n % 4 == 0, script(one)).when(n % 4 == 1, script(graph)).when(n % 4 == 2, meta).otherwise('<script>{"price":"12"},{"price":77},{"price":"77"}</script>')
    return spread_missions(spark, sf_dir).select("article", page.alias("html"))


def mixed_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five titles per product in which codes, sizes and words are written in two scripts, with a code in clean letters that the title has (or, for the
    fourth, has not)."""
    n = F.col("article").cast("string")
    made = [
        (F.concat(F.lit("Ортез "), F.col("name"), F.lit(" EPСС"), n), F.concat(F.lit("EPCC"), n)),
        (F.concat(F.upper("name"), F.lit("  129 х "), n, F.lit(" × 9 мм")), F.concat(F.lit("129x"), n, F.lit("x9"))),
        (F.concat(F.lit("Дорожка‑килим BZ-"), n, F.lit(".М чорний\u00a0Монітор")), F.concat(F.lit("BZ "), n, F.lit("-M"))),
        (F.concat(F.lit("Cеро-розовый екран "), n, F.lit("Вт 3в1 р.S")), F.concat((F.col("article") + 1).cast("string"), F.lit("Bт"))),
        (F.concat(F.lit("NІKE "), F.col("name"), F.lit(" LEB1-А"), n, F.lit("MG")), F.concat(F.lit("LEB1 A"), n, F.lit("MG"))),
    ]
    rows = F.array(*[F.struct(F.lit(k).cast("long").alias("kind"), title.alias("title"), code.alias("code")) for k, (title, code) in enumerate(made)])
    return spread_missions(spark, sf_dir).select("article", F.explode(rows).alias("x")).select("article", "x.*")


def title_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight candidates per product with what the older classifier looks at: in other words, with another unit, size, colour
    or model, by name alone, with the supplier's code in the address, and without a title."""
    n = F.col("article").cast("string")
    turn = lambda *names: F.get(F.array(*map(F.lit, names)), (F.col("article") % 4).cast("int"))
    brand, alias = turn("Xiaomi", "Samsung", "Dell", "Acme"), turn("Redmi", "Galaxy", "Dell", "Other")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    name = F.col("name")
    made = [
        (text("Монитор ", alias, " ", name, " черный MX-", n, "K"), text("https://shop.ua/p", n), None),
        (text("Монітор ", brand, " ", name, " MX-", n, "K 165hz"), None, text("чорний 16 gb")),
        (text("Монітор ", brand, " ", name, " 2560х1440 144 Гц"), None, None), (text(brand, " ", name, " MX-", n, "K white"), None, text("144,0 Гц")), (name, None, None),
        (text("Дисплей ", name, " ", brand), text("https://shop.ua/sku", n, "a"), text("1920×1080")), (text("Монітор ", brand, " ", name, " MX-", (F.col("article") + 1).cast("string"), "K"), None, None),
        (None, text("https://shop.ua/mx-", n, "k"), text(brand, " ", name)),
    ]
    of = lambda c, k, names: (F.lit(None).cast("string") if c is None else c).alias(names[k])
    names = ["candidate_title", "candidate_url", "candidate_text"]
    rows = F.array(*[F.struct(F.lit(i).cast("long").alias("candidate"), *[of(c, k, names) for k, c in enumerate(row)]) for i, row in enumerate(made)])
    return spread_missions(spark, sf_dir).select(
        "article", brand.alias("brand"), text("Монітор ", brand, " ", name, " MX-", n, "K 144 Гц чорний 1920x1080").alias("title"),
        F.when(F.col("article") % 2 == 0, text("SKU", n, "A")).otherwise(n).alias("sku"), F.lit("Память 16 ГБ").alias("params"), F.explode(rows).alias("x"),
    ).select("article", "brand", "title", "sku", "params", "x.*")


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of jobs: event_id, ts, job, kind, action (by the event's type and number) and version (of the program)."""
    n, kind = F.col("event_id"), F.col("event_type")
    kinds = {"signup": "submit", "click": "start", "purchase": "finish", "error": "fail", "view": "cancel"}
    action = F.when(n % 13 == 0, "restart").when(n % 11 == 0, "resume").when(n % 17 == 0, "stop")
    for k, a in kinds.items():
        action = action.when(kind == k, a)
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("job"), kind.alias("kind"), action.alias("action"), F.floor(n / 2_500).cast("string").alias("version"))


def variant_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten titles per product: the same in other letters, and with another memory, model, kind, colour, number in brackets,
    generation or size; source is the product's own text."""
    m, name = F.col("article") + 1000, F.col("name")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    full = lambda kind="Смартфон", note="9", model=m, size="6.7", memory="8/128GB", end="чорний": text(f"{kind} Acme ", name, f" Note {note} SM-", model, f" {size} дюйм {memory} {end}")
    made = [
        text("Смартфон Acme ", name, " Note 9 SМ-", m, " 6.7 дюйм 8/128 ГБ black"), full(memory="8/256GB"), full(memory="12/128GB"), full(model=m + 1), text("Чохол для Acme ", name, " Note 9 SM-", m, " чорний"),
        full("Ноутбук"), full(end="white"), full(end="чорний (49)"), full(note="10"), full(size="6.1"),
    ]
    rows = F.array(*[F.struct(F.lit(k).cast("long").alias("candidate"), t.alias("title")) for k, t in enumerate(made)])
    return spread_missions(spark, sf_dir).select("article", F.lit("Acme").alias("brand"), full(end="чорний (48)").alias("source"), F.explode(rows).alias("x")).select("article", "brand", "source", "x.*")


def linkable(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Products (article, source) and offers (offer, title) whose words repeat: kinds and names often, codes of eight in a row
    seldom."""
    part = table(spark, sf_dir, "part")
    n, code = F.col("p_partkey"), F.concat(F.lit("mx"), F.floor(F.col("p_partkey") / 8).cast("string"))
    size = F.concat(F.lit("cap"), F.col("p_size").cast("string"))
    products = part.select(n.alias("article"), F.concat_ws(" ", "p_name", "p_type", code, size).alias("source"))
    kind = F.when(n % 3 == 0, F.lit("sale")).otherwise(F.col("p_type"))
    return products, part.select(n.alias("offer"), F.concat_ws(" ", kind, size, F.split("p_name", " ")[1], F.lit("new"), F.when(n % 2 == 0, code).otherwise("code"), F.split("p_name", " ")[0]).alias("title"))


def nested_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page (page, html) per product, in eight kinds: JSON-LD as a graph in a list, deep inside another thing, of several types and
    prices; meta elements with their attributes in either order; prices in scripts; in the text beside monthly payments; none."""
    n = F.col("article")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    ld = lambda *parts: text('<html><title>page ', n, '</title><script type="application/ld+json">', *parts, "</script></html>")
    kinds = [
        ld('[{"@type":"WebPage"},{"@graph":[{"@type":"Thing"},{"@type":"product","name":"', F.col("name"), '","offers":{"price":"', n + 10, ',50","availability":"https://schema.org/InStock"}}]}]'),
        ld('{"@type":"ItemPage","mainEntity":{"about":{"item":{"@type":["Thing","Product"],"name":"deep ', n, '","offers":[{"highPrice":', n + 7, '},{"lowPrice":"', n + 3, '","availability":"OutOfStock"}]}}}}'),
        ld('{"@type":"Product","name":"no price"}'), text('<meta content="', n + 5, '.25" property="og:price:amount"><meta name="twitter:title" content="T &amp; ', n, '"><link href="http://schema.org/InStock" itemprop="availability">'),
        text('<script>window.state = {"product":{"name":"state ', n, '","price":"', n + 100, '"},"other":{"currentPrice":', n + 100, '},"monthly":{"price":{"value":"9999"}}}</script>'),
        text("<p>", F.lit("1 250"), " грн на місяць</p><p>", F.lit("x" * 60), "</p><p>Ціна ", n + 1000, " грн, є в наявності</p>"), text("<title> plain </title><p>нічого</p>"), text('<script type="application/ld+json">{"@type":"Product", broken</script><meta itemprop="price" content="', n + 1, '">'),
    ]
    return spread_missions(spark, sf_dir).select(n.alias("page"), F.coalesce(*[F.when(n % len(kinds) == i, k) for i, k in enumerate(kinds)]).alias("html"))
