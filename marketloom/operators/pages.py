"""Products of web pages: JSON-LD at any depth, then meta elements, then prices in scripts, then prices in the text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import scalars
from marketloom.functions.folding import let
from marketloom.sources.sinks import stored

# Meta elements by attribute and value, in the order in which they are tried.
TITLES = [("property", "og:title"), ("name", "twitter:title")]
PRICES = [("property", "product:price:amount"), ("itemprop", "price"), ("property", "og:price:amount"), ("name", "product:price:amount")]
STOCKS = [("property", "product:availability"), ("itemprop", "availability")]
# A price in hryvnias in running text, and words beside it that tell of monthly payments.
PRICE = r"(?iU)(?<!\d)(\d{1,3}(?:[\s.,]\d{3})+|\d{3,7})(?:[.,]\d{1,2})?\s*(?:грн|₴|uah)"
MONTHLY = ["/міс", "на місяць", "в місяць", "щомісяц", "платіж"]
#: Characters on either side of a price in which such words count.
BESIDE = 40
# Phrases for stock that are looked for in the text, in order.
PHRASES = [
    "готово до відправки", "готовий до відправки", "відвантаження зі складу", "відправка зі складу", "є в наявності", "в наявності", "готов к отправке", "отгрузка со склада", "есть в наличии", "в наличии", "немає в наявності", "нет в наличии",
]
# Keys of prices and names in scripts.
SCRIPT_PRICES = [
    r'(?i)"(?:price|currentPrice|current_price|salePrice|sale_price|finalPrice|final_price)"\s*:\s*"?([0-9][0-9\s.,]{2,12})', r'(?i)"price"\s*:\s*\{[^{}]{0,300}?"(?:value|amount)"\s*:\s*"?([0-9][0-9\s.,]{2,12})',
]
SCRIPT_NAME = r'(?i)"(?:name|title|productName|product_name)"\s*:\s*"([^"\\]{4,300})"'


def _attribute(tag: Column, name: str) -> Column:
    value = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    return F.coalesce(*[F.nullif(F.regexp_extract(tag, value, n), F.lit("")) for n in (1, 2)])


def _first(tags: Column, name: str, value: str) -> Column:
    """The first element whose attribute has a value."""
    return F.get(F.filter(tags, lambda t: F.coalesce(_attribute(t, name) == value, F.lit(False))), F.lit(0))


def meta(html: Column, kinds: list[tuple[str, str]]) -> Column:
    """The content of the first meta element of a kind, whatever the order of its attributes; of the first kind that has one."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), 0)
    return F.coalesce(*[_attribute(_first(tags, a, v), "content") for a, v in kinds])


def scripts(html: Column, kind: str = "") -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?is)<script\b[^>]*{kind}[^>]*>(.*?)</script>"), 1)


def named_prices(text: Column) -> Column:
    """The prices that a text names, but for those with words of monthly payments near them."""
    plain = lambda x: F.regexp_replace(x, "\u0002[^\u0003]*\u0003", "")

    def one(pieces: Column, piece: Column, i: Column) -> Column:
        # A piece begins with a price, so a dozen of them reach over the distance on either side.
        before = F.right(F.array_join(F.slice(pieces, F.greatest(i - 15, F.lit(1)), F.least(i, F.lit(16))), ""), F.lit(BESIDE + 200))
        after = F.array_join(F.slice(pieces, i + 1, 16), "")
        # The price itself takes some of what follows, so it is counted on top.
        near = F.lower(F.concat(F.right(plain(before), F.lit(BESIDE)), F.left(plain(after), F.length(F.substring_index(piece, "\u0002", 1)) + BESIDE)))
        amount = F.regexp_extract(piece, "\u0002([^\u0003]*)\u0003", 1)
        return F.when((i > 0) & ~reduce(lambda a, b: a | b, [near.contains(w) for w in MONTHLY]), scalars.parse_page_price(amount))

    marked = F.split(F.regexp_replace(text, PRICE, "\u0001$0\u0002$1\u0003"), "\u0001")
    return let(marked, lambda pieces: F.array_compact(F.transform(pieces, lambda piece, i: one(pieces, piece, i))))


def _types(v: Column) -> Column:
    one = F.array(F.try_variant_get(v, "$['@type']", "string"))
    return F.transform(F.coalesce(F.try_variant_get(v, "$['@type']", "array<string>"), one), F.lower)


def jsonld_products(pages: DataFrame) -> DataFrame:
    """page, name, price and availability by JSON-LD: the first product with a price, wherever it is nested. A page's scripts
    are taken in order, a script's nodes from the outside in and from the last to the first (fields by name); the price is the
    least of its offers'. Each round goes one level down into what holds a type at all, and is written."""
    spark = pages.sparkSession
    told = pages.select("page", F.posexplode(scripts(F.col("html"), r"application/ld\+json")).alias("script", "text"))
    level = told.select("page", "script", F.array().cast("array<int>").alias("path"), F.try_parse_json("text").alias("v")).filter("v is not null")
    held, found = "contains(schema_of_variant(v), '@type')", []
    while not (level := stored(level.filter(held))).isEmpty():
        found.append(level.filter(F.exists(_types(F.col("v")), lambda t: F.coalesce(t == "product", F.lit(False)))))
        below = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        level = below.select("page", "script", F.concat("path", F.array(-F.col("pos"))).alias("path"), F.col("value").alias("v"))
    if not found:
        return pages.select("page", F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("price"), F.lit(None).cast("string").alias("availability")).filter(F.lit(False))
    offers = F.coalesce(F.try_variant_get("v", "$.offers", "array<variant>"), F.array(F.try_variant_get("v", "$.offers", "variant")))
    field = lambda o, c: F.nullif(F.try_variant_get(o, f"$.{c}", "string"), F.lit(""))
    price = F.array_min(F.transform(offers, lambda o: scalars.parse_page_price(F.coalesce(field(o, "price"), field(o, "lowPrice"), field(o, "highPrice")))))
    stock = F.get(F.array_compact(F.transform(offers, lambda o: field(o, "availability"))), F.lit(0))
    rows = reduce(DataFrame.unionByName, found).select("page", "script", "path", F.try_variant_get("v", "$.name", "string").alias("name"), price.alias("price"), stock.alias("availability"))
    first = F.min_by(F.struct("name", "price", "availability"), F.struct("script", "path"))
    return rows.filter("price is not null").groupBy("page").agg(first.alias("x")).select("page", "x.*")


def extracted(pages: DataFrame) -> DataFrame:
    """page, title, price, availability (state) and origin (jsonld, meta, embedded_json, text or none) of pages (page: unique; html)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")
    rows = pages.select("page", html.alias("html")).withColumns({
        "_meta": scalars.parse_page_price(meta(html, PRICES)), "_title": scalars.clean_text(F.coalesce(meta(html, TITLES), F.nullif(scalars.page_title(html), F.lit("")), F.lit(""))), "_stock": meta(html, STOCKS),
        "_link": _attribute(_first(F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*>"), 0), "itemprop", "availability"), "href"),
        "_scripts": F.filter(scripts(html), lambda s: (F.length(s) >= 40) & s.rlike("(?i)product|offer|price|sku|mpn")), "_text": scalars.clean_text(F.regexp_replace(bare, "<[^>]+>", " ")),
    })
    prices = F.flatten(F.transform("_scripts", lambda s: F.concat(*[F.transform(F.regexp_extract_all(s, F.lit(p), 1), scalars.parse_page_price) for p in SCRIPT_PRICES])))
    usable = F.transform(F.filter(prices, lambda p: p.between(20, 10_000_000)), lambda p: F.round(p, 2))
    counted = lambda all_: F.transform(F.array_distinct(all_), lambda p: F.struct(F.size(F.filter(all_, lambda q: q == p)).alias("n"), p.alias("p")))
    names = F.filter(F.transform("_scripts", lambda s: F.regexp_extract(s, SCRIPT_NAME, 1)), lambda n: n != "")
    low = F.lower("_text")
    rows = rows.withColumns({"_embedded": let(usable, lambda all_: F.array_max(counted(all_)))["p"], "_name": F.get(names, F.lit(0)), "_named": F.get(named_prices(F.col("_text")), F.lit(0)), "_phrase": F.coalesce(*[F.when(low.contains(p), p) for p in PHRASES])})
    found = jsonld_products(pages.select("page", html.alias("html"))).select("page", F.col("name").alias("_ld_name"), F.col("price").alias("_ld"), F.col("availability").alias("_ld_stock"))
    rows = rows.drop("html", "_scripts", "_text").join(found, "page", "left")
    steps = [("jsonld", "_ld"), ("meta", "_meta"), ("embedded_json", "_embedded"), ("text", "_named")]
    origin = F.coalesce(*[F.when(F.col(c).isNotNull(), name) for name, c in steps], F.lit("none"))
    known = F.coalesce("_stock", "_link")
    stock = F.when(origin == "jsonld", F.col("_ld_stock")).when(origin == "meta", known).when(origin != "embedded_json", F.coalesce(known, F.col("_phrase")))
    own = F.when(origin == "jsonld", F.col("_ld_name")).when(origin == "embedded_json", F.col("_name"))
    return rows.select("page", F.coalesce(F.nullif(own, F.lit("")), F.col("_title")).alias("title"), F.coalesce(*[c for _, c in steps]).alias("price"), scalars.availability_state(stock).alias("availability"), origin.alias("origin"))
