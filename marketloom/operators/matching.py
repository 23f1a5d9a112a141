"""Offer validation and page products: conflicts as columns, one decision table, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import scalars

# What marks a title as another thing than the plain product.
USED = r"(?U)\b(?:вживан\w*|б у|бу|used|refurbished|refurb|відновлен\w*|восстановлен\w*)\b"
CLONE = r"(?U)\b(?:реплік\w*|реплик\w*|копі\w*|копи\w*|аналог\w*|clone|copy|airoha)\b"
BUNDLE = r"(?U)\b(?:комплект\w*|набор\w*|набір\w*|bundle|set|[0-9]{1,2} ?(?:в|in) ?1)\b"
ACCESSORY = r"(?U)\b(?:амбуш[ую]р\w*|ear ?pad\w*|накладк\w* на оголов\w*|headband (?:cover|cushion|pad)\w*|(?:кейс|чехол|чохол|case) (?:для|for))\b"
PACK = r"(?U)\b([0-9]{1,3}) ?(?:шт|штук|pcs|pieces)\b"
LEAST_OVERLAP, ENOUGH_OVERLAP = 0.18, 0.55


def norm(text: Column) -> Column:
    """Lower-case words, everything else one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w]+", " "))


def long_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, " "), lambda w: F.length(w) >= 3))


def overlap(source: Column, offer: Column) -> Column:
    """The share of the source's words of three letters or more that the offer has."""
    mine = long_words(source)
    return F.size(F.array_intersect(mine, long_words(offer))) / F.greatest(F.lit(1), F.size(mine))


def _count(text: Column) -> Column:
    n = F.nullif(F.regexp_extract(text, PACK, 1), F.lit("")).cast("int")
    return F.when(n > 1, n)


def _only_in_offer(pattern: str, source: Column, offer: Column) -> Column:
    return offer.rlike(pattern) & ~source.rlike(pattern)


def conflicts(source: Column, offer: Column, brand: Column, strong: Column) -> Column:
    """What speaks against an offer (both texts normalised), in a fixed order."""
    want, has = _count(source), _count(offer)
    years = lambda t: F.regexp_extract_all(t, F.lit(r"\b(20[0-9]{2})\b"), 1)
    hertz = lambda t: F.regexp_extract_all(t, F.lit(r"(?U)\b([0-9]{2,3}) ?(?:гц|hz)\b"), 1)
    apart = lambda x, y: (F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y)
    found = {
        "authenticity": _only_in_offer(CLONE, source, offer), "condition": _only_in_offer(USED, source, offer),
        "quantity": want.isNotNull() & F.coalesce(has != want, ~strong), "accessory": _only_in_offer(ACCESSORY, source, offer),
        "bundle": _only_in_offer(BUNDLE, source, offer), "year": apart(years(source), years(offer)), "refresh rate": apart(hertz(source), hertz(offer)),
        "brand": brand.isNotNull() & ~strong & ~F.concat(F.lit(" "), offer, F.lit(" ")).contains(F.concat(F.lit(" "), norm(brand), F.lit(" "))),
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in found.items()]))


def identity(found: Column, certain: Column, share: Column) -> Column:
    """How far an offer is known to be the product."""
    return F.when(F.size(found) > 0, "CONFLICT").when(certain, "CONFIRMED").when(share >= ENOUGH_OVERLAP, "PROBABLE").otherwise("AMBIGUOUS")


def validated(offers: DataFrame) -> DataFrame:
    """Adds overlap, conflicts, identity, verdict and score to offers with source (the product's text), title, brand, and
    optionally identifier (compact; one that the title holds makes the match strong) and the columns of variants.compared (their
    conflicts count, and a model that both name makes the match strong where the brand is there too)."""
    words = offers.withColumns({"_s": norm(F.concat_ws(" ", "source", "brand")), "_o": norm(F.col("title"))})
    compact = F.regexp_replace("_o", " ", "")
    strong = F.lit(False)
    if "identifier" in offers.columns:
        strong = F.coalesce(scalars.strong_identifier(F.col("identifier")) & compact.contains(F.col("identifier")), F.lit(False))
    varied = "variant_conflicts" in offers.columns
    if varied:
        branded = F.concat(F.lit(" "), F.col("_o"), F.lit(" ")).contains(F.concat(F.lit(" "), norm(F.col("brand")), F.lit(" ")))
        strong = strong | ((F.size("models_shared") > 0) & F.coalesce(branded, F.lit(True)))
    rows = words.withColumns({"overlap": overlap(F.col("_s"), F.col("_o")), "strong": strong})
    found = conflicts(F.col("_s"), F.col("_o"), F.col("brand"), F.col("strong"))
    if varied:
        unsure = F.when((F.col("generation") == "unconfirmed") & ~F.col("strong"), F.array(F.lit("generation"))).otherwise(F.array().cast("array<string>"))
        found = F.array_distinct(F.concat(found, F.transform("variant_conflicts", lambda c: c["rule"]), unsure))
    rows = rows.withColumn("conflicts", found)
    rows = rows.withColumn("identity", identity(F.col("conflicts"), F.col("strong"), F.col("overlap")))
    share, near = F.col("overlap"), F.col("overlap") >= LEAST_OVERLAP
    table = [
        (F.size("conflicts") > 0, F.when(near, "CONFLICT").otherwise("REJECT"), F.least(F.lit(0.64), 0.20 + share)),
        (F.col("identity") == "AMBIGUOUS", F.lit("CONFLICT"), F.least(F.lit(0.69), 0.30 + share)),
        (F.col("strong"), F.lit("PASS"), F.least(F.lit(1.0), 0.77 + 0.18 * share)),
        (share >= ENOUGH_OVERLAP, F.lit("PASS"), F.least(F.lit(0.79), 0.35 + share)),
        (near, F.lit("CONFLICT"), F.least(F.lit(0.64), 0.20 + share)),
    ]
    verdict, score = F.lit("REJECT"), share
    for condition, what, value in reversed(table):
        verdict, score = F.when(condition, what).otherwise(verdict), F.when(condition, value).otherwise(score)
    return rows.withColumns({"verdict": verdict, "score": score}).drop("_s", "_o")


def health(passes: Column, conflicts: Column, errors: Column, seen: Column) -> Column:
    """What a scan of a source came to, by numbers: passes without an error, anything that fits or nearly, only errors."""
    return F.when((passes > 0) & (errors == 0), "FOUND").when((passes > 0) | (conflicts > 0), "PARTIAL").when((errors > 0) & (seen == 0), "ACCESS_LIMITED").otherwise("NOT_FOUND")


def page_products(pages: DataFrame) -> DataFrame:
    """article, name, price, availability and origin of pages (article, html): JSON-LD products at the root, in a list or in
    @graph first; else the meta element; else the most frequent embedded price, the larger of equals."""
    scripts = F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), 1)
    product = "struct<`@type`:string,name:string,offers:string>"
    listed = lambda x: F.when(F.ltrim(x).startswith("["), x).otherwise(F.concat(F.lit("["), x, F.lit("]")))
    nodes = F.flatten(F.transform(scripts, lambda x: F.coalesce(F.from_json(listed(F.coalesce(F.get_json_object(x, "$['@graph']"), x)), f"array<{product}>"), F.array())))
    offers = F.from_json(listed(F.col("_p.offers")), "array<struct<price:string,availability:string>>")
    least = F.array_min(F.transform(offers, lambda o: scalars.parse_page_price(o["price"])))
    meta = scalars.parse_page_price(F.regexp_extract("html", r'(?is)<meta[^>]*price:amount[^>]*content="([^"]+)"', 1))
    embedded = F.regexp_extract_all("html", F.lit(r'"price"\s*:\s*"?([0-9]+(?:\.[0-9]+)?)'), 1)
    counted = F.transform(F.array_distinct(embedded), lambda p: F.struct(F.size(F.filter(embedded, lambda q: q == p)).alias("n"), p.cast("double").alias("p")))
    rows = pages.withColumn("_p", F.try_element_at(F.filter(nodes, lambda n: n["@type"] == "Product"), F.lit(1)))
    rows = rows.withColumns({"_l": least, "_m": meta, "_e": F.array_max(counted)["p"], "_a": F.try_element_at(F.filter(F.transform(offers, lambda o: o["availability"]), lambda a: a != ""), F.lit(1))})
    origin = F.when(F.col("_l").isNotNull(), "jsonld").when(F.col("_m").isNotNull(), "meta").when(F.col("_e").isNotNull(), "embedded_json").otherwise("none")
    return rows.select("article", F.col("_p.name").alias("name"), F.coalesce("_l", "_m", "_e").alias("price"), scalars.availability_state(F.col("_a")).alias("availability"), origin.alias("origin"))
