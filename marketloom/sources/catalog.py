"""Supplier catalogues: CSV files and XML feeds with headers of many spellings, as missions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import hierarchy

# Spellings of each field's header, in the order in which they are tried.
ALIASES = {
    "article": ["артикул", "article", "sku", "код", "vendorcode", "vendor_code"],
    "name": ["назва", "название", "name", "товар", "product", "title"],
    "brand": ["бренд", "brand", "виробник", "vendor"],
    "model": ["модель", "model", "mpn"],
    "own_price": ["ціна", "цена", "price", "price_uah", "вартість", "стоимость"],
    "category": ["категорія", "категория", "category", "categoryname", "category_name"],
    "supplier": ["постачальник", "поставщик", "supplier", "vendor_name"],
    "old_price": ["стара ціна", "старая цена", "old_price", "oldprice"],
    "discount": ["знижка", "знижка, %", "скидка", "скидка, %", "discount", "discount_pct"],
}
# The feed elements that hold one product.
ROW_TAGS = ["offer", "product", "item"]
DELIMITERS = ",;\t|"


def resolve_headers(rows: DataFrame) -> DataFrame:
    """One string column per field of ALIASES: the first spelling with a value that isn't blank, else null.

    Headers compare trimmed and in lower case; of headers that are then alike, the last counts. Rows without a name go;
    rows without an article get one from their place, "ROW-" and a number that is unique in the table but, beyond one
    partition, not consecutive. Columns of other names are left out."""
    known = {c.strip().lower(): c for c in rows.columns if isinstance(c, str)}

    def field(names: list[str]) -> Column:
        found = [F.col(f"`{known[n].replace('`', '``')}`") for n in names if n in known]
        texts = [F.trim(c.cast("string")) for c in found]
        return F.coalesce(*[F.when(t != "", t) for t in texts], F.lit(None).cast("string"))

    fields = rows.select(*[field(names).alias(k) for k, names in ALIASES.items()], F.monotonically_increasing_id().alias("_row"))
    article = F.coalesce("article", F.concat(F.lit("ROW-"), (F.col("_row") + 2).cast("string")))
    return fields.filter("name is not null").withColumn("article", article).drop("_row")


def sniff(spark: SparkSession, path: str) -> tuple[str, str]:
    """(delimiter, encoding) by the header line: its commonest delimiter, ";" if it has none; cp1251 if it isn't UTF-8."""
    line = spark.read.option("wholetext", False).text(path).limit(1).select("value", F.encode("value", "UTF-8").alias("raw")).first()
    head = line.value if line else ""
    best = max(DELIMITERS, key=head.count)
    return (best if best in head else ";"), ("windows-1251" if "�" in head else "UTF-8")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Missions of a CSV catalogue; quoted fields may hold line ends. An empty file gives no rows."""
    delimiter, encoding = sniff(spark, path)
    if encoding != "UTF-8":  # left set, as rows are read later
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    rows = spark.read.csv(path, header=True, sep=delimiter, encoding=encoding, multiLine=True, escape='"')
    return resolve_headers(rows)


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Missions of an XML feed: every offer, product or item, its child elements and attributes as fields (children first)."""

    def read(tag: str) -> DataFrame | None:
        rows = spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "@").option("inferSchema", False).load(path)
        if not rows.columns:
            return None
        flat = [c for c, t in rows.dtypes if t == "string"]
        children = [c for c in flat if not c.startswith("@")]
        lower = {c.lower() for c in children}
        attributes = [c for c in flat if c.startswith("@") and c[1:].lower() not in lower]
        return resolve_headers(rows.select(*[F.col(f"`{c}`") for c in children], *[F.col(f"`{c}`").alias(c[1:]) for c in attributes]))

    found = [rows for rows in map(read, ROW_TAGS) if rows is not None]
    if not found:
        raise ValueError(f"No product rows in {path}")
    return reduce(DataFrame.unionByName, found)


def read(spark: SparkSession, path: str) -> DataFrame:
    """By the path's ending: .csv, .xml or .yml."""
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ending == "csv":
        return read_csv(spark, path)
    if ending in ("xml", "yml"):
        return read_feed(spark, path)
    raise ValueError(f"Not a catalogue: {path}")


# The older catalogue's columns by their headers, and the header that may come several times.
LEGACY_HEADERS = {
    "code": "Код товара", "category": "Категория", "sku": "Артикул", "name": "Название", "price": "Цена", "old_price": "Старая цена", "availability": "Наличие", "brand": "Производитель",
    "description": "Описание", "pictures": "url картинки",
}
LEGACY_PARAMETER = "Параметр"
#: Characters by which a file's separator is found.
SNIFFED = 5_000
_FEED_OFFER = ", ".join(
    [f"{c} array<string>" for c in ("vendorCode", "sku", "name", "price", "oldprice", "vendor", "categoryId", "stock_quantity", "description", "currencyId", "picture")]
    + ["`@id` string", "`@available` string", "param array<struct<`@name`: string, `@id`: string, `@valueid`: string, _VALUE: string>>"]
)
PARAMETERS = "array<struct<name:string,value:string,id:string,valueid:string>>"


def number(text: Column) -> Column:
    """A number with comma or point and with spaces, hard ones too; null if it is none."""
    return F.replace(F.regexp_replace(text, "[  ]", ""), F.lit(","), F.lit(".")).try_cast("double")


def read_legacy_csv(spark: SparkSession, path: str) -> DataFrame:
    """The older catalogue from CSV: code, category, sku, name, price, old_price, availability, brand, description, pictures
    and parameters. Columns go by their place, so headers may repeat: the first of a name counts, of parameters all that
    have a value. The separator is that of ; tab and comma which the head of the file has most often."""
    head = spark.read.text(path).limit(50).agg(F.array_join(F.collect_list("value"), "\n").alias("v")).first().v[:SNIFFED].lstrip("﻿")
    best = max(";\t,", key=head.count)
    sep = best if best in head else ";"
    # A byte order mark goes; further columns than the first row has are left out.
    first = spark.read.csv(path, sep=sep, header=False, multiLine=True, escape='"', inferSchema=False)
    if not first.columns:
        raise ValueError(f"Empty catalogue: {path}")
    names = [(x or "").lstrip("﻿").strip() for x in first.first()]
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    rows = spark.read.schema(schema).csv(path, sep=sep, header=True, enforceSchema=True, multiLine=True, escape='"')
    text = lambda i: F.trim(F.coalesce(F.col(f"c{i}"), F.lit("")))
    named = {k: text(names.index(h)) if h in names else F.lit("") for k, h in LEGACY_HEADERS.items()}
    given = [text(i) for i, n in enumerate(names) if n == LEGACY_PARAMETER]
    values = F.filter(F.array(*given), lambda v: v != "") if given else F.array().cast("array<string>")
    none = F.lit("").alias("name"), F.lit("").alias("id"), F.lit("").alias("valueid")
    parameters = F.transform(values, lambda v: F.struct(none[0], v.alias("value"), *none[1:])).cast(PARAMETERS)
    return rows.select(*[(number(c) if k in ("price", "old_price") else c).alias(k) for k, c in named.items()], parameters.alias("parameters"))


def read_legacy_feed(spark: SparkSession, path: str) -> DataFrame:
    """The older catalogue from a feed: as read_legacy_csv, with category_id and currency, and the category's whole path. The code
    of a maker is taken as it is written. Availability is the stock's number, else 1 or 0. Elements that repeat count
    once, but for pictures and parameters; a category that isn't there has no path."""
    schema = "`@id` string, `@parentId` string, _VALUE string"
    read = lambda tag, fields: spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "@").schema(fields).load(path)
    categories = read("category", schema).select(F.trim("`@id`").alias("id"), F.trim("`@parentId`").alias("parent"), F.trim("_VALUE").alias("name")).filter("id <> ''")
    known = hierarchy.paths(categories.withColumn("parent", F.nullif("parent", F.lit("")))).select(F.col("id").alias("category_id"), F.col("path").alias("category"))
    text = lambda c: F.trim(F.coalesce(F.get(F.col(c), F.lit(0)), F.lit("")))
    offers, own = read("offer", _FEED_OFFER), F.lower(F.trim(F.coalesce(F.col("`@available`"), F.lit(""))))
    value = lambda p, c: F.trim(F.coalesce(p[c], F.lit("")))
    parameters = F.filter(F.transform(F.coalesce("param", F.array()), lambda p: F.struct(value(p, "@name").alias("name"), value(p, "_VALUE").alias("value"), value(p, "@id").alias("id"), value(p, "@valueid").alias("valueid"))), lambda p: p["value"] != "")
    rows = offers.select(
        F.trim(F.coalesce(F.col("`@id`"), F.lit(""))).alias("code"), text("categoryId").alias("category_id"), F.coalesce(F.nullif(text("vendorCode"), F.lit("")), text("sku")).alias("sku"), text("name").alias("name"),
        number(text("price")).alias("price"), number(text("oldprice")).alias("old_price"), F.coalesce(F.nullif(text("stock_quantity"), F.lit("")), F.when(own.isin("true", "1", "yes"), "1").otherwise("0")).alias("availability"),
        text("vendor").alias("brand"), text("description").alias("description"), F.filter(F.transform(F.coalesce("picture", F.array().cast("array<string>")), F.trim), lambda p: p != "").alias("pictures"), parameters.alias("parameters"),
        F.coalesce(F.nullif(text("currencyId"), F.lit("")), F.lit("UAH")).alias("currency"),
    )
    return rows.join(known, "category_id", "left").withColumn("category", F.coalesce("category", F.lit("")))
