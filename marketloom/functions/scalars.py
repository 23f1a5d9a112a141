"""Scalar functions on columns: numbers, currencies, availability, URLs and keys. All but the
entities of HTML are built-in expressions."""

from __future__ import annotations

import html

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Spellings of currencies.
CURRENCIES = {"UAH": ["", "UAH", "ГРН", "₴", "HUA"], "USD": ["USD", "$", "US$"], "EUR": ["EUR", "€"]}
# Query parameters that only track visitors, besides all that begin with utm_.
TRACKING = ["fbclid", "gclid", "rsltid", "sa", "source", "srsltid", "ved"]
# Phrases that say whether a product can be bought.
OUT_OF_STOCK = [
    "discontinued", "out of stock", "outofstock", "sold out", "soldout", "відсутній", "закінчився", "недоступний", "немає в наявності",
    "закончился", "не доступен", "нет в наличии", "отсутствует",
]
IN_STOCK = [
    "available", "in stock", "instock", "в наявності", "відвантаження зі складу", "відправка зі складу", "готовий до відправки",
    "готово до відправки", "доступний", "є в наявності", "в наличии", "готов к отправке", "доступен", "есть в наличии", "отгрузка со склада",
]


def parse_number(text: Column) -> Column:
    """A number with comma or point and spaces between digits; null if it is none."""
    return F.regexp_replace(F.regexp_replace(text, "[\\s ]", ""), ",", ".").try_cast("double")


def parse_positive(text: Column) -> Column:
    """A number above 0 with comma or point and spaces; a hard space makes it none."""
    value = F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(value > 0, value)


def parse_page_price(text: Column) -> Column:
    """Digits, commas and points of a page's price; several points separate thousands."""
    kept = F.regexp_replace(F.regexp_replace(text, "[^0-9.,]", ""), ",", ".")
    value = F.when(F.regexp_count(kept, F.lit("[.]")) > 1, F.replace(kept, F.lit("."), F.lit(""))).otherwise(kept).try_cast("double")
    return F.when(value > 0, value)


def currency_code(text: Column) -> Column:
    """Upper-case code without points; other spellings of a code become it, nothing becomes UAH, unknown codes stay."""
    code = F.upper(F.replace(F.trim(F.coalesce(text, F.lit(""))), F.lit("."), F.lit("")))
    return F.coalesce(*[F.when(code.isin(spellings), name) for name, spellings in CURRENCIES.items()], code)


def rounded(value: Column, places: int) -> Column:
    """Half away from zero, of the product with the power of ten as SQL engines take it in doubles. Spark's own takes the
    shortest decimals that tell a double instead: 1224.725 is below the middle, yet becomes 1224.73."""
    return F.round(value * 10.0**places) / 10.0**places


def discount_percent(old: Column, now: Column) -> Column:
    return F.when((old > 0) & (old > now), F.round((old - now) / old * 100, 2))


def availability_state(text: Column) -> Column:
    """By phrases in the text or in its words alone; phrases for sold-out come first."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    bare = F.regexp_replace(low, "[^a-zа-яіїєґ0-9]+", " ")
    says = lambda phrases: low.rlike("|".join(phrases)) | bare.rlike("|".join(phrases))
    return F.when(says(OUT_OF_STOCK), "OUT_OF_STOCK").when(says(IN_STOCK), "IN_STOCK").otherwise("UNKNOWN")


def host(url: Column) -> Column:
    """Lower-case host without www. and port."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, "^[a-zA-Z]+://([^/?#:]+)", 1)), "^www[.]", "")


def canonical_url(url: Column) -> Column:
    """Without fragment and tracking parameters; lower-case scheme and host. Other parameters stay in their order; what
    is no URL stays as it is."""
    head = F.lower(F.regexp_extract(url, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1))
    path = F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    name = lambda pair: F.lower(F.substring_index(pair, "=", 1))
    pairs = F.filter(F.split(F.regexp_extract(url, "^[^?#]*[?]([^#]*)", 1), "&"), lambda x: (x != "") & ~name(x).startswith("utm_") & ~name(x).isin(TRACKING))
    return F.when(head == "", url).otherwise(F.concat(head, path, F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise("")))


def page_url(url: Column) -> Column:
    """https, lower-case host and path alone; null if it isn't http or has no path."""
    host_ = F.lower(F.regexp_extract(url, "(?i)^https?://([^/?#]+)", 1))
    path = F.regexp_extract(url, "(?i)^https?://[^/?#]+(/[^?#]*)", 1)
    return F.when((host_ != "") & ~path.isin("", "/"), F.concat(F.lit("https://"), host_, path))


def offer_key(domain: Column, url: Column) -> Column:
    """What tells an offer of a marketplace from others: its number there or its path, without language prefix."""
    path = F.regexp_extract(url, "^[a-zA-Z]+://[^/?#]+([^?#]*)", 1)
    norm = F.lower(F.regexp_replace(F.regexp_replace(path, "(?i)^/(ua|ru)/", "/"), "/+$", ""))
    rozetka, prom = F.regexp_extract(path, "(?i)/p([0-9]+)(?:/|$)", 1), F.regexp_extract(path, "(?i)/(?:ua/)?(m-?[0-9]+|p[0-9]+)(?:-|/|$)", 1)
    return (
        F.when((domain == "rozetka.com.ua") & (rozetka != ""), F.concat(F.lit("rozetka:p"), rozetka))
        .when((domain == "prom.ua") & (prom != ""), F.concat(F.lit("prom:"), F.replace(F.lower(prom), F.lit("-"), F.lit(""))))
        .when((domain == "epicentrk.ua") & norm.endswith(".html"), F.concat(F.lit("epicentr:"), norm))
        .when((domain == "hotline.ua") & norm.contains("/computer-monitory/"), F.concat(F.lit("hotline:"), norm))
        .otherwise(F.concat(F.regexp_replace(F.lower(F.regexp_extract(url, "^[a-zA-Z]+://([^/]+)", 1)), "^www[.]", ""), F.lit(":"), norm))
    )


# Parts of paths that lead to lists, not to products.
LISTS = ["/blog/", "/catalog", "/categories", "/category", "/filter", "/fs/", "/search"]


def is_product_url(domain: Column, url: Column) -> Column:
    path = F.lower(F.regexp_extract(url, "^[a-zA-Z]+://[^/?#]+([^?#]*)", 1))
    return (
        F.when(domain == "rozetka.com.ua", path.rlike("/p[0-9]+/?$"))
        .when(domain == "prom.ua", path.rlike("/(?:ua/)?(?:m-?[0-9]+|p[0-9]+)(?:-|/|$)"))
        .when(domain == "epicentrk.ua", path.contains("/shop/") & path.endswith(".html") & ~path.contains("/fs/"))
        .when(domain == "hotline.ua", path.contains("/computer-monitory/") & ~path.contains("/computer/monitory/"))
        .otherwise(~path.rlike("|".join(LISTS)))
    )


def unwrapped(url: Column) -> Column:
    """The target of a search engine's redirect; other URLs stay."""
    target = F.regexp_extract(url, "[?&]uddg=([^&#]+)", 1)
    return F.when(url.rlike("//(?:[a-z.]*[.])?duckduckgo[.]com/l/") & (target != ""), F.url_decode(target)).otherwise(url)


def price_in_text(text: Column) -> Column:
    """The first price in hryvnias that a text names. Thousands may be apart by space, point or comma; a single point or comma
    counts as that of a decimal, as in pages' prices."""
    amount = F.regexp_extract(text, "(?iU)(?<![0-9])([0-9]{1,3}(?:[\\s\u00a0.,][0-9]{3})+|[0-9]{2,7})(?:[.,][0-9]{1,2})?\\s*(?:грн|₴|uah)", 1)
    return parse_page_price(F.nullif(amount, F.lit("")))


def decimal_price(text: Column) -> Column:
    """Digits and points alone, as a decimal above 0; null if there are several points."""
    value = F.regexp_replace(text, "[^0-9.]", "").try_cast("decimal(18,2)")
    return F.when(value > 0, value)


@F.arrow_udf(StringType())
def unescaped(text: pa.Array) -> pa.Array:
    """Entities of HTML resolved, all that there are."""
    return pa.array([t if t is None or "&" not in t else html.unescape(t) for t in text.to_pylist()], pa.string())


def clean_text(text: Column) -> Column:
    """Entities resolved, white space collapsed."""
    return F.trim(F.regexp_replace(unescaped(text), "(?U)\\s+", " "))


def strip_html(text: Column) -> Column:
    """A page's text: entities resolved, block ends as line ends, tags dropped, at most one blank line."""
    lines = F.regexp_replace(unescaped(text), "(?i)<br\\s*/?>|</(?:p|div|li|h[1-6])>", "\n")
    lines = F.regexp_replace(F.regexp_replace(lines, "<[^>]+>", ""), "\n{3,}", "\n\n")
    return F.regexp_replace(lines, "(?U)^\\s+|\\s+$", "")


def title_signature(title: Column) -> Column:
    """Lower-case words of a title without a closing bracket and the word for monitor."""
    bare = F.regexp_replace(F.lower(title), "\\s*[(][^)]*[)]\\s*$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "монітор|монитор", " "), "[^0-9a-zа-яіїєґ]+", " "))


def search_title(title: Column) -> Column:
    """A title for a search: short bracketed parts dropped, at most 14 words of two characters or more."""
    bare = F.regexp_replace(F.regexp_replace(title, "[(][^)]{0,80}[)]", " "), "\\[[^\\]]{0,80}\\]", " ")
    bare = F.regexp_replace(bare, '[^0-9A-Za-zА-Яа-яІіЇїЄєҐґ+._/"×-]+', " ")
    return F.array_join(F.slice(F.filter(F.split(F.trim(bare), " +"), lambda w: F.length(w) > 1), 1, 14), " ")


def safe_query(query: Column) -> Column:
    """A query without site restriction, excluded words and phrases, and quotes of any kind."""
    bare = F.trim(F.regexp_replace(query, "(?U)\\s+", " "))
    for gone in ("(?i)(?:^|\\s)site:[^\\s]+", '(?:^|\\s)-["“”][^"“”]+["“”]', "(?:^|\\s)-[^\\s]+", '["“”`]'):
        bare = F.regexp_replace(bare, gone, " ")
    return F.trim(F.regexp_replace(bare, "(?U)\\s+", " "))


def query_identifier(query: Column) -> Column:
    """The quoted phrase of a query, else its first word."""
    quoted = F.regexp_extract(query, '"([^"]+)"', 1)
    return F.when(quoted != "", quoted).otherwise(F.substring_index(F.trim(query), " ", 1))


def sku_variants(sku: Column) -> Column:
    """A number as it is and without leading zeros if three digits remain; anything else as it is; nothing of nothing."""
    own = F.trim(F.coalesce(sku, F.lit("")))
    bare = F.regexp_replace(own, "^0+", "")
    some = F.array_distinct(F.when(own.rlike("^[0-9]+$") & (F.length(bare) >= 3), F.array(own, bare)).otherwise(F.array(own)))
    return F.when(own == "", F.array().cast("array<string>")).otherwise(some)


def strong_identifier(compact: Column) -> Column:
    """Whether a lower-case identifier without separators is one of its own: no year and no dimensions."""
    odd = compact.rlike("^(?:19|20)[0-9]{2}$") | compact.rlike("^[0-9]{1,4}x[0-9]{1,4}(?:x[0-9]{1,4})?(?:mm|cm)?$")
    mixed = (F.length(compact) >= 7) & (F.regexp_count(compact, F.lit("[a-zа-яіїє]")) >= 2) & (F.regexp_count(compact, F.lit("[0-9]")) >= 2)
    return F.when((compact == "") | odd, False).when(compact.rlike("^[0-9]+$"), F.length(compact) >= 8).otherwise(mixed)


def page_title(page: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(page, "(?is)<title[^>]*>(.*?)</title>", 1), "\\s+", " "))


def price_text(price: Column) -> Column:
    """Two decimals, closing zeros dropped."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.2f", price), "0+$", ""), "[.]$", "")


def identity_key(*parts: Column) -> Column:
    """SHA-256 of the lower-case parts with a separator that they don't hold; a missing part is none like an empty one."""
    told = [F.coalesce(F.concat(F.lit("="), F.lower(F.trim(p.cast("string")))), F.lit("-")) for p in parts]
    return F.sha2(F.concat_ws("\u001f", *told), 256)
