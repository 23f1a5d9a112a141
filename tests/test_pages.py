"""Products of pages: where JSON-LD may hide them, the order of attributes, and prices that are monthly payments."""

from pyspark.sql import functions as F

from marketloom.operators import pages

LD = '<script type="application/ld+json">{}</script>'
CASES = [
    (LD.format('[{"@graph":[{"@type":"Offer"},{"@type":"PRODUCT","name":"a","offers":{"price":"12,50","availability":"InStock"}}]}]'), ("a", 12.5, "IN_STOCK", "jsonld")),
    ("<SCRIPT id=1 TYPE='application/ld+json' defer>" + '{"x":[[{"y":{"@type":["Product"],"name":"deep","offers":[{"price":9},{"price":"7"},{"price":""}]}}]]}</SCRIPT>', ("deep", 7.0, "UNKNOWN", "jsonld")),
    (LD.format('{"@type":"Product","name":"first","offers":{"price":5}}') + LD.format('{"@type":"Product","name":"second","offers":{"price":4}}'), ("first", 5.0, "UNKNOWN", "jsonld")),
    (LD.format('[{"@type":"Product","name":"one","offers":{"price":5}},{"@type":"Product","name":"last","offers":{"price":4}}]'), ("last", 4.0, "UNKNOWN", "jsonld")),
    (LD.format('{"@type":"Product","name":"outer","offers":{"price":5},"isRelatedTo":{"@type":"Product","name":"inner","offers":{"price":1}}}'), ("outer", 5.0, "UNKNOWN", "jsonld")),
    (LD.format("{broken") + "<meta content='1 299.00' property='product:price:amount'><meta itemprop='availability' content='sold out'>", ("", 1299.0, "OUT_OF_STOCK", "meta")),
    ('<title>t</title><script>' + '{"sku":"1234567890","price":"150"} {"price":"150"} {"price":"99 999"}' + '</script>', ("t", 150.0, "UNKNOWN", "embedded_json")),
    ('<script>{"price":"150"}</script>', ("", None, "UNKNOWN", "none")),  # too short to be a page's state
    ("<p>Оплата частинами: 250 грн/міс</p>" + "<p>-</p>" * 30 + "<b>Ціна: 12 500 ₴</b> <i>В наявності</i>", ("", 12500.0, "IN_STOCK", "text")), ("<p>платіж 500 грн</p>", ("", None, "UNKNOWN", "none")),
    ("ціна 12.500 грн", ("", 12.5, "UNKNOWN", "text")), ("<style>100 грн</style><script>200 грн</script>", ("", None, "UNKNOWN", "none")), ("", ("", None, "UNKNOWN", "none")), (None, ("", None, "UNKNOWN", "none")),
    ('<meta name="twitter:title" content="tw"><meta content="og" property="og:title"><title>x</title>', ("og", None, "UNKNOWN", "none")),
]


def test_pages_by_every_step(spark):
    rows = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(CASES)], "page int, html string").withColumn("x.y", F.lit(1)).withColumn("v", F.lit(2))
    got = {r.page: (r.title, r.price, r.availability, r.origin) for r in pages.extracted(rows).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}
    assert pages.extracted(rows.filter("page < 0")).count() == 0
