"""Text functions on texts that the test tables lack."""

from pyspark.sql import functions as F

from marketloom.functions import scalars


def test_text_functions_on_awkward_texts(spark):
    cases = [
        (scalars.strip_html, [("a &amp; b<br/>c</p>\n\n\n<b>d</b>&nbsp;", "a & b\nc\n\nd"), ("&eacute;&hellip;", "é…"), ("", ""), (None, None)]), (scalars.clean_text, [("x&nbsp;&nbsp;y &laquo;z&raquo; &#8364;", "x y «z» €")]),
        (scalars.search_title, [('A_B "x1" 2×3 (old) [new] y', 'A_B "x1" 2×3'), ("(" + "a" * 90 + ") bb", "a" * 90 + " bb")]),
        (scalars.safe_query, [('drill -"foo bar" site:x.ua -used “new”', "drill new"), ("site:a.ua", ""), ("a-b -c", "a-b"), ("`q`", "q")]),
        (scalars.sku_variants, [("", []), (None, []), ("000123", ["000123", "123"]), ("0012", ["0012"]), ("a01", ["a01"]), (" 0700 ", ["0700", "700"])]),
        (scalars.price_in_text, [("ціна 12.500 грн", 12.5), ("12,500 грн", 12.5), ("12 500,00 UAH", 12500.0), ("1.234.567 ₴", 1234567.0), ("no price", None), ("1234567890 грн", None), ("від 95грн", 95.0)]),
        (scalars.parse_positive, [("1 234,5", 1234.5), ("1 234", None), ("-1", None), ("x", None), ("0", None)]),
    ]
    for make, pairs in cases:
        rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(pairs)], "i int, t string").orderBy("i").select(make(F.col("t"))).collect()
        assert [r[0] for r in rows] == [w for _, w in pairs], make.__name__
