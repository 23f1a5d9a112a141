"""Findings of the third review, each on the least rows that showed it."""


import random

import duckdb
import pytest
from pyspark.sql import functions as F

from marketloom.functions import folding, scalars
from marketloom.operators import linkage, market, pages, variants
from marketloom.plans import identity, report
from marketloom.sources import tables


def parts_below(spark, tmp_path, least, most):
    """The test tables' directory with a part table of our own keys."""
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").limit(20)
    part.withColumn("p_partkey", F.col("p_partkey") % (most - least) + least).dropDuplicates(["p_partkey"]).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


def test_text_scalars_is_its_sql_for_long_keys(spark, tmp_path):
    folder = parts_below(spark, tmp_path, 9_995, 10_010)
    own = {r.article: r.named for r in report.text_scalars(spark, folder).collect()}
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet/*.parquet'")
    assert own and max(own) >= 10_000 and own == dict(connection.execute(f"SELECT article, named FROM ({report.QUERIES[report.text_scalars]})").fetchall())


@pytest.mark.parametrize("least", [8_990, 998_990, 7_199_990])
def test_variant_conflicts_is_its_sql_for_long_keys(spark, tmp_path, least):
    """Model numbers of seven digits make tokens of nine letters, which the reference's rule for families leaves out."""
    folder = parts_below(spark, tmp_path, least, least + 20)
    own = sorted(map(tuple, identity.variant_conflicts(spark, folder).collect()))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet/*.parquet'")
    assert len(own) == 200 and own == sorted(connection.execute(identity.QUERIES[identity.variant_conflicts]).fetchall())


def test_long_tokens_tell_no_family_of_themselves(spark):
    rows = spark.createDataFrame([("Acme SM-1000000", "Acme SM-1000001")], "source string, title string")
    told = lambda **more: [c.rule for c in variants.compared(rows, **more).first().variant_conflicts]
    assert told() == ["model family", "product core"] and told(family_length=None) == ["model family", "product family"]


@pytest.mark.parametrize("value", [1224.725, 1.005, 2.675, -1.005, -2.675, 0.285, 10.0, 122472.5])
def test_rounding_is_that_of_the_sql(spark, value):
    expected = duckdb.connect().execute("SELECT round(?::DOUBLE, 2)", [value]).fetchone()[0]
    assert spark.range(1).select(scalars.rounded(F.lit(value), 2)).first()[0] == expected


@pytest.mark.parametrize("made", [tables.mixed_titles, tables.title_candidates, tables.variant_titles, tables.candidates, tables.nested_pages])
def test_work_on_few_products_is_spread(spark, made):
    """The table of products is one split, whatever comes of it."""
    assert spark.read.parquet("/root/testdata/sf0.001/part.parquet").rdd.getNumPartitions() == 1
    assert made(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4


def test_a_value_bound_is_computed_once_for_all_elements(spark):
    """A split within a function over its own words would be made anew for each word."""
    for query in (identity.folded_titles, identity.title_matches, identity.variant_conflicts):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert len(plan) < 200_000, (query.__name__, len(plan))
    row = spark.createDataFrame([("a b a",)], "t string").select(folding.let(F.split("t", " "), lambda w: F.filter(w, lambda x, i: F.array_position(w, x) == i + 1))).first()
    assert row[0] == ["a", "b"]


def test_folding_where_scripts_meet_only_across_digits_and_joints(spark):
    texts = ["A1В", "В12A", "a-1.В", "к/7x", "a в", "1В 2A", "abc", "я1a", "А1.b2"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(folding.fold(F.col("t"))).collect()]
    assert got == ["a1b", "b12a", "a-1.b", "k/7x", "a в", "1в 2a", "abc", "я1a", "a1.b2"]


def test_linkage_sends_no_words_to_all(spark):
    """By the sizes of small files Spark would collect every offer's words on the driver."""
    plan = identity.linked_offers(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_outliers_take_one_sort(spark):
    """A count by product and ranks by price had a sort each, at once in one task."""
    offers, missions = tables.offers(spark, "/root/testdata/sf0.001"), tables.missions(spark, "/root/testdata/sf0.001")
    plan = market.flag_outliers(offers, missions)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Union")]
    assert above.count("Sort [") == 1 and above.count("Window [") == 2


@pytest.mark.parametrize("hot", [0, 1, 3, 50])
def test_blocks_of_up_to_four_words_lose_no_pair(spark, hot):
    rng = random.Random(7)
    texts = [(i, " ".join(rng.sample(["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "theta", "iota"], rng.randrange(1, 8)))) for i in range(60)]
    rows = spark.createDataFrame(texts, "id int, words string")
    got = sorted((r.product, r.offer) for r in linkage.linked(rows, rows, "id", "words", "id", "words", least=0.75, hot=hot).collect())
    sets = {i: set(t.split()) for i, t in texts}
    assert got == sorted((a, b) for a in sets for b in sets if len(sets[a] & sets[b]) >= 0.75 * len(sets[a]))


@pytest.mark.parametrize("hot", [0, 2, 4, 12, 500])
def test_rare_words_beside_repeated_sets_lose_no_pair(spark, hot):
    """Codes of a few offers beside words of many, more codes than marks; a word that no offer or no product has, and empty texts."""
    rng = random.Random(11)
    text = lambda i, other: " ".join([*rng.sample(["alpha", "beta", "gamma", "delta"], 3), *rng.sample([f"code{i // 4}", f"kind{i % 9}", f"size{i % 40}", other], rng.randrange(0, 5))])
    mine, theirs = [[(i, text(rng.randrange(400), other)) for i in range(160)] + [(900, None), (901, "ab c")] for other in ("bought", "sold")]
    products, offers = (spark.createDataFrame(rows, "id int, words string") for rows in (mine, theirs))
    got = sorted(map(tuple, linkage.linked(products, offers, "id", "words", "id", "words", least=0.6, hot=hot, digits=3).collect()))
    a, b = ({i: {w for w in t.split() if len(w) >= 3} for i, t in rows if t} for rows in (mine, theirs))
    assert got == sorted((i, k, round(len(a[i] & b[k]) / len(a[i]), 3)) for i in a for k in b if a[i] and len(a[i] & b[k]) >= 0.6 * len(a[i]))


def test_linked_offers_compares_repeated_words_once(spark, tmp_path, monkeypatch):
    """Pairs grow with the square of the table; the sets of words that are compared don't grow with its copies."""
    part, sets = spark.read.parquet("/root/testdata/sf0.001/part.parquet").limit(40), []
    for copies in (8, 32):
        folder = tmp_path / str(copies)
        more = part.withColumn("p_size", F.lit(1)).crossJoin(spark.range(copies)).withColumn("p_partkey", F.col("p_partkey") + 1_000 * F.col("id")).drop("id")
        more.coalesce(1).write.parquet(str(folder / "part.parquet"))
        met = linkage.met
        with monkeypatch.context() as patched:
            patched.setattr(linkage, "met", lambda own, other, hot: sets.append((own.count(), other.count())) or met(own, other, hot))
            rows = identity.linked_offers(spark, str(folder)).count()
        connection = duckdb.connect()
        connection.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet/*.parquet'")
        assert rows == connection.execute(f"SELECT count(*) FROM ({identity.QUERIES[identity.linked_offers]})").fetchone()[0]
    assert len(sets) == 2 and 0 < max(sets[1]) <= 2 * 40


def test_prices_of_a_page_are_looked_for_once(spark):
    text = "Ціна 1 200 грн. " + "слово " * 20 + "платіж 300 грн"
    found = spark.createDataFrame([(text,)], "t string").repartition(1).select(pages.named_prices(F.col("t")).alias("x"))
    assert found._jdf.queryExecution().analyzed().toString().count("₴") == 1
    assert found.first().x == [1200]
