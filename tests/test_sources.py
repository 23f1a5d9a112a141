from marketloom.functions import scalars
from marketloom.sources import catalog, sinks
from marketloom.streaming import state
from pyspark.sql import functions as F


def test_csv_catalogue(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text('Артикул;Назва;Ціна;Price\nA1;"Дриль; ударний";100;7\n;Пила;;8\nA3;;5;\n', encoding="utf-8")
    got = {r.name: r for r in catalog.read(spark, str(path)).collect()}
    assert set(got) == {"Дриль; ударний", "Пила"}
    assert (got["Дриль; ударний"].article, got["Дриль; ударний"].own_price) == ("A1", "100")
    assert got["Пила"].article.startswith("ROW-") and got["Пила"].own_price == "8" and got["Пила"].brand is None


def test_csv_in_cp1251_with_commas(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_bytes("Артикул,Название\nА1,Насос\n".encode("cp1251"))
    assert [(r.article, r.name) for r in catalog.read(spark, str(path)).collect()] == [("А1", "Насос")]


def test_feed(spark, tmp_path):
    path = tmp_path / "feed.xml"
    path.write_text('<yml_catalog><shop><offers><offer id="1" sku="S1"><name>Pump</name><price>10</price></offer><offer id="2"><name>Saw</name><vendorCode>V2</vendorCode></offer></offers></shop></yml_catalog>')
    got = sorted((r.article, r.name, r.own_price) for r in catalog.read(spark, str(path)).collect())
    assert got == [("S1", "Pump", "10"), ("V2", "Saw", None)]


def test_sinks(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "id int, t string"), spark.createDataFrame([(2, 3)], "id int, ts int")
    both = sinks.schema_union(a, b)
    assert both.columns == ["id", "t", "ts"] and both.count() == 2
    sinks.write_csv(both, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True, sep=";").count() == 2
    rows = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("l", None, "only")], "k string, ts int, v string")
    assert sorted(r.v for r in sinks.upserted(rows, ["k"], "ts").collect()) == ["new", "only"]


def test_streams_equal_batch(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(source)
    (tmp_path / "in").mkdir()
    batch.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    for build, name in ((state.current_state, "states"), (state.admitted_per_window, "windows")):
        q = build(stream).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert sorted(map(str, spark.table(name).collect())) == sorted(map(str, build(batch).collect()))


def test_currency_codes(spark):
    texts = [None, "", "грн.", "₴", "hua", "$", "us$", "€", "pln"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(scalars.currency_code(F.col("t"))).collect()
    assert [r[0] for r in got] == ["UAH"] * 5 + ["USD", "USD", "EUR", "PLN"]
