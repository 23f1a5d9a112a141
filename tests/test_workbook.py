"""Workbooks: round trips, sheets and ranges of rows, shared texts, and headers below other rows."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from marketloom.sources import workbook


def test_round_trip_by_sheet_and_range(spark, tmp_path):
    workbook.register(spark)
    offers = spark.range(2_500).select("id", F.concat(F.lit("назва <&> \" ' "), "id").alias("name"), F.when(F.col("id") % 3 > 0, F.col("id") / 4).alias("price"))
    sheets = {"Результат": offers.limit(0), "Пропозиції": offers, "a/b:c": spark.createDataFrame([("x\x01\ny", None)], "t string, `u.v` string")}
    workbook.write_sheets(sheets, str(tmp_path / "report"))
    files = os.listdir(tmp_path / "report")
    assert len([f for f in files if f.endswith(".xlsx")]) == 1
    back = spark.read.format("workbook").load(str(tmp_path / "report"))
    assert {(r.sheet, r["count"]) for r in back.groupBy("sheet").count().collect()} == {("Результат", 1), ("Пропозиції", 2_501), ("a b c", 2)}
    got = {tuple(r.cells) for r in back.filter("sheet = 'Пропозиції' and row > 1").collect()}
    assert got == {tuple(r) for r in offers.select(*[F.col(c).cast("string") for c in offers.columns]).collect()}
    assert [r.cells for r in back.filter("sheet = 'a b c'").orderBy("row").collect()] == [["t", "u.v"], ["x \ny", None]]
    workbook.write_sheets({"neu": offers.limit(5)}, str(tmp_path / "report"))  # overwrites
    assert spark.read.format("workbook").load(str(tmp_path / "report")).count() == 6


def test_each_task_writes_a_workbook_and_failures_leave_none(spark, tmp_path):
    workbook.register(spark)
    rows = spark.range(1_000).repartition(3).select(F.lit("s").alias("sheet"), F.array(F.col("id").cast("string")).alias("cells"))
    folder = str(tmp_path / "parts")
    rows.write.format("workbook").mode("append").save(folder)
    assert len([f for f in os.listdir(folder) if f.endswith(".xlsx")]) == 3
    back = spark.read.format("workbook").load(folder)
    assert sorted(int(r.cells[0]) for r in back.collect()) == list(range(1_000))
    bad = rows.withColumn("cells", F.when(F.col("cells")[0] == "700", F.array(F.raise_error(F.lit("no")))).otherwise(F.col("cells")))
    with pytest.raises(Exception, match="no"):
        bad.write.format("workbook").mode("append").save(str(tmp_path / "failed"))
    assert not [f for _, _, names in os.walk(tmp_path / "failed") for f in names if f.startswith("part-")]


def test_missions_of_a_workbook_by_other_programs(spark, tmp_path):
    """Shared texts, a stated dimension, rows without numbers, gaps, booleans and errors; the header is in the third row."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    texts = ["Прайс", "Артикул", "Назва", "Бренд", "Дриль", "Polax"]
    cells = lambda r, *c: f'<row r="{r}">' + "".join(c) + "</row>"
    s = lambda ref, n: f'<c r="{ref}" t="s"><v>{n}</v></c>'
    rows = cells(1, s("B1", 0)) + cells(3, s("A3", 1), s("C3", 2), s("D3", 3)) + cells(4, '<c r="A4"><v>35005</v></c>', s("C4", 4), s("D4", 5), '<c r="E4" t="b"><v>1</v></c>')
    rows += cells(5, '<c r="A5" t="e"><v>#N/A</v></c>', '<c r="C5" t="str"><f>x</f><v>Пила</v></c>') + cells(7, s("A7", 5))
    path = tmp_path / "book.xlsx"
    with zipfile.ZipFile(path, "w") as book:
        workbook.WorkbookWriter._frame(book, ["Лист1"])
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si><r><t>{t[:2]}</t></r><r><t>{t[2:]}</t></r></si>" for t in texts) + "</sst>")
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><dimension ref="A1:E7"/><sheetData>{rows}</sheetData></worksheet>')
    got = workbook.read_missions(spark, str(path), rows=2).orderBy("name").collect()
    assert [(r.article[:4], r.name, r.brand) for r in got] == [("3500", "Дриль", "Polax"), ("ROW-", "Пила", None)]
    workbook.register(spark)
    assert spark.read.format("workbook").option("rows", 2).load(str(path)).rdd.getNumPartitions() == 4
