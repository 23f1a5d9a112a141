"""The older catalogue from CSV with repeated headers and from feeds with category paths."""

from marketloom.sources import catalog


def test_csv_with_repeated_headers(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('﻿Артикул;Название;Цена;Параметр;Параметр;Старая цена;Название\nA-1;"Дриль; 500\nВт";"1 234,50";червоний;;2 000;інша\n;Пила;-;  ; x ;;\n', encoding="utf-8")
    got = catalog.read_legacy_csv(spark, str(path)).orderBy("name").collect()
    assert [(r.sku, r.name, r.price, r.old_price, [p.value for p in r.parameters], r.brand) for r in got] == [("A-1", "Дриль; 500\nВт", 1234.5, 2000.0, ["червоний"], ""), ("", "Пила", None, None, ["x"], "")]


def test_feed_with_paths_codes_and_stock(spark, tmp_path):
    path = tmp_path / "a.yml"
    path.write_text("""<yml_catalog><shop><categories><category id="1">Дім</category><category id="2" parentId="1"> Кухня </category><category id="3" parentId="2">Ножі</category><category id="4" parentId="4">Само</category></categories><offers>
      <offer id="10" available="true"><name>Ніж</name><vendorCode> 007-a </vendorCode><sku>x</sku><price>1 299,5</price><categoryId>3</categoryId><picture>u1</picture><picture>u2</picture><param name="Колір" id="5">чорний</param><param name="Пусто"></param></offer>
      <offer id="11" available="no"><name>Стіл</name><sku>s-1</sku><price>x</price><oldprice>20</oldprice><categoryId>9</categoryId><stock_quantity>7</stock_quantity><vendor>V</vendor><currencyId>USD</currencyId></offer>
      <offer id="12"><name>Сам</name><categoryId>4</categoryId></offer></offers></shop></yml_catalog>""", encoding="utf-8")  # fmt: skip
    got = {r.code: r for r in catalog.read_legacy_feed(spark, str(path)).collect()}
    assert [(got[i].category, got[i].sku, got[i].price, got[i].old_price, got[i].availability, got[i].brand, got[i].currency) for i in ("10", "11", "12")] == [
        ("Дім / Кухня / Ножі", "007-a", 1299.5, None, "1", "", "UAH"), ("", "s-1", None, 20.0, "7", "V", "USD"), ("Само", "", None, None, "0", "", "UAH"),
    ]
    assert got["10"].pictures == ["u1", "u2"] and [(p.name, p.value, p.id) for p in got["10"].parameters] == [("Колір", "чорний", "5")] and got["11"].parameters == []
