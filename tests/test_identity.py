"""Folding, patterns, the older matcher and variants of products, by worked vectors and plain programs."""

import random

import pytest
from pyspark.sql import functions as F

from marketloom.functions import folding, similarity
from marketloom.operators import hierarchy, linkage, matching, title_match, variants


def values(spark, make, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("t"))).collect()]


FOLDED = {
    "1060-ТE-Р038BL": "1060-te-p038bl", "EPСС2614": "epcc2614", "LEB1-А123MG": "leb1-a123mg", "MВS-4708": "mbs-4708", "NІKE": "nike", "129 х 90": "129x90", "129 × 90": "129x90",
    "129x90": "129x90", "500Вт": "500вт", "3в1": "3в1", "ВТ6778": "вт6778", "Cеро-розовый": "cеро-розовый", "186Pj35Кофта": "186pj35кофта", "BZ-425.М": "bz-425.m",
    "OLS-PL-30.К": "ols-pl-30.k", "р.S": "р.s", "2100х900x600 мм": "2100x900x600 мм", "NІKE 129 х 90 EPСС2614": "nike 129x90 epcc2614", "a‑b\u00a0 c": "a-b c", None: "", "": "", "Straße ﬁt": "strasse fit",
}


def test_fold_vectors(spark):
    assert dict(zip(FOLDED, values(spark, folding.fold, FOLDED), strict=True)) == FOLDED


def test_fold_keeps_the_case_of_what_it_changes_only(spark):
    texts = {"Змішувач LEB1-А123MG": "Змішувач LEB1-A123MG", "Ортез EPСС2614 129 х 90": "Ортез EPCC2614 129x90", "XS/85АA": "XS/85AA", "Cеро-розовый": "Cеро-розовый"}
    assert dict(zip(texts, values(spark, folding.fold_cased, texts), strict=True)) == texts


@pytest.mark.parametrize(("code", "text", "found"), [
    ("EPCC2614", "Ортез EPСС2614", True), ("EPСС2614", "Ортез EPCC2614", True), ("MBS-4708", "Товар MВS-4708", True), ("MВS-4708", "Товар MBS 4708.", True), ("BZ-425.М", "Дорожка Abarqs BZ-425M Black", True),
    ("EPCC2614", "Ортез EPСС2615", False), ("EPCC2614", "XEPCC2614", False), ("EPCC2614", "EPCC26140", False), ("129x90", "рушник 129 × 90 см", True), ("129x90", "1129x90", False), ("", "x", False), ("a", None, False),
])
def test_patterns_find_identifiers_in_both_directions(spark, code, text, found):
    assert spark.createDataFrame([(code, text)], "c string, t string").select(folding.names(F.col("c"), F.col("t"))).first()[0] is found


def test_brand_families_and_language_variants(spark):
    assert values(spark, folding.brand_aliases, ["Redmi", " Dell ", None, "", "XІAOMI"]) == [["mi", "poco", "redmi", "xiaomi"], ["Dell"], [], [], ["mi", "poco", "redmi", "xiaomi"]]
    got = values(spark, folding.language_variants, ["Чорний  чохол X-1", "Черный", "plain", None, "пам'ять"])
    assert got == [["Чорний чохол X-1", "черный чехол X-1"], ["Черный", "чорний"], ["plain"], [], ["пам'ять", "память"]]


def plain_common(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        before = 0
        for j, b in enumerate(y, 1):
            before, row[j] = row[j], before + 1 if a == b else max(row[j], row[j - 1])
    return row[-1]


def plain_ratio(x, y):
    """By the definition: word sets, their shared words in order, and insertions and deletions between three joined texts."""
    a, b = set((x or "").split()), set((y or "").split())
    if not a or not b:
        return 0.0
    shared, rest_a, rest_b = (" ".join(sorted(s)) for s in (a & b, a - b, b - a))
    if shared and not (rest_a and rest_b):
        return 100.0
    full_a, full_b = (" ".join(filter(None, (shared, r))) for r in (rest_a, rest_b))
    alike = lambda s, t, distance: 100 - 100 * distance / (len(s) + len(t))
    found = [alike(full_a, full_b, len(rest_a) + len(rest_b) - 2 * plain_common(rest_a, rest_b))]
    if shared:
        found += [alike(shared, f, len(f) - len(shared)) for f in (full_a, full_b)]
    return max(found)


def test_common_lengths_are_a_dynamic_programme():
    rng = random.Random(11)
    word = lambda most, letters: "".join(rng.choice(letters) for _ in range(rng.randrange(most)))
    pairs = [(word(30, "abcdef "), word(30, "abcdef ")) for _ in range(8_000)] + [(word(130, "abйц𝒳 "), word(130, "abйц𝒳 ")) for _ in range(1_990)]
    pairs += [("", ""), ("", "a"), ("a" * 64, "a" * 64), ("a" * 65, "a" * 65), ("ab" * 32, "ba" * 32), ("a" * 64, "b"), ("b" * 63, "b" * 300), ("x" * 200, "y" * 200), ("ab" * 100, "a" * 70), ("q", "q")]
    assert similarity.common_lengths(pairs).tolist() == [plain_common(x, y) for x, y in pairs]


def test_token_set_ratio_is_its_definition(spark):
    rng = random.Random(5)
    words = ["mx-100k", "монитор", "dell", "черный", "144", "гц", "red", "widget", "a", "ab", "abc"]
    texts = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(7)))
    pairs = [(texts(), texts()) for _ in range(2_000)] + [(None, "a"), ("a", None), (" ", "a"), ("a a a", "a")]
    rows = spark.createDataFrame(pairs, "x string, y string").select("x", "y", similarity.token_set_ratio(F.col("x"), F.col("y")).alias("r")).collect()
    assert len(rows) == len(pairs) and all(abs(r.r - plain_ratio(r.x, r.y)) < 1e-9 for r in rows)


OFFER = "title string, brand string, sku string, params string, candidate_title string, candidate_url string, candidate_text string"


@pytest.mark.parametrize(("row", "status", "conflicts"), [
    (("Навушники Sony WH-1000XM5 Black", "Sony", "4548736132580", "", "Наушники Sony WH-1000XM5 чорний", "", ""), "EXACT", []),
    (("Монітор Dell 144 Гц", "Dell", "", "", "Монітор Dell 165Hz", "", ""), "CONFLICT", ["variant:144hz!=165hz"]),
    (("Монітор Dell 1920x1080", "Dell", "", "", "Монітор Dell", "", "2560 х 1440"), "CONFLICT", ["resolution:1920x1080!=2560x1440"]),
    (("Смартфон Xiaomi чорний 128 ГБ", "Xiaomi", "", "колір чорний", "Смартфон Redmi білий 128gb", "", ""), "CONFLICT", ["color:black!=white"]),
    (("Генератор Mast YH3000", "Mast", "18606", "", "Шеф кухонный нож Kanetsune", "https://x.ua/18606", ""), "POSSIBLE", []),
    (("Смартфон Xiaomi Redmi Note 12", "Xiaomi", "", "", "Смартфон Redmi Note 12", "", ""), "EXACT", []), ((None, None, None, None, None, None, None), "POSSIBLE", []),
])
def test_older_classifier(spark, row, status, conflicts):
    got = title_match.classified(spark.createDataFrame([row], OFFER).withColumn("key", F.lit(1))).first()
    assert (got.status, got.conflicts) == (status, conflicts)
    assert (got.score <= 89) or status in ("EXACT", "HIGH")
    assert ("models=" in got.reason) != bool(conflicts)


def walked(nodes):
    """Paths by walking from each node up."""
    table, out = {}, {}
    for i, up, name in nodes:
        if i is not None:
            table[i] = max(table.get(i, (False, None, "")), (up is not None, up, name or ""), key=lambda t: (t[0], t[1] if t[0] else 0, t[2]))
    for i in table:
        seen, parts, at = set(), [], i
        while at in table and at not in seen:
            seen.add(at)
            parts.append(table[at][2])
            at = table[at][1]
        out[i] = " / ".join(p for p in reversed(parts) if p)
    return out


def test_category_paths_of_chains_cycles_and_orphans(spark):
    """A chain of 1,000, cycles of several lengths with tails into them, unknown parents, repeated and missing ids."""
    rng = random.Random(3)
    nodes = [(i, i - 1 if i else None, f"c{i}") for i in range(1_000)]
    nodes += [(2_000 + i, 2_000 + (i + 1) % 7, f"r{i}") for i in range(7)] + [(3_000, 3_000, "self"), (3_001, 3_000, "on self"), (3_002, 9_999, "orphan"), (3_003, None, None), (3_004, 3_003, "under nameless")]
    nodes += [(2_100 + i, 2_099 + i if i else 2_003, f"t{i}") for i in range(30)] + [(2_200, 2_201, "p"), (2_201, 2_200, None), (2_202, 2_201, "q"), (None, 1, "lost"), (3_004, 5, "again"), (3_004, 5, "again")]
    nodes += [(5_000 + i, rng.choice([None, *range(5_000, 5_300)]), f"x{i}") for i in range(300)]
    rng.shuffle(nodes)
    frame = spark.createDataFrame(nodes, "id int, parent int, name string").selectExpr("*", "1 as up", "2 as least", "3 as names")
    got = hierarchy.paths(frame).collect()
    assert {r.id: r.path for r in got} == walked(nodes) and len(got) == len({n[0] for n in nodes} - {None})
    assert hierarchy.paths(frame.filter("id < 0")).count() == 0


def test_category_paths_of_a_million(spark):
    """Ten levels of ten, by string ids, with one cycle at the root: as many rounds as its depth's logarithm."""
    nodes = spark.range(1_000_000).selectExpr("cast(id as string) as id", "cast(case when id > 0 then id div 10 else 7 end as string) as parent", "concat('n', id) as name")
    paths = hierarchy.paths(nodes)
    got = {r.id: r.path for r in paths.filter("id in ('0', '7', '999999', '12345')").collect()}
    assert got == {"0": "n7 / n0", "7": "n0 / n7", "999999": "n7 / n0 / n9 / n99 / n999 / n9999 / n99999 / n999999", "12345": "n7 / n0 / n1 / n12 / n123 / n1234 / n12345"}
    assert paths.count() == 1_000_000


HEADSET, HEATER = "Беспроводные наушники Inspire Buds3 Black", "Обогреватель керамический Emby CHT-500 на 10 кв.м Белый"
GENERATOR, DIESEL = "Бензиновый генератор Aceceа PT-3300 3.3 кВт с медной обмоткой (1900284922)", "Безопасный дизельный воздушный отопитель GREELITE SN99 12V 5 КВТ (2005912565)"
SHELF = "Металлический стеллаж Emby Light Series 2100х900x600 мм 5 полок ДСП до 100 кг Белый"


VERDICTS = [
    (HEADSET, "Inspire", "Наушники Samsung Galaxy Buds3 FE black (SM-R420NZKASEK)", False), (HEADSET, "Inspire", "Наушники OPPO Enco Buds3 ETEG1 slate black", False), (DIESEL, "GREELITE", "Припій BEST Sn99.3/Bi0.7, 0,8мм, 40 г", False),
    ("Генератор 2,5-2,8 кВт с медной обмоткой +AVR сертифицированный мотор Mast Group YH3000", "MAST", "Шеф кухонный нож 200 мм Kanetsune YH-3000 KC-922 из нержавеющей стали", False),
    (GENERATOR, "Aceceа", "Генератор бензиновый Edon 2,5 кВт / 220 В PT3300", False), (HEATER, "Emby", "Електричний офтальмологічний операційний стіл Invita CH-T500", False), (HEATER, "Emby", "Керамический обогреватель SunCeramic CHT-500 500 Вт", False),
    ("Полноразмерные игровые наушники-гарнитура Fantech HQ53 Flash AUX USB 2 m Black", "Fantech", "Комплект ігровий Fantech P51 5в1 клавіатура Shikari K515/миша Crypto VX7 / килимок Vigil MP356 / навушники Flash HQ53 з підставкою", False),
    ("Смартфон Apple iPhone 15 128gb", "Apple", "Смартфон Apple iPhone 15 256GB", False), ("Смартфон Apple iPhone 15 128gb", "Apple", "Смартфон Apple iPhone 14 128GB", False), ("Ортез Example EPCC2614", "Example", "Ортез Example EPСС2615", False),
    (DIESEL, "GREELITE", "Автономний дизельний обігрівач GREELITE SN99 12 V 5 КВТ", True), ("Ортез Example EPСС2614", "Example", "Ортез Example EPCC2614", True), (HEATER, "Emby", "Керамический обогреватель Emby CHT-500 белый", True),
    ("Портативная батарея с функцией автозапуска XON PowerBoost 25000 mAh 500A peak 1000A Черный (TC1N 5887)", "XON", "Портативна батарея з функцією автозапуску XON PowerBoost 25000 mAh 500A peak 1000A Чорний (TC1N 5887)", True),
    ("Портативная батарея XON PowerBoost Черный (TC1N 5887)", "XON", "Портативна батарея XON PowerBoost Чорний (TC1N 2247)", False), (SHELF, "Emby", "Металевий стелаж Emby Light Series 2100x900x500 мм Білий", False),
]


def test_variants_and_foreign_brands_never_pass(spark):
    """Another brand's product with the same model number, another variant, a bundle; and the product in other letters."""
    rows = variants.compared(spark.createDataFrame([(i, *v[:3]) for i, v in enumerate(VERDICTS)], "i int, source string, brand string, title string"))
    got = {r.i: (r.verdict == "PASS", r.identity == "CONFIRMED") for r in matching.validated(rows).collect()}
    assert got == {i: (v[3], v[3]) for i, v in enumerate(VERDICTS)}


RULES = [
    ("Стеллаж Emby 2100 х 900 × 600 мм Белый", "Стелаж Emby 2100x900x600мм Білий", []), ("Стеллаж Emby 2100 х 900 × 600 мм", "Стелаж Emby 2100x900x500 мм", ["size"]),
    ("Монітор LG UltraGear 27", "Монітор LG UltraGear 32", ["model family", "product core", "size"]), ("Шина Nokian 205/55 R16", "Шина Nokian 215/55 r16", ["size"]), ("SSD Kingston 1TB", "SSD Kingston 1024 гб", []),
    ("Насос 35-005 Emby", "Насос 35-006 Emby", ["public code"]), ("Насос 35-005 Emby", "Насос 41-777 Emby", []), ("Наушники Sony", "Левый наушник Sony", ["whole product"]), ("Наушники Sony", "Дисплей для Sony", ["whole product"]), (None, None, []), ("", "x", []),
    ("Galaxy Watch 6", "Galaxy Watch 5", ["generation"]), ("Кабель (49) чорний", "Кабель (50) білий", ["terminal variant", "color"]), ("Смартфон Redmi 8/128", "Смартфон Redmi 6/128", ["ram"]),
]


def test_variant_rules(spark):
    rows = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(RULES)], "i int, source string, title string").withColumn("x.y", F.lit(1))
    got = {r.i: [c.rule for c in r.variant_conflicts] for r in variants.compared(rows).collect()}
    assert got == {i: r[2] for i, r in enumerate(RULES)}


@pytest.mark.parametrize(("least", "hot"), [(0.55, 3), (0.75, 20), (1.0, 0), (0.18, 5)])
def test_linkage_loses_no_pair(spark, least, hot):
    """A few words in most titles and many in one or two, against all pairs; short and empty texts, null ids' texts too."""
    rng = random.Random(hot)
    word = lambda: f"common{rng.randrange(6)}" if rng.random() < 0.6 else f"rare{rng.randrange(60)}"
    text = lambda: " ".join(word() for _ in range(rng.randrange(8)))
    products = [(i, text()) for i in range(70)] + [(70, None), (71, "a bc"), (72, "common1"), (72, "rare1")]
    offers = [(i, text()) for i in range(160)] + [(160, None), (161, "common0 common1 common2 common3 common4 common5")]
    of = lambda rows: {k: set().union(*[{w for w in (t or "").split() if len(w) >= 3} for i, t in rows if i == k]) for k, _ in rows}
    p, o = of(products), of(offers)
    want = {(i, j): len(a & b) / len(a) for i, a in p.items() for j, b in o.items() if a and len(a & b) / len(a) >= least - 1e-9}
    frames = [spark.createDataFrame(rows, "id int, words string") for rows in (products, offers)]
    got = linkage.linked(*frames, "id", "words", "id", "words", least=least, hot=hot).collect()
    assert len(got) == len(want) and {(r.product, r.offer): pytest.approx(r.overlap) for r in got} == want
