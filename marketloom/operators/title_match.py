"""The older classifier of offers by title: word similarity, model tokens, supplier code, and what speaks against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import folding
from marketloom.functions.folding import let
from marketloom.functions.similarity import word_ratio, words

# Words that say nothing about a product.
STOP = ["доставка", "купити", "купить", "магазин", "новий", "новый", "офіційний", "официальный", "товар", "украина", "україна", "цена", "ціна"]
# Colours by their spellings.
COLORS = {
    "beige": ["beige", "бежевий", "бежевый"], "black": ["black", "черный", "чорний"], "blue": ["blue", "синий", "синій"], "brown": ["brown", "коричневий", "коричневый"],
    "gold": ["gold", "золотий"], "gray": ["gray", "grey", "серый", "сірий"], "green": ["green", "зеленый", "зелений"], "natural": ["natural"],
    "orange": ["orange", "оранжевый", "помаранчевий"], "pink": ["pink", "рожевий", "розовый"], "purple": ["purple", "фиолетовый", "фіолетовий"], "red": ["red", "красный", "червоний"],
    "silver": ["silver", "серебристый", "срібний"], "titanium": ["titanium", "титан"], "white": ["white", "белый", "білий"], "yellow": ["yellow", "желтый", "жовтий"],
}
# Units by their other spellings.
UNITS = {
    "гц": "hz", "вт": "w", "квт": "kw", "гб": "gb", "тб": "tb", "мб": "mb", "мач": "mah", "мл": "ml", "л": "l", "кг": "kg", "гр": "g", "мм": "mm", "см": "cm", '"': "inch", "в": "v",
}
# Numbers with the units in which products of one name differ.
VARIANT = (
    rf'(?iuU)\b\d+(?:[.,]\d+)?\s?(?:gb|tb|mb|гб|тб|мб|w|kw|вт|квт|mah|мач|ml|мл|l|л|kg|кг|g|гр|mm|мм|cm|см|inch|hz|гц|v|в|")(?=\s|$|[^{folding.LETTERS}0-9])'
)
# What a model token is made of, and tokens that only look like one.
MODEL_LETTERS = f"{folding.LETTERS}._+/-"
MODEL = rf"(?iuU)\b(?=[0-9{MODEL_LETTERS}]{{4,}}\b)(?=[{MODEL_LETTERS}]*\d)[0-9{MODEL_LETTERS}]+\b"
SPECS = [r"\d{3,4}[xх×]\d{3,4}", r"\d+(?:\.\d+)?(?:k|hz|гц|w|вт|gb|гб|tb|тб|mah|мач|v|в)", r"dci-?p3"]
FEATURES = r"hdr\d+|dcip3|srgb|adobergb|freesync|gsync|tuv.*|vesa.*"
#: Characters of model tokens, variants and models that are taken of a product.
MOST = 12


def norm(text: Column) -> Column:
    """Lower-case words without stop words, Ukrainian ones in Russian."""
    low = F.translate(F.lower(F.coalesce(text, F.lit(""))), "’/", "' ")
    table = F.create_map(*[F.lit(x) for k, v in folding.UA_RU.items() for x in (k, v)])
    kept = F.filter(F.split(F.regexp_replace(low, "[^a-zа-яіїєґ0-9+._-]+", " "), " "), lambda w: (w != "") & ~w.isin(STOP))
    return F.array_join(F.transform(kept, lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def compact(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-zа-яіїєґ0-9]+", "")


def colors(text: Column) -> Column:
    """Colours that a text names, in order."""
    found = lambda named: [F.when(F.arrays_overlap(named, F.array(*map(F.lit, spellings))), F.lit(name)) for name, spellings in sorted(COLORS.items())]
    return let(F.regexp_extract_all(F.lower(text), F.lit(f"[0-9{MODEL_LETTERS}]+"), 0), lambda named: F.array_compact(F.array(*found(named))))


def variants(text: Column) -> Column:
    """Numbers with their unit in one spelling, in order of appearance, once each."""
    raw = lambda v: F.replace(F.regexp_replace(F.lower(v), r"(?U)\s+", ""), F.lit(","), F.lit("."))
    table = F.create_map(*[F.lit(x) for k, v in UNITS.items() for x in (k, v)])

    def one(v: Column) -> Column:
        unit = F.regexp_extract(v, r"^\d+(?:\.\d+)?(.*)$", 1)
        return F.concat(F.regexp_extract(v, r"^\d+(?:\.\d+)?", 0), let(unit, lambda u: F.coalesce(F.try_element_at(table, u), u)))

    return F.array_distinct(F.transform(F.transform(F.regexp_extract_all(text, F.lit(VARIANT), 0), raw), one))


def resolutions(text: Column) -> Column:
    """Pairs of three or four digits, in order and once each."""
    found = F.regexp_extract_all(text, F.lit(r"(?iuU)(?<!\d)\d{3,4}\s*[xх×]\s*\d{3,4}(?!\d)"), 0)
    number = lambda v, n: F.regexp_extract(v, rf"(?iuU)^0*(\d+)\s*[xх×]\s*0*(\d+)$", n)
    return F.array_sort(F.array_distinct(F.transform(found, lambda v: F.concat(number(v, 1), F.lit("x"), number(v, 2)))))


def models(text: Column, sku: Column) -> Column:
    """Tokens that may be a maker's model number, but for specifications and the supplier's own code."""
    odd = lambda t, c: F.lower(t).rlike(f"^(?:{'|'.join(SPECS)})$") | c.rlike(f"^(?:{FEATURES})$")
    useful = lambda own: F.filter(F.regexp_extract_all(text, F.lit(MODEL), 0), lambda t: let(compact(t), lambda c: ~odd(t, c) & (F.length(c) >= 4) & (c != own)))
    once = lambda found: let(F.transform(found, compact), lambda low: F.filter(found, lambda t, i: F.array_position(low, F.get(low, i)) == i + 1))
    return F.slice(let(let(compact(sku), useful), once), 1, MOST)


def _unit(v: Column) -> Column:
    return F.regexp_replace(v, "[0-9.,]", "")


def _clashes(name: str, own: Column, other: Column) -> Column:
    clash = (F.size(own) > 0) & (F.size(other) > 0) & ~F.arrays_overlap(own, other)
    return F.when(clash, F.concat(F.lit(f"{name}:"), F.array_join(own, "/"), F.lit("!="), F.array_join(F.array_sort(other), "/")))


def classified(offers: DataFrame) -> DataFrame:
    """Adds base (title similarity), brand_present, matched_models, sku_hit, sku_distinctive, conflicts, score, status and
    reason to offers with title, brand, sku, params (the product's, as text), candidate_title, candidate_url and
    candidate_text. A difference in a unit, resolution or colour that both sides name is a CONFLICT whatever else fits.
    Nulls count as empty."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = offers.withColumns({
        "_own": F.concat_ws(" ", text("title"), text("params")), "_hay": F.concat_ws(" ", text("candidate_title"), text("candidate_url"), text("candidate_text")),
        "_brand": compact(F.col("brand")), "_sku": compact(F.col("sku")),
        "_mine": words(norm(F.col("title"))), "_theirs": words(norm(F.col("candidate_title"))),
    })
    rows = rows.withColumn("base", F.when(text("candidate_title") == "", 0.0).otherwise(word_ratio(F.col("_mine"), F.col("_theirs"))))
    family = F.coalesce(*[F.when(F.col("_brand").isin(names), F.array(*map(F.lit, names))) for names in folding.BRAND_FAMILIES.values()], F.when(F.col("_brand") != "", F.array("_brand")), F.array().cast("array<string>"))
    rows = rows.withColumns({
        "_c": compact(F.col("_hay")), "_variants": F.slice(variants(F.col("_own")), 1, MOST), "_models": models(F.col("_own"), F.col("sku")), "_family": family,
        "_has": variants(F.col("_hay")), "sku_distinctive": (F.length("_sku") >= 6) & F.col("_sku").rlike("[a-zа-яіїєґ]") & F.col("_sku").rlike("[0-9]"),
    })
    same = lambda v: F.filter("_has", lambda w: _unit(w) == _unit(v))
    differing = F.filter("_variants", lambda v: (F.size(same(v)) > 0) & ~F.array_contains(F.col("_has"), v))
    rows = rows.withColumns({
        "brand_present": F.exists("_family", lambda a: F.col("_c").contains(a)), "sku_hit": (F.length("_sku") >= 4) & F.col("_c").contains(F.col("_sku")),
        "_matched": F.filter("_models", lambda m: F.col("_c").contains(compact(m))),
        "conflicts": F.array_compact(F.concat(
            F.transform(differing, lambda v: F.concat(F.lit("variant:"), v, F.lit("!="), F.array_join(F.array_sort(same(v)), ","))),
            F.array(_clashes("resolution", resolutions(F.col("_own")), resolutions(F.col("_hay"))), _clashes("color", colors(F.col("_own")), colors(F.col("_hay")))),
        )),
    })
    base, brand, n = F.col("base"), F.col("brand_present"), F.size("_matched")
    bonus = F.when(brand, 8).otherwise(0) + F.least(F.lit(20), 10 * n) + F.when(F.col("sku_hit"), F.when(F.col("sku_distinctive"), 16).otherwise(7)).otherwise(0)
    rows = rows.withColumns({"matched_models": n, "_score": F.least(F.lit(99.0), base + bonus)})
    public = F.exists("_matched", lambda m: m.contains("-") | (F.length(compact(m)) >= 6))
    strong = (
        (base >= 94) | (public & (base >= 70)) | (brand & (base >= 86)) | (brand & (n > 0) & (base >= 78))
        | (F.col("sku_distinctive") & F.col("sku_hit") & (brand | (base >= 84) | (n > 0)))
    )
    unbranded = (F.col("_brand") != "") & ~brand & (base < 90) & (n == 0)
    status = F.when(F.size("conflicts") > 0, "CONFLICT").when(unbranded, "POSSIBLE").when(strong & (F.col("_score") >= 95), "EXACT").when(F.col("_score") >= 90, "HIGH").otherwise("POSSIBLE")
    score = F.when(F.size("conflicts") > 0, F.least(base, F.lit(89.0))).when(unbranded, F.least(F.col("_score"), F.lit(89.0))).otherwise(F.col("_score"))
    flag = lambda c: F.when(F.col(c), "True").otherwise("False")
    told = F.format_string("title=%.1f; models=%d; brand=%s; supplier_sku_hit=%s; sku_distinctive=%s", F.bround("base", 1), "matched_models", flag("brand_present"), flag("sku_hit"), flag("sku_distinctive"))
    reason = F.when(F.size("conflicts") > 0, F.array_join("conflicts", "; ")).otherwise(told)
    return rows.withColumns({"status": status, "score": score, "reason": reason}).drop("_own", "_hay", "_mine", "_theirs", "_brand", "_sku", "_c", "_variants", "_models", "_family", "_has", "_matched", "_score")
