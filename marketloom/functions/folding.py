"""Folding of text in which Latin and Cyrillic letters are mixed, and patterns made from identifiers.

Marketplace titles write the same code with letters of either script (EPСС2614, EPCC2614). A token is folded to Latin by
the majority of its letters, and only if each of its Cyrillic letters has a Latin twin, so ordinary words stay. All is
built-in expressions but for NFKC, for which Spark has none: a small Arrow function."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Cyrillic letters and the Latin letters that look the same.
CYRILLIC, LATIN = "авекмнорстхуі", "abekmhopctxyi"
# Letters and digits that identifiers are made of.
LETTERS = "A-Za-zА-Яа-яІіЇїЄєҐґ"
TOKEN = f"[0-9{LETTERS}]+"
LOWER_CYRILLIC = "а-яіїєґ"
#: What is no letter or digit of an identifier, once lower-case.
OTHER = f"[^0-9a-z{LOWER_CYRILLIC}]"
_FRAGMENT = rf"(?U)(?<!\w){TOKEN}(?:[._/+:-]{TOKEN})+(?!\w)"
# Letters of both scripts with at most digits (and, in fragments, joints) between them: what a token in two scripts can't be without.
_MEET = f"[A-Za-z]{{0}}[{LETTERS[6:]}]|[{LETTERS[6:]}]{{0}}[A-Za-z]"
_BETWEEN = r"(?<=\d)\s*[xхXХ×]\s*(?=\d)"

# Families of brands that shops list under each other's names.
BRAND_FAMILIES = {"xiaomi": ["mi", "poco", "redmi", "xiaomi"], "huawei": ["honor", "huawei"], "samsung": ["galaxy", "samsung"]}
# Ukrainian words of product names and the Russian words for the same.
UA_RU = {
    "монітор": "монитор", "багатофункціональний": "многофункциональный", "багатофункціональною": "многофункциональной", "підставка": "подставка", "підставкою": "подставкой",
    "ігровий": "игровой", "ігрова": "игровая", "навушники": "наушники", "клавіатура": "клавиатура", "миша": "мышь", "екран": "экран", "зарядний": "зарядное",
    "пристрій": "устройство", "чохол": "чехол", "відеокарта": "видеокарта", "процесор": "процессор", "пам'ять": "память", "жорсткий": "жесткий", "диск": "диск",
    "живлення": "питание", "мікрофон": "микрофон", "гарнітура": "гарнитура", "роз'єм": "разъем", "функція": "функция", "новий": "новый", "оригінал": "оригинал",
    "гарантія": "гарантия", "чорний": "черный", "білий": "белый", "сірий": "серый", "синій": "синий", "зелений": "зеленый", "жовтий": "желтый",
    "рожевий": "розовый", "срібний": "серебристый", "золотий": "золотой", "червоний": "красный",
}
# More such words, for searches.
UA_RU_SEARCH = UA_RU | {
    "обігрівач": "обогреватель", "керамічний": "керамический", "бездротовий": "беспроводной", "бездротові": "беспроводные", "генератор": "генератор",
    "інверторний": "инверторный", "комплект": "комплект", "набір": "набор",
}


@F.arrow_udf(StringType())
def nfkc(text: pa.Array) -> pa.Array:
    """Unicode compatibility composition (Arrow's own leaves letters decomposed)."""
    return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in text.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def settled(text: pa.Array) -> pa.Array:
    """The text itself. Where many expressions read a folded text, Spark would put the folding into each of them; what comes
    out of a function like this is computed once."""
    return text


def let(value: Column, use) -> Column:
    """What `use` makes of a value, which is computed once however often `use` reads it, also within a function over an array
    (where Spark computes an expression anew for each element). `use` may not hold Python functions; the value may."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def casefold(text: Column) -> Column:
    """Lower case, with sharp s and the final sigma as comparisons take them."""
    return F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def only(text: Column, kept: str) -> Column:
    """The characters of a text that belong to a class."""
    return F.regexp_replace(text, f"[^{kept}]", "")


def rewritten(text: Column, pattern: str, other: str, change) -> Column:
    """A text with each match of the pattern changed; `other` matches what lies between."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"{pattern}|{other}"), 0), change), "")


def _twins(text: Column) -> Column:
    return F.translate(text, CYRILLIC + CYRILLIC.upper(), LATIN + LATIN.upper())


def _mixed(token: Column) -> Column:
    """Whether a lower-case token is an identifier in two scripts: all its Cyrillic letters have twins, and it has a
    digit or at least as many Latin letters."""
    latin, cyrillic = F.length(only(token, "a-z")), F.length(only(token, LOWER_CYRILLIC))
    return (latin > 0) & (cyrillic > 0) & (F.length(only(token, CYRILLIC)) == cyrillic) & (token.rlike("[0-9]") | (latin >= cyrillic))


def _mixed_fragment(part: Column) -> Column:
    """The same for tokens joined by points, dashes and the like: these need a digit and a Latin letter."""
    cyrillic = F.length(only(part, LOWER_CYRILLIC))
    return part.rlike("[0-9]") & part.rlike("[a-z]") & (cyrillic > 0) & (F.length(only(part, CYRILLIC)) == cyrillic)


def _straight(text: Column) -> Column:
    """One dash and one sign between the numbers of a size."""
    return F.regexp_replace(F.translate(text, "‐‑‒–—− ", "------ "), f"(?U){_BETWEEN}", "x")


def fold(text: Column) -> Column:
    """The form in which identities are compared: NFKC, lower case, mixed tokens in Latin, single spaces; null is empty."""
    tokens = lambda p: rewritten(p, TOKEN, f"[^0-9{LETTERS}]+", lambda w: F.when(_mixed(w), _twins(w)).otherwise(w))
    parts = lambda p: rewritten(p, _FRAGMENT, f"{TOKEN}|[^0-9{LETTERS}]+", lambda w: F.when(_mixed_fragment(w), _twins(w)).otherwise(w))
    plain = let(_straight(casefold(nfkc(F.coalesce(text, F.lit(""))))), lambda p: F.when(p.rlike(_MEET.format("[0-9]*")), tokens(p)).otherwise(p))
    return collapsed(let(plain, lambda p: F.when(p.rlike(_MEET.format("[0-9._/+:-]*")), parts(p)).otherwise(p)))


def fold_cased(text: Column) -> Column:
    """Mixed tokens in Latin with the case of their letters; everything else as it is written."""
    plain = _straight(nfkc(F.coalesce(text, F.lit(""))))
    tokens = lambda p: rewritten(p, TOKEN, f"[^0-9{LETTERS}]+", lambda w: F.when(let(casefold(w), _mixed), _twins(w)).otherwise(w))
    return collapsed(let(plain, lambda p: F.when(p.rlike(_MEET.format("[0-9]*")), tokens(p)).otherwise(p)))


def compact(text: Column) -> Column:
    """Letters and digits of the folded text alone."""
    return compacted(fold(text))


def compacted(folded: Column) -> Column:
    return F.regexp_replace(folded, OTHER, "")


def pattern(identifier: Column) -> Column:
    """A regular expression that finds an identifier in raw text: its parts with any of ` ._/+:-` between them, letters of
    either script, no letter or digit before and after. Null if it has no letter and no digit."""
    parts = F.regexp_extract_all(fold(identifier), F.lit(f"[0-9a-z{LOWER_CYRILLIC}]+"), 0)
    other = F.create_map(*[F.lit(x) for pair in zip(LATIN, CYRILLIC, strict=True) for x in pair])

    def one(part: Column) -> Column:
        letters = F.split(part, "")
        beside = lambda i: F.coalesce(F.get(letters, i), F.lit("")).rlike("[0-9]")
        return F.array_join(F.transform(letters, lambda c, i: (
            F.when((c == "x") & beside(i - 1) & beside(i + 1), F.lit(r"\s*[xх×]\s*"))
            .when(F.map_contains_key(other, c), F.concat(F.lit("["), c, F.try_element_at(other, c), F.when(c == "x", F.lit("×")).otherwise(""), F.lit("]")))
            .otherwise(c)
        )), "")

    joined = F.array_join(F.transform(parts, one), r"[\s._/+:-]*")
    return F.when(F.size(parts) > 0, F.concat(F.lit(r"(?iuU)(?<!\w)"), joined, F.lit(r"(?!\w)")))


def names(identifier: Column, text: Column) -> Column:
    """Whether a text names an identifier, in either script and with any separators; the pattern is made per row."""
    return F.coalesce(F.rlike(F.coalesce(text, F.lit("")), pattern(identifier)), F.lit(False))


def brand_aliases(brand: Column) -> Column:
    """The names of a brand's family; of other brands the brand itself; none for nothing."""
    key, own = compact(brand), F.trim(F.coalesce(brand, F.lit("")))
    known = F.coalesce(*[F.when(key.isin(family), F.array(*map(F.lit, family))) for family in BRAND_FAMILIES.values()])
    return F.when(key == "", F.array().cast("array<string>")).otherwise(F.coalesce(known, F.array(own)))


def words_replaced(text: Column, mapping: dict[str, str]) -> Column:
    """Whole words replaced, found in any case; other text stays as it is."""
    table = F.create_map(*[F.lit(x) for k, v in mapping.items() if k != v for x in (k, v)])
    return rewritten(text, f"[{LETTERS}']+", f"[^{LETTERS}']+", lambda w: F.coalesce(F.try_element_at(table, casefold(w)), w))


def _reversed(mapping: dict[str, str]) -> dict[str, str]:
    out: dict[str, str] = {}
    for ua, ru in mapping.items():
        out.setdefault(ru, ua)
    return out


def language_variants(text: Column) -> Column:
    """A query as it is, in Russian and in Ukrainian words, without repeats in any case; none for an empty query."""
    texts = lambda own: F.array(own, *[collapsed(words_replaced(own, m)) for m in (UA_RU_SEARCH, _reversed(UA_RU_SEARCH))])
    first = lambda every: let(F.transform(every, casefold), lambda low: F.filter(every, lambda x, i: (x != "") & (F.array_position(low, F.get(low, i)) == i + 1)))
    return let(collapsed(F.coalesce(text, F.lit(""))), lambda own: F.when(own == "", F.array().cast("array<string>")).otherwise(let(texts(own), first)))


def fold_words(text: Column) -> Column:
    """The folded text with Ukrainian words in Russian."""
    return in_russian(fold(text))


def in_russian(folded: Column) -> Column:
    return collapsed(words_replaced(folded, UA_RU_SEARCH))


def title_words(text: Column) -> Column:
    """Folded words with points, slashes, plus, dashes and inch signs kept in them."""
    return collapsed(F.regexp_replace(fold(text), r'(?U)[^\w./+\-"]+', " "))
