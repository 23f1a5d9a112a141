"""What tells variants of a product apart in its title: a signature of sets, and rules between two signatures.

A signature is a column for each of the kind of thing, colours, memory, sizes, core tokens, model codes, published codes and generations, each
a set of texts taken by built-in expressions from the folded title; a rule finds two sets that both say something and
agree on nothing. What only one side says is no conflict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import folding

# Words by which a title names a part, an accessory or a component, and whole products.
PARTS = {
    "spare_part": r"шлейф|flex cable|запчаст\w*|spare part|дисплейн\w+ модул\w*|дисплей\s+(?:модул\w*|для\b)|display\s+(?:module|replacement|for\b)|екран\s+(?:модул\w*|для\b)|экран\s+(?:модул\w*|для\b)|screen\s+(?:module|replacement|for\b)"
    r"|тачскрин\w*|touchscreen\s+(?:module|replacement|for\b)|сенсор\s+(?:для\b|модул\w*)|матриц[аы]\s+(?:для\b|модул\w*)|акумулятор\s+для\b|аккумулятор\s+для\b|battery\s+(?:replacement|for\b)|материнск\w+ плат\w*|motherboard|задн\w+ кришк\w*|задн\w+ крышк\w*",
    "accessory": r"чохол\w*|чехол\w*|бампер\w*|захисн\w+ скло|защитн\w+ стекло|захисн\w+ плівк\w*|защитн\w+ пленк\w*|гідрогел\w*|гидрогел\w*|ремінець\w*|ремешок\w*|адаптер\w*|перехідник\w*|переходник\w*|usb hub|хаб",
    "component": r"(?:лів(?:ий|а)|прав(?:ий|а|ый|ая)|лев(?:ый|ая)|left|right)\s+(?:навушник\w*|наушник\w*|earbud\w*)|(?:no[- ]?box|без\s+(?:кейса|футляра|зарядн\w+ кейса))",
}
PRODUCTS = {
    "smartphone": "смартфон|smartphone|мобільн(?:ий|ого) телефон|мобильн(?:ый|ого) телефон", "monitor": "монітор|монитор|monitor", "headphones": "навушники|наушники|гарнітура|гарнитура|headphones|headset|earbuds|airpods",
    "television": "телевізор|телевизор|television|tv", "laptop": "ноутбук|laptop", "tablet": "планшет|tablet", "ssd": r"ssd|твердотільн\w+ накопичувач|твердотельн\w+ накопитель", "hdd": r"hdd|жорстк\w+ диск|жестк\w+ диск",
    "tire": "шина|шини|шины|tyre|tire", "clothing": "футболка|сорочка|рубашка|куртка|штани|брюки|сукня|платье|hoodie|t-shirt|кросівки|кроссовки|взуття|обувь|shoes|sneakers",
    "perfume": r"парфум|парфюм|туалетн\w+ вод|eau de|perfume",
}
# Colours by their spellings.
COLORS = {
    "beige": "beige бежевий бежева бежевый бежевая", "black": "black чорний чорна черный черная", "blue": "blue синій синя блакитний блакитна синий синяя голубой голубая", "brown": "brown коричневий коричнева коричневый коричневая",
    "gold": "gold золотий золотой", "gray": "gray grey сірий сіра серый серая", "green": "green зелений зелена зеленый зеленая", "orange": "orange помаранчевий помаранчева оранжевый оранжевая", "pink": "pink рожевий рожева розовый розовая",
    "red": "red червоний червона красный красная", "silver": "silver срібний сріблястий серебристый серебряный", "violet": "violet purple фіолетовий фіолетова фиолетовый фиолетовая", "white": "white білий біла белый белая", "yellow": "yellow жовтий жовта желтый желтая",
}
# Words that are no core of a name, and prefixes that make no model with a number.
NO_CORE = (
    "смартфон smartphone монітор монитор monitor навушники наушники гарнітура гарнитура headphones headset earbuds телевізор телевизор ноутбук laptop планшет tablet apple samsung xiaomi redmi galaxy pro plus max gen generation with case gb гб "
    "5g lte 2k 4k ips hdr10 usb type charging magsafe"
).split() + " ".join(COLORS.values()).split()
NO_FAMILY = "din iso iec en mah ah wh hz mm cm kg kw kva volt model".split()
NO_MODEL = "din iso iec en usb wifi lte mah ah wh hz mm cm kg kw kva volt v w".split()
NO_GENERATION = "gb гб tb тб hz гц mm мм cm см ml мл usb type wifi lte розмір размер size".split()
GENERATION_UNITS = "gb гб tb тб hz гц mm мм cm см ml мл kg кг w вт inch inches дюйм дюйма дюймов дюйми дюймів".split()
UNIT_NAMES = {"мм": "mm", "см": "cm", "мл": "ml", "кг": "kg"}
#: Letters of the longest core token that tells a family; longer ones are codes of their own.
FAMILY_LENGTH = 8
_U = "(?iuU)"
_EMPTY = "array<string>"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(_U + pattern), group)


def _set(values: Column) -> Column:
    return F.sort_array(F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != ""))))


def _apart(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def _unit(text: Column) -> Column:
    for k, v in UNIT_NAMES.items():
        text = F.replace(text, F.lit(k), F.lit(v))
    return text


def entity(norm: Column) -> Column:
    """What a title offers; parts and accessories come before the product they are for."""
    found = [F.when(norm.rlike(rf"{_U}\b(?:{p})\b"), F.lit(name)) for name, p in (PARTS | PRODUCTS).items()]
    return F.coalesce(*found)


def diagonal(low: Column) -> Column:
    """A display's size in inches at the end of a title."""
    return F.nullif(F.regexp_extract(low, _U + r'\b([2-9][0-9]|1[0-2][0-9])\s*(?:дюйм\w*|inch(?:es)?|")?\s*$', 1), F.lit(""))


def _display(kind: Column) -> Column:
    return F.coalesce(kind.isin("television", "monitor"), F.lit(False))


def _sizes(norm: Column, kind: Column) -> Column:
    found = [
        F.transform(_all(norm, r"(?<!\d)\d{1,4}x\d{1,4}(?:x\d{1,4})?\s*(?:mm|мм|cm|см)?\b"), lambda v: F.regexp_replace(_unit(v), r"\s", "")),
        F.transform(_all(norm, r'(?<!\d)(\d{1,3}(?:[.,]\d+)?)\s*(?:inch|inches|дюйм\w*|")', 1), lambda v: F.concat(F.replace(v, F.lit(","), F.lit(".")), F.lit("in"))),
        F.transform(_all(norm, r"(?<!\d)\d+(?:[.,]\d+)?\s*(?:mm|мм|cm|см|ml|мл|kg|кг)\b"), lambda v: F.replace(F.regexp_replace(_unit(v), r"\s", ""), F.lit(","), F.lit("."))),
        F.transform(_all(norm, r"\b(?:розмір|размер|size)\s*[:#-]?\s*(\d{1,3}(?:[.,]\d+)?)\b", 1), lambda v: F.concat(F.lit("size:"), F.replace(v, F.lit(","), F.lit(".")))),
        F.transform(_all(norm, r"(?<!\d)\d{3}\s*/\s*\d{2}\s*r\s*\d{2}(?!\d)"), lambda v: F.concat(F.lit("tire:"), F.regexp_replace(v, r"\s", ""))),
        F.when(_display(kind), F.array(F.concat(F.lit("diag:"), diagonal(norm)))).otherwise(F.array().cast(_EMPTY)),
    ]
    return _set(F.concat(*found))


def _memory(low: Column) -> tuple[Column, Column]:
    """RAM and storage in gigabytes."""
    pair = r"(?<!\d)(\d{1,2})\s*[/+]\s*(\d{2,4})\s*(?:gb|гб)?\b"
    whole = r"(?<!\d)(\d{1,4})\s*(gb|гб|tb|тб)\b"
    number = lambda v: v.cast("int").cast("string")
    sized = F.zip_with(_all(low, whole, 1), _all(low, whole, 2), lambda n, u: n.cast("int") * F.when(u.isin("tb", "тб"), 1024).otherwise(1))
    storage = F.concat(F.transform(_all(low, pair, 2), number), F.transform(F.filter(sized, lambda n: n >= 32), lambda n: n.cast("string")))
    return _set(F.transform(_all(low, pair, 1), number)), _set(storage)


def _core(norm: Column) -> Column:
    """Tokens of letters and digits that are no measure, and words with their number behind them."""
    bare = F.transform(F.split(norm, " "), lambda t: F.regexp_replace(t, "[^a-zа-яіїє0-9]", ""))
    odd = r"\d{1,4}(?:gb|гб|tb|тб)|20\d{2}|\d+(?:hz|гц)?|\d+(?:a|v|w|mah|ah|wh|hz|гц|мм|mm|см|cm|мл|ml|кг|kg|вт|квт|ква)|\d{1,4}x\d{1,4}(?:x\d{1,4})?(?:mm|мм|cm|см)?"
    tokens = F.filter(bare, lambda c: ~c.isin(NO_CORE) & ~c.rlike(f"^(?:{odd})$") & c.rlike("[a-zа-яіїє]") & c.rlike("[0-9]"))
    family = r"\b([a-z]{2,10})\s*[-_/]?\s*(\d{2,5})\b"
    pairs = F.zip_with(_all(norm, family, 1), _all(norm, family, 2), lambda p, n: F.when(~p.isin(NO_FAMILY), F.concat(p, n)))
    return _set(F.concat(tokens, pairs))


def _model_codes(norm: Column) -> Column:
    """Latin model numbers that a title names: in one token, a word and its number, a model and the number of its variant."""
    prefix = lambda c: F.regexp_extract(c, "^[a-z]+", 0)
    tokens = F.transform(_all(norm, r"(?<!\w)([a-z][a-z0-9]*(?:[-_/][a-z0-9]+)*)(?!\w)", 1), lambda t: F.regexp_replace(t, "[^a-z0-9]", ""))
    single = F.filter(tokens, lambda c: c.rlike("[0-9]") & ~prefix(c).isin(NO_MODEL))
    spaced = r"\b([a-z]{2,10})\s+(\d{2,5})\b"
    words = F.zip_with(_all(norm, spaced, 1), _all(norm, spaced, 2), lambda p, n: F.when(~p.isin(NO_MODEL), F.concat(p, n)))
    based = r"\b([a-z][a-z0-9]*\d[a-z])\s+(\d{3,6})\b"
    pairs = F.zip_with(_all(norm, based, 1), _all(norm, based, 2), lambda b, n: F.when(~prefix(b).isin(NO_MODEL), F.concat(b, n)))
    return _set(F.concat(single, words, pairs))


def _bracketed(low: Column) -> Column:
    """Codes in brackets, but no years, quantities and measures."""
    unit = r"(?iuU)\b(?:шт|штук|pcs|pieces|pack|уп|упак|mm|мм|cm|см|ml|мл|kg|кг|gb|гб|tb|тб|w|вт|v|в|hz|гц)\b"
    inner = F.filter(F.transform(_all(low, r"\(([^()]{1,24})\)", 1), F.trim), lambda v: ~v.rlike(unit))
    kept = F.filter(F.transform(inner, lambda v: F.regexp_replace(v, "[^a-zа-яіїє0-9]", "")), lambda c: c.rlike("[0-9]") & (F.length(c) <= 20) & ~c.rlike(r"^(?:19|20)\d{2}$"))
    dashed = F.transform(F.filter(inner, lambda v: v.rlike(r"^\d{2,3}\s*-\s*\d{3,5}$")), lambda v: F.regexp_replace(v, "[^a-zа-яіїє0-9]", ""))
    return _set(F.concat(F.filter(kept, lambda c: c.rlike(r"^\d{1,3}$") | c.rlike("[a-zа-яіїє]")), F.filter(dashed, lambda c: ~c.rlike(r"^(?:19|20)\d{2}$"))))


def _generations(norm: Column) -> Column:
    """Words with a number from 1 to 20 behind them, as word=number; of a word's numbers the last."""
    letters = lambda w: F.regexp_replace(F.coalesce(w, F.lit("")), "[^a-zа-яіїє]", "")
    measure = r"^\d{1,4}(?:gb|гб|tb|тб|hz|гц|mm|мм|cm|см|ml|мл|kg|кг|w|вт|inch|inches)$"

    def one(words: Column, i: Column) -> Column:
        def told(after: Column, family: Column) -> Column:
            mixed = after.rlike("[a-zа-яіїє]") & after.rlike("[0-9]")
            ok = (family != "") & ~family.isin(NO_GENERATION) & ~mixed & ~after.contains('"') & ~letters(F.get(words, i + 2)).isin(GENERATION_UNITS) & ~after.rlike(measure)
            return F.when(ok, folding.let(F.regexp_replace(after, "[^0-9]", "").try_cast("int"), lambda n: F.when(n.between(1, 20), F.struct(family.alias("family"), n.cast("string").alias("n")))))

        # Few words have a digit behind them: the rest is not looked at.
        own = lambda after: F.when(after.rlike("[0-9]"), folding.let(letters(F.get(words, i)), lambda family: told(after, family)))
        return folding.let(F.coalesce(F.get(words, i + 1), F.lit("")), own)

    last = lambda found: F.filter(found, lambda g, i: ~F.exists(F.slice(found, i + 2, F.size(found)), lambda h: h["family"] == g["family"]))
    every = folding.let(F.split(norm, " "), lambda words: F.array_compact(F.transform(words, lambda w, i: one(words, i))))
    return F.sort_array(F.transform(folding.let(every, last), lambda g: F.concat(g["family"], F.lit("="), g["n"])))


FIELDS = ["entity", "colors", "ram", "storage", "sizes", "core", "models", "bracketed", "codes", "generations", "diagonal"]


def signature(name: str) -> dict[str, Column]:
    """The columns that with_signature has added behind a name."""
    return {f: F.col(f"{name}{f}") for f in FIELDS}


def with_signature(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Adds what the title `text` says of its product, a column for each of FIELDS behind `name` (all sets sorted, of texts).
    They aren't packed in a struct: Spark would then compute a field anew wherever it is read."""
    rows = rows.withColumns({"_norm": folding.settled(folding.title_words(F.col(text))), "_low": folding.casefold(F.coalesce(F.col(text), F.lit("")))})
    norm, low = F.col("_norm"), F.col("_low")
    rows = rows.withColumn("_kind", entity(norm))
    ram, storage = _memory(low)
    named = folding.let(F.split(norm, " "), lambda words: F.array(*[F.when(F.arrays_overlap(words, F.array(*map(F.lit, v.split()))), F.lit(k)) for k, v in COLORS.items()]))
    made = [
        F.col("_kind"), _set(named), ram, storage, _sizes(norm, F.col("_kind")), _core(norm), _model_codes(norm), _bracketed(low), _set(_all(low, r"(?<!\d)\d{2,3}-\d{3,5}(?!\d)")), _generations(norm),
        F.concat(F.lit("diag:"), diagonal(low)),
    ]
    return rows.withColumns({f"{name}{f}": c for f, c in zip(FIELDS, made, strict=True)}).drop("_norm", "_low", "_kind")


def conflicts(a: dict[str, Column], b: dict[str, Column], family_length: int | None = FAMILY_LENGTH) -> Column:
    """Where two signatures differ: an array of (rule, expected, got), in the order of the rules. a is the product's.
    family_length: see compared."""
    def told(rule: str, when: Column, x: Column, y: Column) -> Column:
        row = F.struct(F.lit(rule).alias("rule"), x.alias("expected"), y.alias("got"))
        return F.when(when, F.array(row)).otherwise(F.array().cast("array<struct<rule:string,expected:array<string>,got:array<string>>>"))

    one = lambda s: F.array_compact(F.array(s))
    # A published code differs if it stands in brackets, or if another shares one of its halves.
    half = lambda c, n: F.get(F.split(c, "-"), n)
    shown = F.exists(a["codes"], lambda c: F.array_contains(a["bracketed"], F.replace(c, F.lit("-"), F.lit(""))))
    near = F.exists(a["codes"], lambda c: F.exists(b["codes"], lambda e: (half(c, 0) == half(e, 0)) | (half(c, 1) == half(e, 1))))
    # A model with the number of a variant: same model, no number in common.
    base = lambda c: F.regexp_extract(c, r"^([a-z][a-z0-9]*\d[a-z])\d{3,6}$", 1)
    of = lambda codes, k: F.filter(codes, lambda c: base(c) == k)
    bases = F.array_intersect(F.filter(F.transform(a["models"], base), lambda x: x != ""), F.transform(b["models"], base))
    suffix = F.exists(bases, lambda k: ~F.arrays_overlap(of(a["models"], k), of(b["models"], k))) & (F.size(b["models"]) > 0)
    part = lambda s: F.coalesce(s["entity"].isin(list(PARTS)), F.lit(False))
    short = lambda s: s["core"] if family_length is None else F.filter(s["core"], lambda t: F.length(t) <= family_length)
    family = _apart(short(a), short(b))
    word = lambda g: F.substring_index(g, "=", 1)
    other = lambda x, y: F.filter(x, lambda g: F.exists(y, lambda h: (word(h) == word(g)) & (h != g)))
    # For a display, a number at the end of either title is a size too.
    sized = lambda s: _set(F.concat(s["sizes"], F.when(_display(a["entity"]), F.array(s["diagonal"])).otherwise(F.array().cast(_EMPTY))))
    rules = [
        told("terminal variant", _apart(a["bracketed"], b["bracketed"]), a["bracketed"], b["bracketed"]), told("public code", _apart(a["codes"], b["codes"]) & (shown | near), a["codes"], b["codes"]),
        told("model variant", suffix, a["models"], b["models"]), told("model family", ~suffix & _apart(a["models"], b["models"]), a["models"], b["models"]), told("whole product", part(b) & ~part(a), one(a["entity"]), one(b["entity"])),
        told("entity", ~(part(b) & ~part(a)) & F.coalesce(a["entity"] != b["entity"], F.lit(False)), one(a["entity"]), one(b["entity"])), told("product family", family, short(a), short(b)),
        told("product core", ~family & _apart(a["core"], b["core"]), a["core"], b["core"]), told("generation", F.size(other(a["generations"], b["generations"])) > 0, other(a["generations"], b["generations"]), other(b["generations"], a["generations"])),
        told("storage", _apart(a["storage"], b["storage"]), a["storage"], b["storage"]), told("ram", _apart(a["ram"], b["ram"]), a["ram"], b["ram"]), told("size", _apart(sized(a), sized(b)), sized(a), sized(b)), told("color", _apart(a["colors"], b["colors"]), a["colors"], b["colors"]),
    ]
    return F.concat(*rules)


def generation_state(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether the offer has the product's generation: none (nothing to confirm), confirmed, mismatch or unconfirmed."""
    word = lambda g: F.substring_index(g, "=", 1)
    shared = F.arrays_overlap(F.transform(a["generations"], word), F.transform(b["generations"], word))
    differ = F.exists(a["generations"], lambda g: F.exists(b["generations"], lambda h: (word(h) == word(g)) & (h != g)))
    return F.when(F.size(a["generations"]) == 0, "none").when(differ, "mismatch").when(shared, "confirmed").otherwise("unconfirmed")


def compared(offers: DataFrame, source: str = "source", title: str = "title", family_length: int | None = FAMILY_LENGTH) -> DataFrame:
    """Adds variant_conflicts (rule, expected, got), generation and models_shared to offers with the product's text and a title;
    matching.validated then takes them into account. Core tokens of at most family_length letters tell a product's family, all
    of them if it is None (where model numbers count through a table, their length says nothing)."""
    # A product's text repeats with each of its offers, and a signature costs far more than a join.
    parts = max(int(offers.sparkSession.conf.get("spark.sql.shuffle.partitions")), offers.sparkSession.sparkContext.defaultParallelism)
    own = with_signature(offers.select(F.col(source).alias("_source")).repartition(parts, "_source").distinct(), "_source", "_a_")
    rows = with_signature(offers, title, "_b_").join(own.hint("merge"), F.col(source).eqNullSafe(F.col("_source"))).drop("_source")
    a, b = signature("_a_"), signature("_b_")
    return rows.withColumns({"variant_conflicts": conflicts(a, b, family_length), "generation": generation_state(a, b), "models_shared": F.array_intersect(a["models"], b["models"])}).drop(*[f"{side}{f}" for side in ("_a_", "_b_") for f in FIELDS])
