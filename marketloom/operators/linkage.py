"""Candidate generation for linkage: all pairs of a product and an offer whose words overlap enough, without all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.operators.matching import LEAST_OVERLAP, long_words, norm

#: Offers that hold a word from which on the word is common, and a block of that word alone too large.
HOT = 1_000


#: Words that make a block at most, and words of a product among which so many are chosen at most (beyond, fewer make a block).
MOST, AMONG = 4, {2: 1_000, 3: 10, 4: 8}


def _chosen(words: Column, k: int) -> Column:
    """All choices of k of a sorted array's words, joined."""
    if k == 1:
        return words
    rest = lambda i: _chosen(F.slice(words, i + 2, F.size(words)), k - 1)
    return F.flatten(F.transform(words, lambda a, i: F.transform(rest(i), lambda b: F.concat_ws("\u0001", a, b))))


def _need(n: Column, least: float) -> Column:
    """How many of n words an offer needs."""
    return F.greatest(F.lit(1), F.ceil(n * least - 1e-9)).cast("int")


def keyed(products: DataFrame, counts: DataFrame, total: DataFrame, hot: int) -> DataFrame:
    """Rows (product, words, first, need, k, key) of products (product, words, need). A product's words are ordered by the number
    of offers that hold them. Whatever offer has `need` of its n words has k of the first n - need + k, for every k
    that is needed at all. Blocks are those of one word; where the largest would be hot, of two, three or four, by the
    number that they would hold if words fell together by chance (total: one row with the number of offers)."""
    each = products.select("product", "need", F.explode("words").alias("word")).join(counts.hint("merge"), "word", "left")
    ordered = each.groupBy("product", "need").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("offers", F.lit(0)).alias("offers"), "word"))).alias("w"))
    n, need = F.size("w"), F.col("need")
    # The most common k of the first words make the largest block.
    held = lambda k: F.aggregate(F.slice("w", n - need + 1, k), F.col("total").cast("double"), lambda x, w: x * w["offers"] / F.col("total"))
    level = F.lit(1)
    for k in range(2, MOST + 1):
        level = F.when((level == k - 1) & (need >= k) & (n - need + k <= AMONG[k]) & (held(k - 1) > hot), k).otherwise(level)
    rows = ordered.join(F.broadcast(total)).withColumn("k", level)  # total is one row
    first = F.transform(F.slice("w", 1, n - need + F.col("k")), lambda x: x["word"])
    rows = rows.select("product", F.transform("w", lambda x: x["word"]).alias("words"), "need", "k", first.alias("first"))
    return rows.withColumn("key", F.explode(F.coalesce(*[F.when(F.col("k") == k, _chosen(F.sort_array("first"), k)) for k in range(1, MOST + 1)])))


def met(bought: DataFrame, sold: DataFrame, hot: int) -> DataFrame:
    """product, offer and shared (how many words) of every pair of bought (product, words, need) and sold (offer, words) that
    shares as many words as the product needs.

    A pair is found in one block alone: that of the first of the product's words (or the first k) that the offer has. Pairs
    are never gathered, and blocks that stay large, as no second word is needed, are split by Spark as they are joined."""
    words = sold.select("offer", F.explode("words").alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("offers"))
    blocks = keyed(bought, counts, sold.agg(F.count(F.lit(1)).alias("total")), hot)
    # Which levels and words several-word blocks use at all; offers choose among these alone, and keep the keys that are there.
    used = blocks.filter("k > 1").select("k", F.explode("first").alias("word")).distinct()
    some = words.join(used.hint("merge"), "word").groupBy("offer", "k").agg(F.sort_array(F.collect_list("word")).alias("s"))
    several = some.select("offer", "k", F.explode(F.coalesce(*[F.when(F.col("k") == k, _chosen(F.col("s"), k)) for k in range(2, MOST + 1)])).alias("key"))
    several = several.join(blocks.filter("k > 1").select("k", "key").distinct().hint("merge"), ["k", "key"], "left_semi").join(sold.withColumnRenamed("words", "has").hint("merge"), "offer").select("offer", "has", "k", "key")
    single = sold.select("offer", F.col("words").alias("has"), F.lit(1).alias("k"), F.explode("words").alias("key"))
    found = blocks.join(single.unionByName(several).hint("merge"), ["k", "key"])
    own = F.array_join(F.sort_array(F.slice(F.array_intersect("first", "has"), 1, F.col("k"))), "\u0001")
    shared = F.size(F.array_intersect("words", "has"))
    return found.filter(F.col("key") == own).select("product", "offer", shared.alias("shared"), "need").filter("shared >= need").drop("need")


def linked(products: DataFrame, offers: DataFrame, product: str, source: str, offer: str, title: str, least: float = LEAST_OVERLAP, hot: int = HOT, digits: int | None = None) -> DataFrame:
    """product, offer and overlap of every pair in which the offer's title has at least that share of the product's words of
    three letters or more (each word once), rounded to digits if given. Products without such words are in no pair; null
    texts have none; a row that repeats a product or offer id counts with the words of all its rows.

    Words that more than hot offers hold are common, others rare. Pairs that share a rare word are few and found by it. All
    others depend on common words alone, and these repeat: each set of them is met with each other once, and then stands for
    all its products and offers. So a pair costs a row of a join, however many there are, and no pair is gathered. Joins are by
    sorting: a table's file tells too little of the size of its words for Spark to choose what to send to all."""
    taken = lambda rows, key, text, name: rows.select(F.col(key).alias(name), long_words(norm(F.col(text))).alias("w")).filter("size(w) > 0 and w[0] <> ''").groupBy(name).agg(F.array_distinct(F.flatten(F.collect_list("w"))).alias("words"))
    each = lambda rows, name: rows.select(name, F.explode("words").alias("word"))
    bought, sold = each(taken(products, product, source, "product"), "product"), each(taken(offers, offer, title, "offer"), "offer")
    # Offers' words that no product has are left out.
    counts = sold.groupBy("word").agg(F.count(F.lit(1)).alias("offers")).join(bought.select("word").distinct().hint("merge"), "word", "left_semi")
    gathered = F.array_sort(F.collect_list(F.struct(F.coalesce("offers", F.lit(0)).alias("offers"), "word"))).alias("w")
    mine = bought.join(counts.hint("merge"), "word", "left").groupBy("product").agg(gathered)
    theirs = sold.join(counts.hint("merge"), "word").groupBy("offer").agg(gathered)

    names = lambda w: F.transform(w, lambda x: x["word"])
    rare = names(F.filter("w", lambda x: (x["offers"] > 0) & (x["offers"] <= hot)))
    common = F.sort_array(names(F.filter("w", lambda x: x["offers"] > hot)))
    share = lambda shared: F.round(shared / F.col("n"), digits) if digits is not None else shared / F.col("n")
    mine = mine.select("product", F.size("w").alias("n"), _need(F.size("w"), least).alias("need"), "w", rare.alias("rare"), common.alias("common"))
    theirs = theirs.select("offer", names(F.col("w")).alias("has"), rare.alias("rare"), common.alias("common"))

    # By the first rare word that both have; one of the first n - need + 1 words is shared by whatever has enough of them.
    first = F.filter(F.slice("w", 1, F.col("n") - F.col("need") + 1), lambda x: (x["offers"] > 0) & (x["offers"] <= hot))
    few = mine.select("product", "n", "need", names(F.col("w")).alias("words"), names(first).alias("first")).withColumn("key", F.explode("first"))
    few = few.join(theirs.select("offer", "has", F.explode("rare").alias("key")).hint("merge"), "key").filter(F.col("key") == F.get(F.array_intersect("first", "has"), F.lit(0)))
    few = few.withColumn("shared", F.size(F.array_intersect("words", "has"))).filter("shared >= need").select("product", "offer", share(F.col("shared")).alias("overlap"))

    # By sets of common words. A set's name is its words; a product's has the number of all its words in front.
    marks = F.aggregate("rare", F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))))
    ours = mine.filter(F.size("common") >= F.col("need")).select("product", F.concat_ws("\u0001", F.col("n").cast("string"), "common").alias("ours"), F.col("rare").alias("mine_rare"), marks.alias("mine_marks"))
    others = theirs.filter(F.size("common") > 0).select("offer", F.array_join("common", "\u0001").alias("others"), F.col("rare").alias("their_rare"), marks.alias("their_marks"))
    split = F.split("product", "\u0001")
    own_sets = ours.select(F.col("ours").alias("product")).distinct().select("product", F.slice(split, 2, F.size(split)).alias("words"), _need(F.get(split, F.lit(0)).cast("int"), least).alias("need"))
    other_sets = others.select(F.col("others").alias("offer")).distinct().select("offer", F.split("offer", "\u0001").alias("words"))
    sets = met(own_sets, other_sets, hot).withColumn("n", F.substring_index("product", "\u0001", 1).cast("int"))
    sets = sets.select(F.col("product").alias("ours"), F.col("offer").alias("others"), share(F.col("shared")).alias("overlap"))
    # Pairs that share a rare word too are found above. Marks of 64 bits spare most pairs the look at their words.
    apart = (F.col("mine_marks").bitwiseAND(F.col("their_marks")) == 0) | ~F.arrays_overlap("mine_rare", "their_rare")
    many = ours.join(sets.hint("merge"), "ours").drop("ours").join(others.hint("merge"), "others").filter(apart).select("product", "offer", "overlap")
    return few.unionByName(many)
