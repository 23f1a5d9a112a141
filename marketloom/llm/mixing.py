"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Every document of a source is wanted target/source_size times: a whole number of copies, the same for all
documents of the source, plus a fraction. Fractions are rounded pairwise: of two documents with open fractions,
words move from one to the other, in a random direction, until one fraction becomes 0 or 1. The chances of the
two directions keep each document's expected copies, and the words of the pair stay what they were, so a source
misses its target by less than one document. Documents are rounded in chunks of CHUNK; each chunk leaves one open
document, and the open documents of all chunks are rounded again, a reduction tree of fan-in CHUNK over the cluster.

Random numbers are hashes of ids, level and seed: reruns agree.

Defined results: a null text has no words and is taken 0 words; documents without words keep their expected whole
copies; rows that repeat an id are documents of their own; a source without words has target 0; the null source
comes last; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm import common

WEIGHTS = (1.0, 2.0, 3.0)
MOST_COPIES = 3
CHUNK = 64
#: Documents numbered together when chunks are cut.
BUCKET = 16 * CHUNK
#: A group with no more open items than this is finished by one chunk.
FINAL = 4 * CHUNK
#: Up to so many sources, their targets are broadcast; beyond it, joined by a shuffle.
BROADCAST_SOURCES = 20_000


def _numbered(sources: DataFrame) -> DataFrame:
    """Adds rank (from 0, by code point, null last) over a range-partitioned sort: no task holds all sources."""
    order = [F.col("source").asc_nulls_last()]
    parts = max(common.shuffle_parts(sources.sparkSession), 1)
    placed = common.materialize(
        sources.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "sources"
    )
    counts = sorted(placed.groupBy("part").count().collect())
    starts, at = [], 0
    for part, n in counts:
        starts.append(F.when(F.col("part") == part, F.lit(at)))
        at += n
    start = F.coalesce(*starts, F.lit(0)) if starts else F.lit(0)
    within = Window.partitionBy("part").orderBy(*order)
    return placed.withColumn("rank", start + F.row_number().over(within) - 1).drop("part")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target. sizes: source, size. The targets share all words by weight, none above most
    times its source's size: what a source cannot take is shared again among the others until none is above."""
    sources = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = common.materialize(_numbered(sources).withColumn("weight", weight).drop("rank"), "weights")
    room = F.col("source_size") * float(most)
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = room < F.col("weight") * level
        free, taken, n = ranked.agg(
            F.sum(F.when(~full, F.col("weight"))), F.sum(F.when(full, room)), F.count(F.when(full, 1))
        ).first()
        if n == capped or not free:
            break
        level, capped = (total - (taken or 0.0)) / free, n
    return ranked.select("source", "source_size", F.least(F.col("weight") * F.lit(level), room).alias("target"))


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(2**53)).cast("double") / float(2**53)


def _settled(item: Column, take: int) -> Column:
    return F.struct(item["key"].alias("key"), item["size"].alias("size"), F.lit(take).alias("take"), item["body"].alias("body"))


def _still_open(item: Column, p: Column) -> Column:
    return F.struct(item["size"].alias("size"), item["key"].alias("key"), p.alias("p"), item["body"].alias("body"))


def _pair(state: Column, x: Column, seed: int) -> Column:
    """One step of the rounding: the open document of state meets x."""
    r = state["open"]
    up, down = (1.0 - r["p"]) * r["size"], r["p"] * r["size"]
    x_up, x_down = (1.0 - x["p"]) * x["size"], x["p"] * x["size"]
    raise_r, lower_r = F.least(up, x_down), F.least(down, x_up)
    raised = _uniform(r["key"], x["key"], F.lit(seed)) * (raise_r + lower_r) < lower_r

    def outcome(done: Column, left: Column) -> Column:
        return F.struct(left.alias("open"), F.concat(state["done"], F.array(done)).alias("done"))

    return (
        F.when(raised & (up <= x_down), outcome(_settled(r, 1), _still_open(x, x["p"] - raise_r / x["size"])))
        .when(raised, outcome(_settled(x, 0), _still_open(r, r["p"] + raise_r / r["size"])))
        .when(down <= x_up, outcome(_settled(r, 0), _still_open(x, x["p"] + lower_r / x["size"])))
        .otherwise(outcome(_settled(x, 1), _still_open(r, r["p"] - lower_r / r["size"])))
    )


def pivotal_round(items: DataFrame, groups: list[str], seed: int = 0) -> DataFrame:
    """key, size, take (0 or 1), body and the group columns for items: key long, size > 0, 0 < p < 1, body.

    Within a group the sum of size * take differs from the sum of size * p by less than one item's size. Items
    are chunked with items of like size and each chunk goes from large to small, which leaves a small item open."""
    kind = items.schema["body"].dataType.simpleString()
    item = f"struct<size:bigint,key:bigint,p:double,body:{kind}>"
    done = f"array<struct<key:bigint,size:bigint,take:int,body:{kind}>>"
    level, finished, last = 0, None, False
    while not last:
        of = [F.col(g).alias(f"_of_{g}") for g in groups]
        last = (items.groupBy(*of).count().agg(F.max("count")).first()[0] or 0) <= FINAL
        scale = F.lit(0) if last else F.floor(4 * F.log2("size")).cast("int")
        items = items.withColumn("_scale", scale)
        sizes = items.groupBy(*of, F.col("_scale").alias("_of__scale")).agg(F.count(F.lit(1)).alias("_n"))
        spread = _join_sources(items, sizes, [*groups, "_scale"], sizes.count())
        bucket = F.lit(0) if last else F.pmod(F.xxhash64("key", F.lit(seed + level)), F.ceil(F.col("_n") / BUCKET))
        within = Window.partitionBy(*groups, "_scale", "_bucket").orderBy("key")
        folded = (
            spread.withColumn("_bucket", bucket)
            .withColumn("_chunk", F.floor((F.row_number().over(within) - 1) / (FINAL if last else CHUNK)))
            .groupBy(*groups, "_scale", "_bucket", "_chunk")
            .agg(F.sort_array(F.collect_list(F.struct("size", "key", "p", "body")), asc=False).alias("_items"))
            .select(
                *groups,
                F.aggregate(
                    F.slice("_items", 2, FINAL),
                    F.struct(F.col("_items")[0].cast(item).alias("open"), F.array().cast(done).alias("done")),
                    lambda state, x: _pair(state, x, seed + level),
                ).alias("_state"),
            )
        )
        folded = common.materialize(folded, "rounding")
        settled = folded.select(*groups, F.explode("_state.done").alias("_d")).select(*groups, "_d.*")
        items = folded.select(*groups, "_state.open.*")
        if last:  # one open item per group: it is drawn by itself
            take = (_uniform(F.col("key"), F.lit(seed - 1)) < F.col("p")).cast("int")
            settled = settled.unionByName(items.select(*groups, "key", "size", take.alias("take"), "body"))
        finished = settled if finished is None else finished.unionByName(settled)
        level += 1
    return finished


def _join_sources(rows: DataFrame, sources: DataFrame, columns: list[str], n: int) -> DataFrame:
    """Joins what sources (n rows, keyed by _of_<column>, nulls equal) says; broadcast only while n is small."""
    on = F.lit(True)
    for c in columns:
        on = on & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    joined = rows.join(F.broadcast(sources) if n <= BROADCAST_SOURCES else sources, on)
    return joined.drop(*[f"_of_{c}" for c in columns])


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple = WEIGHTS, most: int = MOST_COPIES, seed: int = 7) -> DataFrame:
    """doc_id, source, row (hash of the text), size, source_size, target and copies for every row of docs."""
    rows = common.materialize(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("row"),
            common.word_count(F.col(text_col)).alias("size"),
        ),
        "words",
    )
    targets = common.materialize(source_targets(rows, weights, most), "targets")
    wanted = _join_sources(rows, targets.withColumnRenamed("source", "_of_source"), ["source"], targets.count())
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(ratio + 1e-12)
    wanted = wanted.withColumn("whole", whole.cast("int")).withColumn("p", F.greatest(ratio - whole, F.lit(0.0)))
    fixed = (F.col("size") == 0) | (F.col("p") <= 1e-12)
    certain = wanted.filter(fixed).select("doc_id", "source", "row", "size", "source_size", "target", F.col("whole").alias("copies"))
    body = F.struct("doc_id", "row", "source_size", "target", "whole")
    items = wanted.filter(~fixed).select("source", F.xxhash64("doc_id", "row").alias("key"), "size", "p", body.alias("body"))
    rounded = pivotal_round(items, ["source"], seed).select(
        "body.doc_id", "source", "body.row", "size", "body.source_size", "body.target", (F.col("body.whole") + F.col("take")).alias("copies")
    )
    return certain.unionByName(rounded)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken")
    )
