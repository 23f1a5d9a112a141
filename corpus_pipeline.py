"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, mixing and sharding, one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import common, decontamination, mixing, ngram_join, sharding, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scoring at or above the threshold go."""
    return toxicity.drop_toxic(docs, toxicity.fitted(spark, sf_dir, docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents one row stays: that with the smallest id (null is largest), of equal ids the text
    with the smallest hash, and of equal rows one. Documents without words stay, every one."""
    named = ["_id", "_row"]
    of = [F.coalesce(F.col("doc_id").cast("long"), F.lit(common.NO_ID)).alias("_id")]
    found = ngram_join.join_similar(docs).filter(F.col("group").isNotNull()).select(*of, F.col("row").alias("_row"), "group")
    found = common.materialize(found, "grouped")
    first = found.groupBy("group").agg(F.min(F.struct(*named)).alias("first"))
    gone = found.join(first, "group").filter(F.struct(*named) != F.col("first")).select(*named).distinct()
    again = found.groupBy(*named).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*named)
    rows = docs.select(F.struct(*map(common.quoted, docs.columns)).alias("_doc"), *of, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_row"))
    kept = rows.join(gone, named, "left_anti")
    once = kept.join(again, named, "left_semi").groupBy(*named).agg(F.first("_doc").alias("_doc"))  # few: equal rows that stay
    return kept.join(again, named, "left_anti").select("_doc.*").unionByName(once.select("_doc.*"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it (rows that repeat id and text are taken alike); documents
    without words, which a mix cannot count, stay once."""
    taken = mixing.mix(docs).groupBy(F.col("doc_id").alias("_id"), "row").agg(
        F.max(F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("copies"))).cast("int").alias("_copies")
    )
    row = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select(F.struct(*map(common.quoted, docs.columns)).alias("_doc"), F.col("doc_id").alias("_of"), row.alias("_text"))  # whatever docs' columns are called
    joined = rows.join(taken.filter("_copies > 0").hint("shuffle_hash"), F.col("_of").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("row")))
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_doc.*")


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every row: doc_id, size, text_crc32, shard and slot."""
    return sharding.shard(docs).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The mix draws by hashes and the toxicity model is fitted, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's rows are written to the shared folder and read by the next."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
