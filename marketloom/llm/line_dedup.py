"""Exact line deduplication across documents, with DataFrame functions only.

Each line's key (stripped, A-Z lower-cased) is hashed to 128 bits. The hashes are range-partitioned and sorted
by document and position within each key, and a window streams over them to tell each line its key's first
document. What comes back is a sparse bitmap of the lines to drop per document, 64 lines to a word, words
without a drop left out; texts are joined only by who asks for them.

A key with a large share of all lines would fill one range. Such keys (at most 1/HOT_SHARE of them can exist)
are dealt over many ranges by a salt, and their first document is the least of the salts' firsts.

Defined results: a null or empty text is one empty line; a null id counts as larger than all others; rows that
repeat an id are one document (its lines in either row stay); an id repeated with other text has its own bitmap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm import common

#: A key is hot from this share of all keyed lines on, so at most 1/HOT_SHARE keys are hot.
HOT_SHARE = 1 / 2000
#: ... and from this many lines on.
HOT_LINES = 2000
SALTS = 64


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(common.NO_ID)).alias("_id"),
        F.xxhash64(text).alias("_row"),
        text.alias("_text"),
    )


def keyed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """One row per line whose key has at least min_chars code points: _id, _row, pos, h1, h2."""
    key = common.ascii_lower(F.btrim(F.col("line"), F.lit(common.SPACES)))
    return (
        _documents(docs, id_col, text_col)
        .select("_id", "_row", F.posexplode(F.split("_text", "\n", -1)).alias("pos", "line"))
        .select("_id", "_row", "pos", key.alias("key"))
        .filter(F.char_length("key") >= min_chars)
        .select("_id", "_row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit(1)).alias("h2"))
    )


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """Per document that loses lines: _id, _row, n_dropped, words (map from pos div 64 to the bits of dropped lines)."""
    lines = common.materialize(keyed_lines(docs, id_col, text_col, min_chars), "lines")
    total = lines.count()
    least = max(HOT_LINES, int(total * HOT_SHARE))
    hot = lines.groupBy("h1").count().filter(F.col("count") >= least).select("h1", F.lit(True).alias("hot"))
    salted = lines.join(F.broadcast(hot), "h1", "left").withColumn(
        "salt", F.when(F.col("hot"), F.pmod(F.xxhash64("_id"), F.lit(SALTS))).otherwise(F.lit(0))
    )
    by_key = Window.partitionBy("h1", "salt", "h2").orderBy("_id", "pos")
    parts = max(common.shuffle_parts(docs.sparkSession), 1)
    streamed = (
        salted.repartitionByRange(parts, "h1", "salt")
        .sortWithinPartitions("h1", "salt", "h2", "_id", "pos")
        .withColumn("first", F.first("_id").over(by_key))
    )
    cold = streamed.filter(F.col("hot").isNull()).select("_id", "_row", "pos", "first")
    heads = (
        streamed.filter("hot").groupBy("h1", "h2").agg(F.min("first").alias("head"))
    )
    warm = lines.join(F.broadcast(heads), ["h1", "h2"]).select("_id", "_row", "pos", F.col("head").alias("first"))
    return (
        cold.unionByName(warm)
        .filter(F.col("first") < F.col("_id"))
        .groupBy("_id", "_row", F.expr("pos div 64").cast("int").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, pos % 64))").alias("bits"))
        .groupBy("_id", "_row")
        .agg(
            F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"),
            F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"),
        )
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped, words (null: nothing dropped) and the kept text, one row per row of docs."""
    maps = line_bitmaps(docs, id_col, text_col, min_chars)
    kept = F.expr(
        "array_join(filter(split(_text, '\n', -1), (x, i) -> "
        "(shiftrightunsigned(coalesce(words[cast(i div 64 as int)], 0L), i % 64) & 1L) = 0L), '\n')"
    )
    joined = _documents(docs, id_col, text_col).join(maps.hint("shuffle_hash"), ["_id", "_row"], "left")
    return joined.select(
        "doc_id",
        F.size(F.split("_text", "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        "words",
        F.when(F.col("words").isNull(), F.col("_text")).otherwise(kept).alias("text"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(common.table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), firsts AS (
  SELECT key, min(doc_id) AS first_id FROM keyed WHERE length(key) >= 10 GROUP BY key
), marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(f.first_id < k.doc_id, false) AS dropped
  FROM keyed k LEFT JOIN firsts f USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
