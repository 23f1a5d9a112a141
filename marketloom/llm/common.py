"""What the corpus operators share: reading tables, shared folders, and small expressions."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import words

#: The bytes that separate words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Stands for a null id wherever ids are compared: larger than any other.
NO_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:  # only sessions of one machine, such as tests, leave it unset
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="marketloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/marketloom/{tag}-{uuid.uuid4().hex}"


#: Lets Spark remove the shuffle files of a query as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: computed once, and safe when executors are lost. The shuffle files
    of the write go when it has ended, as nothing else reads them."""
    path, conf = shared_path(df.sparkSession, tag), df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.folder = path
    return back


def discard(*frames: DataFrame) -> None:
    """Removes the folders of materialized frames that nothing reads any more, and lets the driver drop what only they
    needed."""
    for frame in frames:
        jvm = frame.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(frame.folder)
        path.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    if frames:
        frames[0].sparkSession._jvm.System.gc()


def quoted(name: str) -> Column:
    """A column by its whole name, points in it or not."""
    return F.col("`" + name.replace("`", "``") + "`")


def filtered(docs: DataFrame, keep) -> DataFrame:
    """docs with what keep leaves of its batches, whatever its columns are called; keep goes by their places."""

    def kept(batches):
        yield from keep(batches)
        words.release()  # workers wait with what they hold

    inner = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    return inner.mapInArrow(kept, inner.schema).toDF(*docs.columns)


#: Rows of one long that may be broadcast.
BROADCAST_KEYS = 500_000


def only(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows, less those whose key isn't among the keys (materialized and distinct), as far as these are few enough to be
    broadcast; so that what follows shuffles less."""
    return rows.join(F.broadcast(keys), key, "left_semi") if keys.count() <= BROADCAST_KEYS else rows


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """How many maximal runs of characters other than SPACES; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def even_labels(spark: SparkSession, parts: int) -> list[int]:
    """Numbers that repartition(parts, label) deals one to each partition."""
    found: dict[int, int] = {}
    n = 8 * parts
    while len(found) < parts:
        label = F.col("id").cast("int")
        rows = spark.range(n).groupBy(F.pmod(F.hash(label), F.lit(parts)).alias("p")).agg(F.min(label)).collect()
        found, n = {r[0]: r[1] for r in rows}, 4 * n
    return [found[p] for p in range(parts)]


def smallest_hashes(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The rows with the smallest hashes of keys, at most so many. A cut-off taken from the count keeps all but about
    that many rows from being sorted, so that no task gets more, however many partitions there are."""
    n, bits = rows.count(), 2**40
    h = F.pmod(F.xxhash64(*keys), F.lit(bits))
    if n > most:
        rows = rows.filter(h < int(bits * min(1.0, (most + 8 * most**0.5 + 8) / n)))
    return rows.orderBy(h, *keys).limit(most)
