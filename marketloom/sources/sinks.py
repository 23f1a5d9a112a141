"""Report writers: CSV with semicolons, audits of several schemas, and latest-row upserts."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only sessions of one machine may leave spark.checkpoint.dir unset."""
    folder, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="marketloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def pinned(rows: DataFrame) -> DataFrame:
    """rows, computed once, with the same partitions whenever they are read."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


def stored(rows: DataFrame) -> DataFrame:
    """rows, computed once and written as a table to the shared folder."""
    folder = f"{shared_folder(rows.sparkSession).rstrip('/')}/marketloom/{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    back = rows.sparkSession.read.schema(rows.schema).parquet(folder)
    back.folder = folder
    return back


def removed(*frames: DataFrame) -> None:
    """The folders of stored tables that nothing reads any more go."""
    for frame in frames:
        path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(frame.folder)
        path.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def write_csv(rows: DataFrame, path: str) -> None:
    """Part files with a header and semicolons, UTF-8."""
    rows.write.mode("overwrite").csv(path, header=True, sep=";", escape='"')


def schema_union(*tables: DataFrame) -> DataFrame:
    """All rows under all columns, in the order in which columns first appear; missing ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def upserted(rows: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Each key's row with the latest time; ties go by the row's hash, so reruns agree."""
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(ts), F.xxhash64(*rows.columns))
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
