"""Paths of nodes in tables of parents, by pointer doubling: as many rounds as the logarithm of the deepest path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.sources.sinks import removed, stored


def _step(rows: DataFrame, carry) -> DataFrame:
    """Each row goes on to where its up leads."""
    theirs = rows.select(*[F.col(c).alias(f"_{c}") for c in rows.columns])
    joined = rows.join(theirs, F.col("up") == F.col("_id"), "left")
    return stored(joined.select("id", F.col("_up").alias("up"), *[e.alias(c) for c, e in carry.items()]))


def _doubled(rows: DataFrame, carry, rounds: int | None = None) -> DataFrame:
    """rows: id, up (an id or null) and more. Until no row has an up left, or for so many rounds, each row goes on to where its
    up leads; carry gives the other columns, by name, of mine and theirs (with _) joined. Every round is written."""
    rows, n = stored(rows), 0
    while (n < rounds) if rounds is not None else not rows.filter("up is not null").isEmpty():
        last, rows, n = rows, _step(rows, carry), n + 1
        removed(last)
    return rows


def _cycles(rows: DataFrame) -> DataFrame:
    """The ids on cycles. Fewer and fewer places are reached after more and more steps; once a round loses none of them, they
    are led to each other, and only cycles do that."""
    rows = stored(rows.select("id", "up"))
    reached = stored(rows.select(F.col("up").alias("id")).filter("id is not null").distinct())
    while n := reached.count():
        last, before, rows = rows, reached, _step(rows, {})
        reached = stored(rows.join(reached, "id", "left_semi").select(F.col("up").alias("id")).filter("id is not null").distinct())
        removed(last, before)
        if reached.count() == n:
            break
    return reached


def paths(nodes: DataFrame, node: str = "id", parent: str = "parent", name: str = "name", separator: str = " / ") -> DataFrame:
    """id and path of each node: the names from its root down to it. Parents of any depth; a parent that isn't a node ends the
    path, nameless nodes are passed over, and in a cycle the path ends where a node would come again. Nodes without an id
    are left out; of rows with one id that with the largest parent and name counts."""
    given = nodes.select(F.col(node).alias("id"), F.col(parent).alias("up"), F.coalesce(F.col(name), F.lit("")).alias("name")).filter("id is not null")
    once = given.groupBy("id").agg(F.max(F.struct(F.col("up").isNotNull().alias("_"), "up", "name")).alias("x")).select("id", "x.up", "x.name")
    once = stored(once)
    known = once.select(F.col("id").alias("_up"))
    rows = stored(once.join(known, F.col("up") == F.col("_up"), "left").select("id", F.col("_up").alias("up"), "name"))
    cycle = _cycles(rows)
    size = cycle.count()
    # A cycle is cut before its least node, so that all is a forest; what was cut off is put back by the order of the cycle.
    if size:
        ring = cycle.join(rows, "id").select("id", "up", F.col("id").alias("least"))
        ring = _doubled(ring, {"least": F.least("least", "_least")}, size.bit_length()).select("id", "least")
        rows = rows.join(ring, "id", "left").withColumn("up", F.when(F.col("up").eqNullSafe(F.col("least")), None).otherwise(F.col("up")))
    else:
        rows = rows.withColumn("least", F.lit(None).cast(rows.schema["id"].dataType))
    rows = rows.select("id", "up", F.array("name").alias("names"), F.when(F.col("least").isNotNull(), 1).otherwise(0).alias("on"), "least")
    carry = {"names": F.concat("names", F.coalesce("_names", F.array().cast("array<string>"))), "on": F.col("on") + F.coalesce("_on", F.lit(0)), "least": F.coalesce("least", "_least")}
    found = _doubled(rows, carry)
    if size:  # the cycle's nodes before the one at which a path enters it come last
        whole = found.join(cycle, "id", "left_semi").filter("id = least").select(F.col("id").alias("_of"), F.col("names").alias("_all"))
        found = found.join(whole, F.col("least") == F.col("_of"), "left")
        found = found.withColumn("names", F.when(F.col("_of").isNotNull(), F.concat("names", F.slice("_all", 1, F.greatest(F.lit(0), F.size("_all") - F.col("on"))))).otherwise(F.col("names")))
    return found.select("id", F.array_join(F.reverse(F.filter("names", lambda x: x != "")), separator).alias("path"))
