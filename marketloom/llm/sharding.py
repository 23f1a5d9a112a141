"""Sharding into contiguous runs of text groups with the smallest possible largest shard, DataFrame functions only.

Rows with equal texts form one atomic group. Groups are ordered by the 64-bit hash of their text, so that a
group's place is known without a sort. The driver sees cells, runs of the hash order given by leading bits, with
their byte sums: a bounded number of them. A binary search over shard capacities checks each capacity greedily
on the cells; the cells that a cut may fall into are split further (only they are aggregated again) until each
holds one group, which makes the smallest feasible capacity exact. Cuts are then placed as evenly as that
capacity allows, and every row finds its shard by comparing its hash with the cuts.

Slots are gapless in a shard: rows are dealt to cells by the hash of their id, numbered within each cell, and
shifted by the sizes of the cells before.

Defined results: a null text counts as the empty text (size 1, crc 0); two texts with the same 64-bit hash would
share a group; rows that repeat an id are rows of their own; an empty table gives no rows; a null id is kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm import common

#: Bits of the hash that tell the first cells apart, and bits by which a cell is split further.
FIRST_BITS, MORE_BITS = 12, 8
#: Cells per shard for numbering rows.
SLOT_CELLS = 1024


def _cells(groups: DataFrame, bits: int, within: list[tuple[int, int]] | None) -> list:
    """(cell, bytes, groups, largest group) by the leading bits of the hash; within: (bits, cell) pairs to look into."""
    if within is not None:
        wanted = {}
        for b, cell in within:
            wanted.setdefault(b, []).append(cell)
        keep = F.lit(False)
        for b, cells in wanted.items():
            keep = keep | F.shiftright("h", 64 - b).isin(cells)
        groups = groups.filter(keep)
    return (
        groups.groupBy(F.shiftright("h", 64 - bits).alias("cell"))
        .agg(F.sum("bytes"), F.count(F.lit(1)), F.max("bytes"))
        .collect()
    )


def _greedy(ends: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Indexes after which to cut so that no run of cells exceeds capacity; None if shards do not suffice."""
    cuts, at = [], 0
    for _ in range(shards):
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + capacity, side="right"))
        if stop == at and at < len(ends):
            return None
        at = stop
        cuts.append(at)
    return cuts if at == len(ends) else None


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """The least capacity for which the greedy cut of these sizes, in this order, needs at most so many shards."""
    ends = np.cumsum(sizes)
    low, high = max(int(sizes.max()), -(-int(ends[-1]) // shards)), int(ends[-1])
    while low < high:
        middle = (low + high) // 2
        if _greedy(ends, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def even_cuts(sizes: np.ndarray, shards: int, capacity: int) -> list[int]:
    """Cut indexes with no run above capacity, each run as near as that allows to an even share of what is left."""
    ends = np.concatenate(([0], np.cumsum(sizes)))
    total, n = int(ends[-1]), len(sizes)
    latest_start = [n]  # latest_start[j]: the first index from which j shards still suffice
    for _ in range(shards):
        latest_start.append(int(np.searchsorted(ends, ends[latest_start[-1]] - capacity, side="left")))
    cuts, at = [], 0
    for left in range(shards, 0, -1):
        wish = ends[at] + (total - ends[at]) / left
        near = int(np.searchsorted(ends, wish, side="left"))
        if near > 0 and near <= n and wish - ends[near - 1] < ends[near] - wish:
            near -= 1
        most = int(np.searchsorted(ends, ends[at] + capacity, side="right")) - 1
        at = max(at, min(max(near, latest_start[left - 1]), most, n))
        cuts.append(at)
    return cuts


def plan_cuts(groups: DataFrame, shards: int) -> list[int]:
    """First hashes of the shards 1.. : rows with a smaller hash than the i-th belong to the shards before it.

    groups: one row per group, h (hash) and bytes.
    """
    found = {(FIRST_BITS, r[0]): (int(r[1]), r[2], int(r[3])) for r in _cells(groups, FIRST_BITS, None)}
    if not found:
        return []
    while True:
        keys = sorted(found, key=lambda k: k[1] << (64 - k[0]))
        sizes = np.array([found[k][0] for k in keys], dtype=np.int64)
        ends = np.cumsum(sizes)
        low = max(max(v[2] for v in found.values()), -(-int(ends[-1]) // shards))
        high = smallest_capacity(sizes, shards)
        open_cells = set()
        at = 0
        for i in range(1, shards):  # any capacity from low to high cuts between these two places
            at = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + low, side="right"))
            last = int(np.searchsorted(ends, i * high, side="right"))
            open_cells.update(range(at, min(last + 1, len(keys))))
        open_cells.update(np.flatnonzero(sizes > low).tolist())
        split = [keys[i] for i in open_cells if found[keys[i]][1] > 1 and keys[i][0] < 64]
        if low == high or not split:
            break
        bits = min(max(k[0] for k in split) + MORE_BITS, 64)
        for k in split:
            del found[k]
        found.update({(bits, r[0]): (int(r[1]), r[2], int(r[3])) for r in _cells(groups, bits, split)})
    cuts = even_cuts(sizes, shards, high)[:-1]
    return [(keys[c][1] << (64 - keys[c][0])) if c < len(keys) else 2**63 for c in cuts]


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, h (hash of the text), shard and slot for every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = common.materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
        ),
        "sizes",
    )
    cuts = plan_cuts(rows.groupBy("h").agg(F.sum("size").alias("bytes")), shards)
    number = F.lit(0)
    for first in cuts:
        if first < 2**63:
            number = number + (F.col("h") >= F.lit(first)).cast("int")
    placed = rows.withColumn("shard", number).withColumn(
        "cell", F.pmod(F.xxhash64("doc_id", F.lit("slot")), F.lit(SLOT_CELLS)).cast("int")
    )
    before = Window.partitionBy("shard").orderBy("cell")
    counted = placed.groupBy("shard", "cell").count()  # at most shards * SLOT_CELLS rows
    starts = counted.select("shard", "cell", (F.sum("count").over(before) - F.col("count")).alias("start"))
    within = Window.partitionBy("shard", "cell").orderBy("doc_id", "h")
    return (
        placed.join(F.broadcast(starts), ["shard", "cell"])
        .withColumn("slot", F.col("start") + F.row_number().over(within) - 1)
        .select("doc_id", "size", "text_crc32", "h", "shard", "slot")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(common.table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
