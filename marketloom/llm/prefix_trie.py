"""Prefix trie of conversations, by range minima over the LCPs of the sorted conversations.

Every conversation is a sequence of turn hashes (128 bits of role and text). The distinct sequences are sorted by a range
shuffle, so that those with a common prefix are neighbours, and numbered; a block has BLOCK neighbours. LCP[i] is how
many turns sequence i shares with the one before it. A prefix of depth d of sequence i is held by the sequences around i
over which no LCP is under d; over a sparse table of the LCPs' range minima each candidate prefix finds the ends of that
interval by two binary searches of its own, to the left and to the right, and no stack is kept. Its number of members,
least id, leaves and tokens are then differences of running sums (the least id: a second sparse table).

An interval may leave its block. Blocks tell of their open prefixes in partial sums, one row for each depth that a block
shares with its neighbour; a second sparse table, of the blocks' least LCPs, finds by the same search the block in which
such a prefix begins, and the partial sums meet there. Two numbers per block reach the driver: its least LCP and that of
its first sequence.

Whole member lists are hashed, not kept: ids are range-shuffled by sequence and id, tasks join up to CHUNK neighbours to
one text, and these texts are streamed through SHA-256 in order. A conversation that a third of all ids repeat is so
dealt over many tasks first, and only its texts, not its rows, follow each other in one.

Defined results: rows with a null conv_id take no part; null role and text are empty; turns are taken in the order of
turn (null first), equal ones in that of role, then of the text's hash, and repeated rows are turns of their own; other columns are ignored,
whatever their names; an empty table has no nodes, not even a root. One conversation's turns are held together in one
task, so a single conversation has to fit in its memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm import common

#: Neighbouring sequences whose LCPs have one sparse table; a task holds them in memory.
BLOCK = 16_384
#: Ids that are joined to one text.
CHUNK = 4096
#: Rows that a task gives out at once.
ROWS = 50_000
EMPTY = hashlib.sha256(b"").hexdigest()


def rebuilt(conversations: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """conv_id, turns: array of (h1, h2, chars). The first h turns of conversation c - c % group (h: unsigned crc32 of
    decimal c, modulo most), then the conversation's own after its first h."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("t"), part("role").alias("r"), part("text").alias("x"))
    # Only hashes are shuffled, no texts. The seeds lie in front, so that the two hashes are independent.
    hashed = rows.filter("c is not null").select("c", "t", "r", F.xxhash64(F.lit(1), "r", "x").alias("h1"), F.xxhash64(F.lit(2), "r", "x").alias("h2"), F.char_length("x").alias("chars"))
    order = Window.partitionBy("c").orderBy(F.col("t").asc_nulls_first(), "r", "h1", "h2")
    hashed = hashed.withColumn("p", F.row_number().over(order))
    turn = F.struct("p", "h1", "h2", "chars")
    whole = hashed.groupBy("c").agg(F.sort_array(F.collect_list(turn)).alias("own"))
    first = whole.filter(F.col("c") % group == 0).select(F.col("c").alias("base"), F.slice("own", 1, most - 1).alias("start"))
    told = whole.withColumns({"base": F.col("c") - F.col("c") % group, "h": (F.crc32(F.col("c").cast("string")) % most).cast("int")})
    joined = told.join(first, "base", "left")
    after = F.filter("own", lambda x: x["p"] > F.col("h"))
    start = F.filter(F.coalesce("start", F.array().cast("array<struct<p:int,h1:bigint,h2:bigint,chars:int>>")), lambda x: x["p"] <= F.col("h"))
    turns = F.transform(F.concat(start, after), lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["chars"].alias("chars")))
    return joined.select(F.col("c").alias("conv_id"), turns.alias("turns"))


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Runs of up to size ids of one sequence, as (k1, k2, first, n, ids); rows come in order."""
    held: list[int] = []
    key: tuple = ()
    out: list[tuple] = []

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(("k1", "k2", "first", "n", "ids"), r, strict=True)) for r in rows], _CHUNKS)

    for rows in batches:
        for k1, k2, c in zip(*(rows.column(i).to_pylist() for i in range(3)), strict=True):
            if (k1, k2) != key or len(held) >= size:
                if held:
                    out.append((*key, held[0], len(held), ",".join(map(str, held))))
                key, held = (k1, k2), []
            held.append(c)
        if len(out) >= ROWS // 10:
            yield batch(out)
            out = []
    if held:
        out.append((*key, held[0], len(held), ",".join(map(str, held))))
    if out:
        yield batch(out)


_CHUNKS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("ids", pa.string())])
_MEMBERS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("least", pa.int64()), ("n", pa.int64()), ("sha", pa.string())])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each sequence's least id, number of ids and their hash; its texts of ids come in order and are fed one by one."""
    key, least, n, sha = (), None, 0, hashlib.sha256()
    for rows in batches:
        out = []
        for k1, k2, first, count, ids in zip(*(rows.column(i).to_pylist() for i in range(5)), strict=True):
            if (k1, k2) != key:
                if key:
                    out.append((*key, least, n, sha.hexdigest()))
                key, least, n, sha = (k1, k2), first, 0, hashlib.sha256()
            elif n:
                sha.update(b",")
            sha.update(ids.encode())
            n += count
        yield pa.RecordBatch.from_pylist([dict(zip(_MEMBERS.names, r, strict=True)) for r in out], _MEMBERS)
    if key:
        yield pa.RecordBatch.from_pylist([dict(zip(_MEMBERS.names, (*key, least, n, sha.hexdigest()), strict=True))], _MEMBERS)


def members(sequences: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """k1, k2, least, n, sha of sequences (k1, k2, conv_id)."""
    parts = common.shuffle_parts(sequences.sparkSession)
    dealt = sequences.repartitionByRange(parts, "k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")
    chunks = dealt.mapInArrow(lambda b: _chunks(b, chunk), "k1 long, k2 long, first long, n long, ids string")
    met = chunks.repartition(parts, "k1", "k2").sortWithinPartitions("k1", "k2", "first")
    return met.mapInArrow(_members, "k1 long, k2 long, least long, n long, sha string")


def range_table(values: np.ndarray) -> list[np.ndarray]:
    """Level k has the minimum of the 2**k values from each place on."""
    table = [values]
    while 2 * (step := 1 << (len(table) - 1)) <= len(values):
        table.append(np.minimum(table[-1][:-step], table[-1][step:]))
    return table


def least_between(table: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The minimum from first to last, both included."""
    level = np.frexp(last - first + 1)[1] - 1
    out = np.empty(len(first), table[0].dtype)
    for k in np.unique(level):
        use = level == k
        out[use] = np.minimum(table[k][first[use]], table[k][last[use] - (1 << int(k)) + 1])
    return out


def right_end(table: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The last place up to which no value after `at` is under depth."""
    at = at.copy()
    for k in range(len(table) - 1, -1, -1):
        use = np.flatnonzero(at + (1 << k) < len(table[0]))
        at[use[table[k][at[use] + 1] >= depth[use]]] += 1 << k
    return at


def left_end(table: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The first place from which on to `at` no value but its own is under depth."""
    at = at.copy()
    for k in range(len(table) - 1, -1, -1):
        use = np.flatnonzero(at - (1 << k) >= 0)
        at[use[table[k][at[use] - (1 << k) + 1] >= depth[use]]] -= 1 << k
    return at


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The lengths of a column of turns, and the turns' h1, h2 and chars one after the other."""
    lists = column.combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
    flat = lists.flatten()
    return lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), [flat.field(n).to_numpy(zero_copy_only=False) for n in ("h1", "h2", "chars")]


#: kind 0: a whole node; 1: begins here and goes on in the next block; 2: the part of a node that began before.
_NODES = pa.schema([
    ("kind", pa.int8()), ("block", pa.int64()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("parent", pa.int8()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64()), ("before", pa.int64()), ("sha", pa.string()),
])
_NODE_SCHEMA = "kind byte, block long, depth long, conv_id long, parent_conv_id long, parent byte, n_convs long, n_children long, n_leaves long, saved long, before long, sha string"


def _block_nodes(table: pa.Table, first_lcp: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The nodes that begin in a block, and its parts of those that began before. first_lcp: by block, the LCP of its first
    sequence (-1 where none comes before) and, behind the last block, -1."""
    table = table.sort_by("pos")
    block = table["block"][0].as_py()
    own, after = int(first_lcp[block]), int(first_lcp[block + 1])
    length, (h1, h2, chars) = _flat(table["turns"])
    count, least = (table[c].to_numpy() for c in ("n", "least"))
    m, ends = len(length), np.cumsum(length)
    begins = ends - length
    # LCPs: turns of neighbours are compared place by place, and the first difference counts.
    both = np.minimum(length[1:], length[:-1])
    lcp = np.concatenate(([own], both))
    total = int(both.sum())
    if total:
        pair = np.repeat(np.arange(m - 1), both)
        k = np.arange(total) - np.repeat(np.cumsum(both) - both, both)
        x, y = begins[:-1][pair] + k, begins[1:][pair] + k
        differ = np.flatnonzero((h1[x] != h1[y]) | (h2[x] != h2[y]))
        np.minimum.at(lcp, pair[differ] + 1, k[differ])
    minima, ids = range_table(lcp), range_table(least)
    tokens = np.concatenate(([0], np.cumsum(chars.astype(np.int64))))
    upto = lambda i, d: tokens[begins[i] + np.maximum(d, 0)] - tokens[begins[i]]  # noqa: E731  code points of the first d turns of sequence i
    rank = np.arange(m)
    leaf = np.concatenate((lcp[1:], [after])) < length
    sums = {
        "n": count, "all": count * upto(rank, length), "new": upto(rank, length) - upto(rank, lcp), "leaves": leaf.astype(np.int64),
    }
    sums = {name: np.concatenate(([0], np.cumsum(v))) for name, v in sums.items()}
    over = lambda name, a, b: sums[name][b + 1] - sums[name][a]

    # Candidates: every prefix that the sequence before doesn't share begins here.
    new = length - lcp
    i = np.repeat(rank, new)
    base = np.cumsum(new) - new
    d = np.arange(len(i)) - base[i] + lcp[i] + 1
    left, right = left_end(minima, i, d), right_end(minima, i, d)  # left is i itself
    # A sequence's first new prefix hangs below one that began further left; the others below the one before them.
    up = d - 1
    at = left_end(minima, i, up)
    inside = (up >= 0) & (lcp[at] < up)  # else it began in an earlier block, or there is none above
    parent = np.where(inside, base[at] + up - lcp[at] - 1, -1)
    children = np.bincount(parent[inside], minlength=len(i))
    whole = ~((right == m - 1) & (after >= d))
    conv = least_between(ids, left, right) if len(i) else i
    settled = inside & whole[parent]
    before = upto(i, up)  # code points above the node
    saved = over("all", left, right) - over("new", left, right)  # of the interval; the prefix above it is taken off below
    saved = saved - np.where(whole, over("n", left, right) * before, 0) + (before - upto(i, lcp[i]))
    sha = np.where(d == length[i], np.array(table["sha"].to_pylist(), object)[i], EMPTY) if len(i) else np.array([], object)
    columns = [
        np.where(whole, 0, 1), np.full(len(i), block), d, conv, pa.array(np.where(settled, conv[parent], 0), pa.int64(), mask=~settled),
        np.where(up < 0, 0, np.where(inside, 1, 2)), over("n", left, right), children, over("leaves", left, right), saved, before, sha,
    ]
    for start in range(0, len(i), ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c[start : start + ROWS], t.type) if isinstance(c, np.ndarray) else c[start : start + ROWS] for c, t in zip(columns, _NODES, strict=True)], schema=_NODES)
    # Parts of nodes that began before: prefixes of the first sequence.
    for start in range(0, own + 1, ROWS):
        d = np.arange(start, min(own + 1, start + ROWS))
        zero = np.zeros(len(d), np.int64)
        right = right_end(minima, zero, d)
        begun = np.bincount(up[(up >= 0) & ~inside], minlength=own + 1)[d]
        columns = [zero + 2, zero + block, d, least_between(ids, zero, right), pa.nulls(len(d), pa.int64()), zero, over("n", zero, right), begun, over("leaves", zero, right), over("all", zero, right) - over("new", zero, right), zero, pa.nulls(len(d), pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) if isinstance(c, np.ndarray) else c for c, t in zip(columns, _NODES, strict=True)], schema=_NODES)
    yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip((3, block, int(lcp.min()), *[None] * 9), _NODES, strict=True)], schema=_NODES)


def _origins(batches: Iterator[pa.RecordBatch], lowest: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Adds the block in which each part's node begins: the nearest before it with an LCP under the part's depth."""
    minima = range_table(lowest)
    for batch in batches:
        block, depth, kind = (batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("block", "depth", "kind"))
        at = block.copy()
        part = np.flatnonzero(kind == 2)
        # After the search no block after the place found and before this one has such an LCP.
        at[part] = left_end(minima, block[part] - 1, depth[part])
        yield batch.append_column("origin", pa.array(at, pa.int64()))


def _lcp(x: Column, y: Column) -> Column:
    """How many elements two arrays have in common at their start."""
    at = F.array_position(F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q)), True)
    return F.when(at > 0, at - 1).otherwise(F.size(x))


def _numbered(sequences: DataFrame, size: int) -> tuple[DataFrame, np.ndarray]:
    """Sequences in their order with block and pos, and the LCP of each block's first sequence (-1 behind the last). A
    partition's rows are numbered as they are written; blocks don't cross partitions."""
    parts = common.shuffle_parts(sequences.sparkSession)
    number = F.monotonically_increasing_id()
    dealt = sequences.repartitionByRange(parts, "turns").sortWithinPartitions("turns")
    rows = common.materialize(dealt.withColumns({"pid": F.shiftright(number, 33).cast("int"), "pos": number.bitwiseAND(F.lit(2**33 - 1))}), "sequences")
    counts = {r.pid: r.n for r in rows.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each partition
    offset = np.zeros(max(counts, default=0) + 1, np.int64)
    held = np.array([-(-counts.get(p, 0) // size) for p in range(len(offset))])
    offset[1:] = np.cumsum(held)[:-1]
    spread = sequences.sparkSession.createDataFrame([(p, int(offset[p]), n) for p, n in counts.items()], "pid int, offset long, held long")
    rows = rows.join(F.broadcast(spread), "pid").withColumn("block", F.col("offset") + F.floor(F.col("pos") / size))
    last = rows.filter((F.col("pos") % size == size - 1) | (F.col("pos") == F.col("held") - 1)).select((F.col("block") + 1).alias("block"), F.col("turns").alias("before"))
    first = rows.filter(F.col("pos") % size == 0).select("block", "turns").join(last, "block")
    found = np.full(int(held.sum()) + 1, -1, np.int64)
    for r in first.select("block", _lcp(F.col("turns"), F.col("before")).alias("lcp")).collect():  # one row for each block
        found[r.block] = r.lcp
    return rows.select("block", "pos", "turns", "n", "least", "sha"), found


def nodes(sequences: DataFrame, size: int = BLOCK) -> DataFrame:
    """The trie's nodes. sequences: distinct turns (array of h1, h2, chars) with n (members), least (their least id), sha."""
    rows, first_lcp = _numbered(sequences, size)
    found = rows.groupBy("block").applyInArrow(lambda t: pa.Table.from_batches(list(_block_nodes(t, first_lcp)), _NODES), _NODE_SCHEMA)
    found = common.materialize(found, "nodes")
    lowest = np.full(len(first_lcp), -1, np.int64)
    for r in found.filter("kind = 3").select("block", "depth").collect():  # one row for each block
        lowest[r.block] = r.depth
    placed = found.filter("kind in (1, 2)").mapInArrow(lambda b: _origins(b, lowest), _NODE_SCHEMA + ", origin long")
    placed = common.materialize(placed, "parts")
    sum_of = lambda c: F.sum(c).alias(c)
    open_ = placed.groupBy("origin", "depth").agg(F.min("conv_id").alias("conv_id"), sum_of("n_convs"), sum_of("n_children"), sum_of("n_leaves"), sum_of("saved"), F.max("before").alias("before"), F.max("sha").alias("sha"))
    open_ = common.materialize(open_.withColumn("saved", F.col("saved") - F.col("n_convs") * F.col("before")), "open")
    # What a block's rows may hang below: its own open nodes (1) and those it holds a part of (2).
    above = placed.select("block", "kind", "depth", "origin").join(open_.select("origin", "depth", "conv_id"), ["origin", "depth"])
    above = above.select("block", F.col("kind").alias("parent"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("above"))
    begun = placed.filter("kind = 1").select("block", "parent", "depth").join(open_.withColumnRenamed("origin", "block"), ["block", "depth"])
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "sha"]
    kept = ["block", "parent", *columns]
    settled = found.filter("kind = 0 and (parent = 0 or parent_conv_id is not null)").select(*columns)
    unsettled = found.filter("kind = 0 and parent > 0 and parent_conv_id is null").unionByName(begun.withColumn("parent_conv_id", F.lit(None).cast("long")), allowMissingColumns=True)
    joined = unsettled.select(*kept).join(above, ["block", "parent", "depth"], "left").withColumn("parent_conv_id", F.col("above")).select(*columns)
    return settled.unionByName(joined).withColumnsRenamed({"saved": "saved_tokens", "sha": "ends_sha256"})


def prefix_trie(conversations: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = F.col("turns")
    whole = rebuilt(conversations).select("conv_id", "turns", F.xxhash64(F.lit(1), turns).alias("k1"), F.xxhash64(F.lit(2), turns).alias("k2"))
    whole = common.materialize(whole, "rebuilt")
    once = whole.groupBy("k1", "k2").agg(F.first("turns").alias("turns"))
    return nodes(once.join(members(whole.select("k1", "k2", "conv_id")), ["k1", "k2"]).drop("k1", "k2"), size)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(common.table(spark, sf_dir, "conversations"))


ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
           lambda v, b: list_reduce(list_prepend(xor(v, b), range(8)), lambda w, k: xor(w >> 1, (w & 1) * 3988292384)))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT i.conv_id, b.p, b.r, b.t FROM ids i JOIN turns b ON b.conv_id = i.conv_id - i.conv_id % 100 AND b.p <= i.h
  UNION ALL SELECT i.conv_id, t.p, t.r, t.t FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.p > i.h
), lists AS (
  SELECT conv_id, list({'r': r, 't': t} ORDER BY p) AS s FROM rebuilt GROUP BY conv_id
), sequences AS (
  SELECT conv_id, coalesce(s, []) AS s FROM ids LEFT JOIN lists USING (conv_id)
), prefixes AS (
  SELECT conv_id, d, list_slice(s, 1, d) AS node, d = len(s) AS ends FROM (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM sequences)
), nodes AS (
  SELECT d, node, min(conv_id) AS conv_id, count(*) AS n, CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * length(node[d].t) END AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY d, node
), children AS (
  SELECT d - 1 AS d, list_slice(node, 1, d - 1) AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2
), told AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.d = n.d AND c.node = n.node
), subtrees AS (
  SELECT k AS d, list_slice(node, 1, k) AS node, sum(saved) AS saved, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(d + 1)) AS k FROM told) GROUP BY 1, 2
)
SELECT t.conv_id, t.d::BIGINT AS depth, p.conv_id AS parent_conv_id, t.n::BIGINT AS n_convs, t.n_children::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, t.ends_sha256
FROM told t JOIN subtrees s ON s.d = t.d AND s.node = t.node LEFT JOIN nodes p ON p.d = t.d - 1 AND p.node = list_slice(t.node, 1, t.d - 1)
"""
