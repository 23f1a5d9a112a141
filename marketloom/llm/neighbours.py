"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing, exact reranking.

Vectors are extended by one coordinate to the largest norm, which makes the largest inner product the least
Euclidean distance. TABLES tables hash by floor((a.x + b) / WIDTH) in Gaussian directions, slots clipped to SLOTS. The
number of directions grows with the logarithm of the number of vectors, so buckets stay small. For a query, the chance
that a neighbour at distance reach (fitted on at most SAMPLE vectors) falls into a bucket is the product over
directions of the normal probability of the bucket's slot. Buckets are visited in the order of that chance: all down to
the chance that a neighbour's own bucket falls short of with probability 1 - success, where success is taken so
that all tables together find SUCCESS. This cut is drawn from the query's slot probabilities alone (DRAWS draws), so no list
of buckets reaches the driver. Candidates of all tables are merged and ranked by the inner product of the original
vectors in double precision. In each split a query visits at least as many buckets as it asks neighbours.

The first directions of a table name a vector's group; groups (at most SLOTS^LEAD a table, LEAD growing with the number of vectors)
are counted on the driver and dealt to splits of about SPLIT vectors, so no task holds a hot bucket whole. A query
goes only to the groups in which some bucket could have a chance above its cut.

Defined results: vectors that are null, zero, of another length than most, or with null or non-finite components
take no part; rows that repeat id and vector count once; rows with one id and several vectors are one query and one
candidate with the best of their scores; fewer candidates than k: all that are met; ties go to the smaller vec_id; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm import common

TABLES, WIDTH, SLOTS = 2, 0.7, 6
#: Directions of a table at least; from 256 vectors on, the binary logarithm of their number.
LEAST_HASHES = 8
#: Leading directions name groups while these hold more than so many vectors on average.
GROUP_VECTORS, MOST_LEAD = 65_536, 6
SUCCESS = 0.94
SAMPLE, DRAWS = 4096, 400
SPLIT, QUERIES, CHUNK = 16_384, 256, 2048
SEED = 11


def _normal(z: np.ndarray) -> np.ndarray:
    """The normal distribution function, to 1e-7 (Abramowitz and Stegun 7.1.26)."""
    x = np.minimum(np.abs(z), 30) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-x * x) / 2
    return np.where(z > 0, 1 - tail, tail)


class Hasher:
    def __init__(self, width: int, norm: float, reach: float, n: int) -> None:
        rng = np.random.default_rng(SEED)
        self.norm, self.reach = norm, reach
        self.hashes = max(LEAST_HASHES, math.ceil(math.log2(max(n, 2))))
        self.lead = min(MOST_LEAD, max(0, math.ceil(math.log(max(n / GROUP_VECTORS, 1), SLOTS))))
        self.a = rng.standard_normal((TABLES, self.hashes, width + 1)) / norm
        self.b = rng.uniform(0, WIDTH, (TABLES, self.hashes))
        self.success = 1 - (1 - SUCCESS) ** (1 / TABLES)

    def project(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Places on the lines, by vector, table and direction."""
        size = np.linalg.norm(x, axis=1, keepdims=True)
        if query:
            x, last = x * (self.norm / size), np.zeros((len(x), 1))
        else:
            last = np.sqrt(np.maximum(self.norm**2 - size**2, 0))
        return np.einsum("nd,thd->nth", np.concatenate((x, last), axis=1), self.a, optimize=True) + self.b

    def slots(self, x: np.ndarray) -> np.ndarray:
        """The slots of vectors, by vector, table and direction: a bucket is all slots of a table."""
        return np.clip(np.floor(self.project(x) / WIDTH) + SLOTS // 2, 0, SLOTS - 1).astype(np.uint8)

    def groups(self, slots: np.ndarray) -> np.ndarray:
        """The group of each vector in each table."""
        return (slots[:, :, : self.lead].astype(np.int64) * SLOTS ** np.arange(self.lead)).sum(axis=2)

    def chances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log chances of the slots, by query, table, direction and slot; and the cuts, by query and table."""
        edges = (np.arange(SLOTS + 1) - SLOTS // 2) * WIDTH
        edges[0], edges[-1] = -np.inf, np.inf
        # All vectors have one norm, so a neighbour's place, given the query's, has this mean and deviation.
        cosine = 1 - self.reach**2 / 2
        mean = cosine * (self.project(x, True) - self.b) + self.b
        p = np.maximum(np.diff(_normal((edges - mean[..., None]) / math.sqrt(1 - cosine**2)), axis=3), 1e-9)
        logp, upto = np.log(p), np.cumsum(p, axis=3)[..., :-1]
        drawn = np.random.default_rng(SEED).random((DRAWS, 1, 1, self.hashes, 1))
        cuts = np.empty(logp.shape[:2])
        for i in range(len(x)):
            at = (drawn > upto[i] / p[i].sum(axis=2, keepdims=True)).sum(axis=4)[:, 0]  # draw, table, direction
            cuts[i] = np.quantile(np.take_along_axis(logp[i][None], at[..., None], axis=3)[..., 0].sum(axis=2), 1 - self.success, axis=0)
        return logp, cuts - 1e-9


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    v = F.col(vector_col).cast("array<double>")
    good = (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
        .filter("vec_id is not null and v is not null and size(v) > 0")
        .filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    )
    most = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return (good, 0) if most is None else (good.filter(F.size("v") == most[0]), most[0])


def _matrix(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
    return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), flat.reshape(-1, width).astype(np.float64)


def _grouped(batches: Iterator[pa.RecordBatch], shared, width: int) -> Iterator[pa.RecordBatch]:
    """How many vectors of a batch fall into each group."""
    for batch in batches:
        groups = shared.value.groups(shared.value.slots(_matrix(batch, width)[1]))
        for t in range(TABLES):
            group, n = np.unique(groups[:, t], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(group), t)), pa.array(group), pa.array(n)], names=["t", "g", "n"])


_DEALT = "label int, part int, kind byte, ids binary, vectors binary, hashed binary"


def _dealt(batches: Iterator[pa.RecordBatch], shared, width: int, every: int, first: np.ndarray, count: np.ndarray, labels: list[int]) -> Iterator[pa.RecordBatch]:
    """Packed rows for the parts: kind 0 vectors with their slots, kind 1 queries with their slots' chances and cuts.
    first and count: the splits of each table's groups."""
    hasher: Hasher = shared.value
    types = [pa.int32(), pa.int32(), pa.int8(), pa.binary(), pa.binary(), pa.binary()]

    def row(part: int, kind: int, *arrays: np.ndarray) -> pa.RecordBatch:
        values = [labels[part % len(labels)], part, kind, *[np.ascontiguousarray(x).tobytes() for x in arrays]]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=[c.split()[0] for c in _DEALT.split(", ")])

    lead = np.arange(SLOTS**hasher.lead)[:, None] // SLOTS ** np.arange(hasher.lead) % SLOTS
    for batch in batches:
        ids, x = _matrix(batch, width)
        slots = hasher.slots(x)
        groups = hasher.groups(slots)
        spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
        for t in range(TABLES):
            part = first[t, groups[:, t]] + (spread * count[t, groups[:, t]] >> 31)
            for p, pick in _runs(part):
                yield row(p, 0, ids[pick], x[pick], slots[pick, t])
        asked = np.flatnonzero(ids % every == 0)
        for at in range(0, len(asked), QUERIES):
            q = asked[at : at + QUERIES]
            logp, cuts = hasher.chances(x[q])
            for t in range(TABLES):
                most = logp[:, t, hasher.lead :].max(axis=2).sum(axis=1)[:, None] + logp[:, t, np.arange(hasher.lead), lead].sum(axis=2)
                chances = np.concatenate((logp[:, t].reshape(len(q), -1), cuts[:, t, None]), axis=1).astype(np.float32)
                group, who = np.nonzero(((most >= cuts[:, t, None]) & (count[t] > 0)).T)
                for g, pick in _runs(group):
                    for s in range(count[t, g]):
                        yield row(int(first[t, g]) + s, 1, ids[q[who[pick]]], x[q[who[pick]]], chances[who[pick]])


def _runs(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value with the places that hold it."""
    order = np.argsort(values, kind="stable")
    value, start = np.unique(values[order], return_index=True)
    yield from zip(value.tolist(), np.split(order, start[1:]), strict=True) if len(value) else ()


class Split:
    """The vectors of a split in order of bucket and id, repeated rows once, and their buckets."""

    def __init__(self, rows: list[dict], width: int, hashes: int) -> None:
        ids = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in rows])
        x = np.concatenate([np.frombuffer(r["vectors"]).reshape(-1, width) for r in rows])
        slots = np.concatenate([np.frombuffer(r["hashed"], np.uint8).reshape(-1, hashes) for r in rows])
        order = np.lexsort((*x.T[:2], ids, *slots.T))
        ids, x, slots = ids[order], x[order], slots[order]
        again = np.zeros(len(ids), bool)
        again[1:] = (ids[1:] == ids[:-1]) & (x[1:] == x[:-1]).all(axis=1)
        self.ids, self.x, slots = ids[~again], x[~again], slots[~again]
        new = np.ones(len(self.ids), bool)
        new[1:] = (slots[1:] != slots[:-1]).any(axis=1)
        self.bucket, self.size = np.cumsum(new) - 1, np.diff(np.append(np.flatnonzero(new), len(new)))
        self.repeats = len(self.ids) - len(np.unique(self.ids))
        #: By bucket: which slot of each direction it has.
        self.has = np.zeros((hashes * SLOTS, len(self.size)), np.float32)
        for j in range(hashes):
            self.has[j * SLOTS + slots[new][:, j], np.arange(len(self.size))] = 1

    def search(self, ids: np.ndarray, q: np.ndarray, chances: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(place of the query, id, score) of each query's k nearest in the buckets that it visits, and how many vectors
        these hold in all."""
        chance, cut = chances[:, :-1] @ self.has, chances[:, -1:]
        least = min(len(self.size), k + 1 + self.repeats)  # a bucket holds a vector at least
        visit = chance >= np.minimum(cut, -np.partition(-chance, least - 1, axis=1)[:, least - 1 : least])
        rows, found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        enough = np.full(len(ids), -np.inf)  # the k-th best score so far
        for a in range(0, len(self.ids), CHUNK):
            b = min(a + CHUNK, len(self.ids))
            who = np.flatnonzero(visit[:, self.bucket[a] : self.bucket[b - 1] + 1].any(axis=1))
            if not len(who):
                continue
            s = q[who] @ self.x[a:b].T
            s[~visit[who][:, self.bucket[a:b]] | (ids[who][:, None] == self.ids[a:b])] = -np.inf
            names = self.ids[a:b]
            if self.repeats:  # the best of each id
                order = np.argsort(names, kind="stable")
                names, start = np.unique(names[order], return_index=True)
                s = np.maximum.reduceat(s[:, order], start, axis=1)
            low = enough[who]
            if len(names) > k and (low == -np.inf).any():
                low = np.maximum(low, -np.partition(-s, k - 1, axis=1)[:, k - 1])
            i, j = np.nonzero((s >= low[:, None] - 1e-9) & (s > -np.inf))
            rows, found, scores = np.concatenate((rows, who[i])), np.concatenate((found, names[j])), np.concatenate((scores, s[i, j]))
            order = np.lexsort((-scores, found, rows))
            rows, found, scores = rows[order], found[order], scores[order]
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])
            order = np.flatnonzero(new)[np.lexsort((found[new], -np.round(scores[new], 12), rows[new]))]
            rank = np.arange(len(order)) - np.searchsorted(rows[order], rows[order])
            enough[rows[order[rank == k - 1]]] = scores[order[rank == k - 1]]
            rows, found, scores = rows[order[rank < k]], found[order[rank < k]], scores[order[rank < k]]
        return rows, found, scores, int((visit @ self.size).sum())


def _searched(batches: Iterator[pa.RecordBatch], shared, width: int, k: int) -> Iterator[pa.RecordBatch]:
    part, held, split = None, [], None
    for row in (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
        if row["part"] != part:
            part, held, split = row["part"], [], None
        if row["kind"] == 0:
            held.append(row)
            continue
        if split is None and held:  # all vectors of a part come before its queries
            split, held = Split(held, width, shared.value.hashes), []
        if split is not None:
            ids, q = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"]).reshape(-1, width)
            who, found, scores, _ = split.search(ids, q, np.frombuffer(row["hashed"], np.float32).reshape(len(ids), -1), k)
            yield pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(found), pa.array(scores)], names=["query_id", "vec_id", "score"])


def fitted(usable: DataFrame, width: int, k: int) -> Hasher:
    """The hash functions for a table of usable vectors; reach is fitted on at most SAMPLE of them."""
    n, norm = usable.agg(F.count(F.lit(1)), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()
    drawn = np.array([r[0] for r in common.smallest_hashes(usable, ["vec_id"], SAMPLE).select("v").collect()])
    return Hasher(width, norm, _reach(drawn, norm, k, n), n)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by every, its k nearest found among all others."""
    spark = vectors.sparkSession
    usable, width = _usable(vectors, id_col, vector_col)
    if not width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    usable = common.materialize(usable, "vectors")
    hasher = fitted(usable, width, k)
    shared = spark.sparkContext.broadcast(hasher)
    count = np.zeros((TABLES, SLOTS**hasher.lead), np.int64)
    for t, g, n in usable.mapInArrow(lambda b: _grouped(b, shared, width), "t long, g long, n long").groupBy("t", "g").agg(F.sum("n")).collect():
        count[t, g] = -(-n // SPLIT)
    first = (np.cumsum(count) - count.ravel()).reshape(count.shape)
    labels = common.even_labels(spark, common.shuffle_parts(spark))
    dealt = usable.mapInArrow(lambda b: _dealt(b, shared, width, every, first, count, labels), _DEALT)
    met = dealt.repartition(len(labels), "label").sortWithinPartitions("part", "kind")
    met = met.mapInArrow(lambda b: _searched(b, shared, width, k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "vec_id")
    once = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _reach(drawn: np.ndarray, norm: float, k: int, n: int) -> float:
    """A distance, of vectors scaled to norm 1, that the k-th neighbour among n vectors is about within: taken from a sample, whose
    order statistics of the same rank by share are read off."""
    some = drawn[:256]
    size = np.linalg.norm(some, axis=1, keepdims=True)
    inner = np.sort((some / size) @ (drawn / norm).T, axis=1)[:, ::-1]
    at = min(inner.shape[1] - 1, max(1, round(k * len(drawn) / max(n, 1))))
    return float(np.sqrt(np.maximum(2 - 2 * np.median(inner[:, at]), 1e-4)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(common.table(spark, sf_dir, "embeddings"))
