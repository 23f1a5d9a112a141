"""Near-duplicate classes by min-max hashing, with every link confirmed on the full shingle sets.

Under each of PERMUTATIONS permutations of the 32-bit hashes a set keeps the least and the greatest value; either one
agrees between two sets with a probability that is their similarity, so a signature has two values for each evaluated
permutation, and the two vary a little against each other. Each run of ROWS values is a band: two sets of similarity s
meet in one of the bands with a probability of 1 - (1 - s**ROWS)**bands; with 150 values in bands of 5 a link at
the threshold of 0.85 is missed once in 4 * 10**7, and a link inside a group of copies has other ways besides.

Documents with the same set form a class first, so copies are never expanded. Classes that meet in a band are candidates:
a band's members are first linked as a chain and a star; where its members are still of several components, all of its
pairs that could join components are held against each other by bit sketches, in blocks if there are many. What is
left is verified on the whole sets, so no candidate is capped or sampled and no link rests on signatures.

Defined results: null and empty texts have no shingles, are linked with nothing and are their own component; rows
that repeat an id share the component of their own text; null ids never name a component unless all its ids are
null, and are kept only there; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import common, ngram_join, words
from marketloom.llm.components import connected_components

PERMUTATIONS, ROWS = 75, 5
#: Shingles whose values under all permutations are held at once.
PIECE = 4096


def permutations(count: int, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """What each permutation x -> spread((x ^ a) * b) is made of; b is odd, so it loses nothing."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**32, (count, 1), np.uint32), rng.integers(0, 2**32, (count, 1), np.uint32) | np.uint32(1)


def min_max(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least and the greatest value of a set of 64-bit hashes under each permutation, alternating."""
    x, least, most = (s >> np.uint64(32)).astype(np.uint32), None, None
    for at in range(0, len(x), PIECE):
        y = (x[at : at + PIECE] ^ a) * b
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x846CA68B)
        y ^= y >> np.uint32(16)
        low, high = y.min(axis=1), y.max(axis=1)
        least, most = (low, high) if least is None else (np.minimum(least, low), np.maximum(most, high))
    return np.stack((least, most), axis=1).ravel()


def bands(values: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit hash for each run of so many values, different in different bands."""
    runs = values[: len(values) // rows * rows].reshape(-1, rows).astype(np.uint64)
    out = words.mix(np.arange(1, len(runs) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for i in range(rows):
        out = words.mix(out + runs[:, i])
    return out


_SCANNED = "doc_id long, row long, rid long, n long, key long, sketch binary, bands binary"


def _scan(batches: Iterator[pa.RecordBatch], shingle: int, count: int, rows: int) -> Iterator[pa.RecordBatch]:
    """One row per document: set size, class, bit sketch and bands."""
    a, b = permutations(count)
    for batch, sets in words.shingle_sets(batches, "text", shingle):
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        texts = words.column_bytes(batch, "text")
        keys = [xxhash.xxh64_intdigest(s.tobytes()) - 2**63 if len(s) else None for s in sets]
        rid = [ngram_join._row_id(i, t) for i, t in zip(ids.to_pylist(), texts, strict=True)]
        found = [words.pack(bands(min_max(s, a, b), rows), 6) if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays(
            [
                ids.cast(pa.int64()), batch.column(batch.schema.get_field_index("row")), pa.array(rid, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array(keys, pa.int64()), pa.array([ngram_join.sketch(s) if len(s) else None for s in sets], pa.binary()), pa.array(found, pa.binary()),
            ],
            names=["doc_id", "row", "rid", "n", "key", "sketch", "bands"],
        )


def _spread(batches: Iterator[pa.RecordBatch], labels: list[int]) -> Iterator[pa.RecordBatch]:
    """Rows (part, entries, which, before, keys, sizes): the classes' bands, packed by partition of the band."""
    for batch in (b.slice(at, 16 * words.SLICE) for b in batches for at in range(0, b.num_rows, 16 * words.SLICE)):
        keys, sizes = (batch.column(i).to_numpy() for i in range(2))
        packed = [words.unpack(x, 6) for x in batch.column(2).to_pylist()]
        t, w = np.concatenate(packed), np.repeat(np.arange(len(packed)), [len(p) for p in packed])
        part = (words.mix(t) % np.uint64(len(labels))).astype(np.int64)
        order = np.argsort(part, kind="stable")
        t, w, ends = t[order], w[order], np.searchsorted(part[order], np.arange(len(labels) + 1))
        for p, label in enumerate(labels):
            x, y = ends[p], ends[p + 1]
            if x < y:
                use, local = np.unique(w[x:y], return_inverse=True)
                data = (words.pack(t[x:y], 6), words.pack(local, 3), bytes(int(y - x)), keys[use].astype(np.int64).tobytes(), sizes[use].astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), *[pa.array([d], pa.binary()) for d in data]], names=["part", "entries", "which", "before", "keys", "sizes"])


def _first_met(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links between members of two blocks of a band, verified on their sets: a spanning forest of the components joined. A
    pair is looked at in the first band that it shares alone, so it costs the same however many bands it shares."""
    for row in (r for b in batches for at in range(b.num_rows) for r in b.slice(at, 1).to_pylist()):
        x, y = (ngram_join._members_of(row[side]) for side in ("members", "others"))
        sets = [[words.unpack(r["set"], 6) for r in row[side]] for side in ("members", "others")]
        held = [np.stack([words.unpack(r["bands"], 6) for r in row[side]]) for side in ("members", "others")]
        for block, own in zip((x, y), sets, strict=True):
            block["sketch"] = [ngram_join.sketch(s) for s in own]
        i, j = ngram_join._unlike_components(x, y, percent, True)
        parent: dict[int, int] = {}

        def root(c: int, parent=parent) -> int:
            while parent.get(c, c) != c:
                parent[c] = c = parent.get(parent[c], parent[c])
            return c

        found = []
        for at in range(0, len(i), 16_384):
            u, v = i[at : at + 16_384], j[at : at + 16_384]
            first = np.argmax(held[0][u] == held[1][v], axis=1)
            use = held[0][u, first] == np.uint64(row["token"])
            for a, b in zip(u[use].tolist(), v[use].tolist(), strict=True):
                p, q = root(int(x["component"][a])), root(int(y["component"][b]))
                if p != q:
                    one, other = sets[0][a], sets[1][b]
                    shared = len(np.intersect1d(one, other, assume_unique=True))
                    if 100 * shared >= percent * (len(one) + len(other) - shared):
                        parent[q] = p
                        found.append((int(x["key"][a]), int(y["key"][b])))
        yield pa.RecordBatch.from_arrays([pa.array([min(f) for f in found], pa.int64()), pa.array([max(f) for f in found], pa.int64())], names=["a", "b"])


def _met(members: DataFrame, sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of blocks (token, members, others) of bands, each member with its set and its bands."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("length") / ngram_join.BLOCK), F.ceil(F.col("size") * 6 / ngram_join.BLOCK_BYTES)).alias("blocks")
    told = members.select("token", "key", "n", "component", "before", "home", blocks).join(sets, "key").join(classes.select("key", "bands"), "key")
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).alias("block")
    whole = common.materialize(told.groupBy("token", block).agg(F.collect_list(F.struct("key", "n", "component", "before", "home", "set", "bands")).alias("members")), "blocks")
    second = whole.select("token", F.col("block").alias("second"), F.col("members").alias("others"))
    return whole.join(second, "token").filter("block <= second").select("token", "members", "others")


def _between(members: DataFrame, joined: DataFrame, near: DataFrame, classes: DataFrame, base: DataFrame, documents: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Links that join what the components leave apart. Pairs of short bands are written; of long ones only the links that
    join components, found in blocks: first among the members for which a band is their longest, then band by band."""
    apart = ngram_join._placed(members, joined)
    pairs = common.materialize(ngram_join._short_pairs(apart, percent).join(near, ["a", "b"], "left_anti"), "pairs")
    sketched = classes.drop("bands")
    pairs = common.materialize(ngram_join._not_refuted(pairs, common.only(sketched, ngram_join._ends(pairs), "key"), percent), "possible")
    long = apart.filter(F.col("length") >= ngram_join.LONG)
    some = common.only(sketched, common.materialize(long.select("key").distinct(), "keys"), "key")
    met = ngram_join._met(long.withColumn("home", F.lit(0)), some, "sketch", 1)
    hopeful = common.materialize(met.mapInArrow(lambda rows: ngram_join._hopeful(rows, percent), "key long").distinct(), "hopeful")
    sets = ngram_join._sets_of(ngram_join._ends(pairs).unionByName(hopeful).distinct(), base, documents, shingle)
    links = ngram_join._verified(pairs, sets, percent)
    long = common.only(long, hopeful, "key").join(hopeful, "key", "left_semi")
    home = long.groupBy("key").agg(F.max(F.struct("length", "token", "n", "component")).alias("s")).select("key", "s.token", "s.n", "s.component")
    home = common.materialize(home, "homes")
    sizes = home.groupBy("token").agg(F.count(F.lit(1)).alias("length"), F.sum("n").alias("size"))
    together = home.join(sizes.filter("length > 1"), "token").withColumns({"before": F.lit(0), "home": F.lit(0)})
    own = common.only(sets, hopeful, "key").dropDuplicates(["key"])
    forest = common.materialize(ngram_join._met(together, own, "set", 6).mapInArrow(lambda rows: ngram_join._forest(rows, percent), "a long, b long"), "links")
    again = connected_components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links).unionByName(forest))
    left = ngram_join._placed(long.drop("length", "size"), again).join(home.select("key", F.col("token").alias("home")), "key")
    rest = common.materialize(_met(left, own, classes).mapInArrow(lambda rows: _first_met(rows, percent), "a long, b long"), "links")
    common.discard(apart, pairs)
    return links.unionByName(forest).unionByName(rest)


def similar_classes(base: DataFrame, percent: int, shingle: int, count: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, row, rid, n, key; components: node and component, both class keys) of base (doc_id, text)."""
    told = base.withColumn("row", F.xxhash64(F.coalesce("text", F.lit(""))))
    documents = common.materialize(told.mapInArrow(lambda b: _scan(b, shingle, count, rows), _SCANNED), "hashed")
    first = [F.first(c).alias(c) for c in ("n", "sketch", "bands")]
    classes = common.materialize(documents.filter("key is not null").groupBy("key").agg(*first), "classes")
    labels = common.even_labels(base.sparkSession, common.shuffle_parts(base.sparkSession))
    entries = classes.select("key", "n", "bands").mapInArrow(lambda b: _spread(b, labels), "part int, entries binary, which binary, before binary, keys binary, sizes binary")
    lists = entries.repartition(len(labels), "part").mapInArrow(lambda b: ngram_join._lists(b, percent), "kind byte, token long, a long, b long, n long, before long")
    lists = common.materialize(lists, "lists")
    members = lists.filter("kind = 1").select("token", F.col("a").alias("key"), "n", "before")
    near = common.materialize(lists.filter("kind = 0").select("a", "b").distinct(), "near")
    sketched = classes.drop("bands")
    possible = common.materialize(ngram_join._not_refuted(near, common.only(sketched, ngram_join._ends(near), "key"), percent), "possible")
    sets = ngram_join._sets_of(ngram_join._ends(possible), base, documents, shingle)
    links = ngram_join._verified(possible, sets, percent)
    common.discard(sets, possible)
    more = _between(members, connected_components(links), near, classes, base, documents, percent, shingle)
    components = connected_components(links.unionByName(more))
    common.discard(lists, near, classes)
    return documents, components


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, percent: int = 85, shingle: int = 3, permutations: int = PERMUTATIONS, rows: int = ROWS
) -> DataFrame:
    """doc_id, row (hash of the text), n_shingles, group (names the component; null without shingles), component_id (the
    smallest doc_id reachable over links) and kept (whether it is the document's own), for every row of docs."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    documents, components = similar_classes(base, percent, shingle, permutations, rows)
    least = documents.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"))
    placed = least.join(components.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = placed.join(named, "component").select("key", F.col("component").alias("group"), "component_id")
    told = documents.join(by_class, "key", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return told.select("doc_id", "row", F.col("n").alias("n_shingles"), "group", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
