"""Similarity self-join on word shingles (Jaccard), by a size-aware heavy-light join, with connected classes.

Documents with the same shingle set form a class; classes are joined, copies are never expanded. Shingles have one
global order: rare ones first (by hash), shared ones (in FREQUENT_SETS sets or more, as far as counted) last. Two sets
that reach the threshold share at least k of the first n - ceil(t n) + k shingles of each. Small (light) sets
enumerate all 2-subsets of that prefix (k = 2), so that lists are short; large (heavy) sets enter the inverted
list of each prefix shingle (k = 1), which are scanned. The size boundary is the one with the least estimated
cost over the table's sizes and list lengths; light sets that can pair with heavy ones also enter the lists.

Which shingles are shared is counted over the COUNTED percent of each set with the smallest hashes and kept as a bit
map of fixed size (SHARED_BITS); it decides the order only, so its errors cost candidates and no link.

Lists are first linked as chains and stars: neighbours by size, and each member with the one with the least key.
Verified links make components; then lists that still hold several components are searched for links between members of
different components. A list proposes a pair only if the sets could be similar with it as the first they share (its
place in each set is kept in thousandths); the first list they do share always does. Lists of fewer than LONG members
give pairs. Longer ones go in blocks: a first pass holds blocks against each other by bit sketches and writes only the
members that may have a link at all. Each of these goes with its whole set to its longest list alone (its home), where
blocks meet in tasks that verify there and write only a spanning forest of the components that the links join; so
groups that share many lists are joined once. What is left are pairs of different components and homes, which are
written and verified as pairs. So a group of near copies costs a few rows per member, and still no link that would join two components is missed.

A pair is first held against the two classes' bit sketches (2 to 4 bits a shingle): a bit that one sketch has and
the other lacks is a shingle not shared, which refutes most chance pairs and never a link. What remains is
verified on the whole shingle sets, and only the classes in such pairs have their sets written. Their documents
are told by a bit filter of fixed size (FILTER_BITS), whose false hits cost a few rows and change nothing.

Defined results: null and empty texts have no shingles, are linked with nothing and are their own component; rows
that repeat an id share the component of their own text; null ids never name a component unless all its ids are
null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import common, words
from marketloom.llm.components import connected_components

#: A shingle is shared if so many sets hold it.
FREQUENT_SETS = 4
COUNTED = 40
#: Lists of so many members are scanned in blocks of about BLOCK.
LONG, BLOCK = 24, 256
BLOCK_BYTES = 2_000_000
#: Bytes of a sketch that blocks carry at most to a comparison.
MOST_FOLDED = 1024
FILTER_BITS = 2**24
SHARED_BITS = 2**27
#: What scanning one list member costs, where writing one entry costs 1.
SCAN_COST = 0.25
#: Entries a task gathers before it writes them out by partition.
BATCH_ENTRIES = 1_000_000


def _row_id(doc_id: int | None, text: bytes | None) -> int:
    return xxhash.xxh64_intdigest(text or b"", seed=(doc_id or 0) & (2**64 - 1)) - 2**63


def sketch(s: np.ndarray) -> bytes:
    """A bit for each shingle, at its hash modulo a power of two from 2 to 4 times the set's size (64 at least)."""
    bits = max(64, 1 << (2 * len(s) - 1).bit_length())
    out = np.zeros(bits, bool)
    out[(s & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def may_link(x: bytes, y: bytes, n: int, m: int, percent: int) -> bool:
    """False only if sets of n and m shingles with these sketches can't be similar."""
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(p) > len(q):
        p = p[: len(p) // 2] | p[len(p) // 2 :]
    while len(q) > len(p):
        q = q[: len(q) // 2] | q[len(q) // 2 :]
    shared = min(n - int(np.bitwise_count(p & ~q).sum()), m - int(np.bitwise_count(q & ~p).sum()))
    return 100 * shared >= percent * (n + m - shared)


_SCANNED = "doc_id long, row long, rid long, n long, key long, sketch binary"


def _scan(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """One row per document (n: set size, key: class)."""
    for batch, sets in words.shingle_sets(batches, "text", shingle):
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        texts = words.column_bytes(batch, "text")
        keys = [xxhash.xxh64_intdigest(s.tobytes()) - 2**63 if len(s) else None for s in sets]
        rid = [_row_id(i, t) for i, t in zip(ids.to_pylist(), texts, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                ids.cast(pa.int64()), batch.column(batch.schema.get_field_index("row")), pa.array(rid, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array(keys, pa.int64()), pa.array([sketch(s) if len(s) else None for s in sets], pa.binary()),
            ],
            names=["doc_id", "row", "rid", "n", "key", "sketch"],
        )


def _counting(batches: Iterator[pa.RecordBatch], labels: list[int], shingle: int) -> Iterator[pa.RecordBatch]:
    """Packed shingles of each class's COUNTED percent, by partition; a class once in a batch."""
    held, size = {}, 0

    def flush():
        t = np.concatenate(list(held.values()))
        part = (words.mix(t) % np.uint64(len(labels))).astype(np.int64)
        order = np.argsort(part, kind="stable")
        t, ends = t[order], np.searchsorted(part[order], np.arange(len(labels) + 1))
        for p, label in enumerate(labels):
            if ends[p] < ends[p + 1]:
                yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([p], pa.int32()), pa.array([words.pack(np.sort(t[ends[p] : ends[p + 1]]) >> np.uint64(8), 6)], pa.binary())], names=["label", "part", "packed"])

    for _, sets in words.shingle_sets(batches, "text", shingle):
        for s in sets:
            if len(s) > 2:
                some = s[: -(-len(s) * COUNTED // 100) + 1]
                held[xxhash.xxh64_intdigest(s.tobytes())] = some
                size += len(some)
        if size >= 2 * BATCH_ENTRIES:
            yield from flush()
            held, size = {}, 0
    if held:
        yield from flush()


def _shared_at(t: np.ndarray, bits: int) -> np.ndarray:
    """A shingle's place in its partition's bit map (by the bits that are counted)."""
    return (words.mix((t >> np.uint64(8)) & np.uint64(2**48 - 1)) >> np.uint64(24)) % np.uint64(bits)


def _shared(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """A bit map per partition of the shingles in FREQUENT_SETS or more, and sums for the mean list length."""
    by_part: dict[int, list] = {}
    for r in (r for b in batches for r in b.to_pylist()):
        by_part.setdefault(r["part"], []).append(words.unpack(r["packed"], 6))
    for part, packed in by_part.items():
        t, counts = np.unique(np.concatenate(packed), return_counts=True)
        out = np.zeros(bits, bool)
        out[_shared_at(t[counts >= FREQUENT_SETS] << np.uint64(8), bits).astype(np.int64)] = True
        single = counts[counts < FREQUENT_SETS]
        values = [part, zstandard.compress(np.packbits(out, bitorder="little").tobytes(), 3), int((single**2).sum()), int(single.sum())]
        yield pa.RecordBatch.from_arrays([pa.array([v], t_) for v, t_ in zip(values, [pa.int32(), pa.binary(), pa.int64(), pa.int64()], strict=True)], names=["part", "bits", "squares", "n"])


def prefix_length(n: int, percent: int, k: int) -> int:
    """Of how many of its n shingles, in the global order, a set shares k with any set that it is similar to."""
    return n - -(-n * percent // 100) + k


def choose_boundary(sizes: list[tuple[int, int]], percent: int, list_length: float) -> int:
    """The set size up to which sets are light, for the least cost. sizes: (set size, number of sets)."""
    best, boundary, light, heavy = None, 2, 0.0, 0.0
    heavy_cost = {n: c * prefix_length(n, percent, 1) * (1 + SCAN_COST * list_length) for n, c in sizes if n > 2}
    heavy = sum(heavy_cost.values())
    best = heavy
    for n, c in sorted(sizes):
        if n > 2:
            p = prefix_length(n, percent, 2)
            light, heavy = light + c * p * (p - 1) / 2, heavy - heavy_cost[n]
            if light + heavy < best:
                best, boundary = light + heavy, n
    return boundary


def _entries(s: np.ndarray, frequent: np.ndarray, percent: int, boundary: int) -> tuple[np.ndarray, np.ndarray]:
    """The list keys under which a set is entered, and for each how many thousandths of the set come before it (rounded
    down; 0 for 2-subsets)."""
    n = len(s)
    if n <= 2:  # only an equal set is similar
        return s[:0], np.zeros(0, np.uint8)
    part = (words.mix(s) % np.uint64(len(frequent))).astype(np.int64)
    at = _shared_at(s, 8 * frequent.shape[1]).astype(np.int64)
    common_ = ((frequent[part, at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
    ordered = np.concatenate((s[~common_], s[common_]))
    found = []
    if n <= boundary:
        first = ordered[: prefix_length(n, percent, 2)]
        i, j = np.array(list(combinations(range(len(first)), 2)), np.int64).T
        low, high = np.minimum(first[i], first[j]), np.maximum(first[i], first[j])
        found.append(words.mix(low * np.uint64(3) + words.mix(high)))
    if n > boundary or n * 100 >= percent * (boundary + 1):
        found.append(ordered[: prefix_length(n, percent, 1)])
    before = np.minimum(np.arange(len(found[-1])) * 1000 // n, 255) if n > boundary or len(found) > 1 else np.zeros(0)
    keys = np.concatenate(found)
    return keys, np.concatenate((np.zeros(len(keys) - len(before)), before)).astype(np.uint8)


def _spread(batches: Iterator[pa.RecordBatch], frequent, percent: int, boundary: int, labels: list[int], shingle: int) -> Iterator[pa.RecordBatch]:
    """Rows (part, entries, which, before, keys, sizes): packed list entries by partition of the list key."""
    frequent, done = frequent.value, set()
    tokens, which, places, keys, sizes, held = [], [], [], [], [], 0

    def flush():
        nonlocal tokens, which, places, keys, sizes, held
        if tokens:
            t, w, q = np.concatenate(tokens), np.concatenate(which), np.concatenate(places)
            part = (words.mix(t) % np.uint64(len(labels))).astype(np.int64)
            order = np.argsort(part, kind="stable")
            t, w, q, ends = t[order], w[order], q[order], np.searchsorted(part[order], np.arange(len(labels) + 1))
            k, n = np.array(keys, np.int64), np.array(sizes, np.int32)
            for p, label in enumerate(labels):
                a, b = ends[p], ends[p + 1]
                if a < b:
                    use, local = np.unique(w[a:b], return_inverse=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([label], pa.int32()), *[pa.array([x], pa.binary()) for x in (words.pack(t[a:b], 6), words.pack(local, 3), q[a:b].tobytes(), k[use].tobytes(), n[use].tobytes())]],
                        names=["part", "entries", "which", "before", "keys", "sizes"],
                    )
        tokens, which, places, keys, sizes, held = [], [], [], [], [], 0

    for _, sets in words.shingle_sets(batches, "text", shingle):
        for s in sets:
            found, before = _entries(s, frequent, percent, boundary)
            if len(found):
                key = xxhash.xxh64_intdigest(s.tobytes()) - 2**63
                if key in done:
                    continue
                if len(done) >= words.MOST_WORDS:
                    done.clear()
                done.add(key)
                tokens.append(found)
                places.append(before)
                which.append(np.full(len(found), len(keys), np.int64))
                keys.append(key)
                sizes.append(len(s))
                held += len(found)
        if held >= BATCH_ENTRIES:
            yield from flush()
    yield from flush()


def _distinct(*columns: np.ndarray) -> list[np.ndarray]:
    if not len(columns[0]):
        return list(columns)
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return [c[new] for c in columns]


def _lists(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """kind 0: pairs a, b of chains and stars; kind 1: members (token, a: class, n: size, before) of lists with three or more."""
    tokens, keys, sizes, places = [], [], [], []
    for batch in batches:
        for row in batch.to_pylist():
            local = words.unpack(row["which"], 3).astype(np.int64)
            tokens.append(words.unpack(row["entries"], 6))
            keys.append(np.frombuffer(row["keys"], np.int64)[local])
            sizes.append(np.frombuffer(row["sizes"], np.int32)[local])
            places.append(np.frombuffer(row["before"], np.uint8))
    if not tokens:
        return
    t, n, k, q = _distinct(np.concatenate(tokens), np.concatenate(sizes).astype(np.int64), np.concatenate(keys), np.concatenate(places).astype(np.int64))
    first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
    length = np.diff(np.concatenate((first, [len(t)])))
    keep = np.repeat(length > 1, length)
    t, n, k, q = t[keep], n[keep], k[keep], q[keep]
    if not len(t):
        return
    first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
    length = np.diff(np.concatenate((first, [len(t)])))
    order = np.lexsort((k, t))
    least = np.repeat(order[first], length)  # each list's member with the least key, mostly the same in a group of copies
    a = np.concatenate((np.arange(len(t) - 1), least))
    b = np.concatenate((np.arange(1, len(t)), np.arange(len(t))))
    left = n + (-n * q) // 1000  # no shingle before the first that two sets share is shared
    most = np.minimum(left[a], left[b])
    fits = (t[a] == t[b]) & (k[a] != k[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])) & (100 * most >= percent * (n[a] + n[b] - most))
    a, b = k[a[fits]], k[b[fits]]
    low, high = _distinct(np.minimum(a, b), np.maximum(a, b))
    for at in range(0, len(low), 50_000):
        x, y = low[at : at + 50_000], high[at : at + 50_000]
        yield _list_rows(np.zeros(len(x), np.int8), np.zeros(len(x), np.int64), x, y, *[np.zeros(len(x), np.int64)] * 2)
    long = np.repeat(length > 2, length)  # the pair of a list of two has been written
    t, n, k, q = t[long], n[long], k[long], q[long]
    for at in range(0, len(t), 50_000):
        x = k[at : at + 50_000]
        yield _list_rows(np.ones(len(x), np.int8), t[at : at + 50_000].view(np.int64), x, x, n[at : at + 50_000], q[at : at + 50_000])


def _list_rows(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "token", "a", "b", "n", "before"])


def _sets(batches: Iterator[pa.RecordBatch], wanted, bits: int, shingle: int) -> Iterator[pa.RecordBatch]:
    """key and packed set of the documents whose row id hits the filter."""

    def chosen() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            texts = words.column_bytes(batch, "text")
            at = np.array([_row_id(i, t) % bits for i, t in zip(ids, texts, strict=True)], np.int64)
            hit = (wanted.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) if len(at) else at
            yield batch.filter(pa.array(hit.astype(bool)))

    for _, sets in words.shingle_sets(chosen(), "text", shingle):
        sets = [s for s in sets if len(s)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([xxhash.xxh64_intdigest(s.tobytes()) - 2**63 for s in sets], pa.int64()),
                pa.array([words.pack(np.sort(s >> np.uint64(16)), 6) for s in sets], pa.binary()),
            ],
            names=["key", "packed"],
        )


def _possible(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pydict()
        fits = [may_link(x, y, n, m, percent) for x, y, n, m in zip(rows["sketch_a"], rows["sketch_b"], rows["n_a"], rows["n_b"], strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pydict()
        fits = []
        for x, y in zip(rows["set_a"], rows["set_b"], strict=True):
            p, q = words.unpack(x, 6), words.unpack(y, 6)
            shared = len(np.intersect1d(p, q, assume_unique=True))
            fits.append(100 * shared >= percent * (len(p) + len(q) - shared))
        yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))


def _of(rows: DataFrame, side: str, *columns: str) -> DataFrame:
    return rows.select(F.col("key").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])


def _not_refuted(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    met = pairs.join(_of(classes, "b", "n", "sketch"), "b").join(_of(classes, "a", "n", "sketch"), "a")
    return met.mapInArrow(lambda rows: _possible(rows, percent), "a long, b long")


def _sets_of(keys: DataFrame, base: DataFrame, documents: DataFrame, shingle: int) -> DataFrame:
    """key and packed set of these classes (and of a few more)."""
    rows = documents.join(keys, "key", "left_semi").groupBy("key").agg(F.min("rid").alias("rid")).select("rid")
    wanted = base.sparkSession.sparkContext.broadcast(_bit_filter(rows, FILTER_BITS))
    sets = base.mapInArrow(lambda rows: _sets(rows, wanted, FILTER_BITS, shingle), "key long, packed binary").withColumnRenamed("packed", "set")
    sets = common.materialize(sets, "sets")
    wanted.destroy()
    return sets


def _verified(possible: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs of classes that are similar."""
    both = possible.join(_of(sets, "b", "set"), "b").join(_of(sets, "a", "set"), "a")
    return common.materialize(both.mapInArrow(lambda rows: _verify(rows, percent), "a long, b long").distinct(), "links")


def _folded(sketches: list[bytes], bits: int) -> np.ndarray:
    """One row of words per sketch, folded to so many bits."""
    out = np.zeros((len(sketches), bits // 64), np.uint64)
    for i, s in enumerate(sketches):
        w = np.frombuffer(s, np.uint64)
        out[i] = np.bitwise_or.reduce(w.reshape(-1, bits // 64), axis=0)
    return out


def _unlike_components(x: dict, y: dict, percent: int, apart_home: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Places in x and y of members of different components that may be similar, by size, place and folded sketch."""
    n, m = x["n"][:, None], y["n"][None, :]
    # No shingle before the first that two sets share is shared, so what comes from there on bounds what they share.
    most = np.minimum(x["left"][:, None], y["left"][None, :])
    apart = x["home"][:, None] != y["home"][None, :] if apart_home else True
    fits = apart & (x["component"][:, None] != y["component"][None, :]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (100 * most >= percent * (n + m - most))
    i, j = np.nonzero(fits)
    bits = 8 * min(MOST_FOLDED, *(len(s) for s in x["sketch"]), *(len(s) for s in y["sketch"]))
    p, q = _folded(x["sketch"], bits), _folded(y["sketch"], bits)
    kept = []
    for at in range(0, len(i), 65_536):  # so many pairs at once
        u, v = i[at : at + 65_536], j[at : at + 65_536]
        a, b = p[u], q[v]
        shared = np.minimum(x["n"][u] - np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64), y["n"][v] - np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64))
        kept.append(at + np.flatnonzero(100 * shared >= percent * (x["n"][u] + y["n"][v] - shared)))
    kept = np.concatenate(kept) if kept else np.zeros(0, np.int64)
    return i[kept], j[kept]


def _members_of(block: list[dict]) -> dict:
    out = {c: np.array([r[c] for r in block], np.int64) for c in ("key", "n", "component", "before", "home")}
    out["left"] = out["n"] + (-out["n"] * out["before"]) // 1000  # at least ceil(n * before / 1000) come before
    return out | {"sketch": [r.get("sketch") for r in block]}


def _hopeful(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The members of two blocks of a list whose sketches allow a link between components; a task names each once."""
    told: set[int] = set()
    for row in (r for b in batches for at in range(b.num_rows) for r in b.slice(at, 1).to_pylist()):
        x, y = _members_of(row["members"]), _members_of(row["others"])
        i, j = _unlike_components(x, y, percent)
        keys = set(x["key"][i].tolist()) | set(y["key"][j].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(sorted(keys - told), pa.int64())], names=["key"])
        told = told | keys if len(told) < words.MOST_WORDS else keys


def _forest(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links between members of two blocks of a list, verified on their sets: a spanning forest of the components joined."""
    for row in (r for b in batches for at in range(b.num_rows) for r in b.slice(at, 1).to_pylist()):
        x, y = _members_of(row["members"]), _members_of(row["others"])
        sets = [[words.unpack(r["set"], 6) for r in row[side]] for side in ("members", "others")]
        for block, own in zip((x, y), sets):
            block["sketch"] = [sketch(s) for s in own]
        parent: dict[int, int] = {}

        def root(c: int, parent=parent) -> int:
            while parent.get(c, c) != c:
                parent[c] = c = parent.get(parent[c], parent[c])
            return c

        found = []
        for i, j in zip(*(v.tolist() for v in _unlike_components(x, y, percent)), strict=True):
            p, q = root(int(x["component"][i])), root(int(y["component"][j]))
            if p != q:
                one, other = sets[0][i], sets[1][j]
                shared = len(np.intersect1d(one, other, assume_unique=True))
                if 100 * shared >= percent * (len(one) + len(other) - shared):
                    parent[q] = p
                    found.append((int(x["key"][i]), int(y["key"][j])))
        yield pa.RecordBatch.from_arrays([pa.array([min(f) for f in found], pa.int64()), pa.array([max(f) for f in found], pa.int64())], names=["a", "b"])


def _block_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of members of two blocks, of different components and homes, whose sketches allow a link."""
    for row in (r for b in batches for at in range(b.num_rows) for r in b.slice(at, 1).to_pylist()):
        x, y = _members_of(row["members"]), _members_of(row["others"])
        i, j = _unlike_components(x, y, percent, True)
        low, high = _distinct(np.minimum(x["key"][i], y["key"][j]), np.maximum(x["key"][i], y["key"][j]))
        yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["a", "b"])


def _placed(members: DataFrame, components: DataFrame) -> DataFrame:
    """Members of the lists that hold several components, with their component and their list's length and size."""
    placed = components.withColumnRenamed("node", "key")
    tagged = common.materialize(members.drop("component").join(placed, "key", "left").withColumn("component", F.coalesce("component", "key")), "members")
    lists = tagged.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("length"), F.sum("n").alias("size"))
    apart = common.materialize(tagged.join(lists.filter("x < y").select("token", "length", "size"), "token"), "apart")
    common.discard(tagged)
    return apart


def _short_pairs(apart: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes of different components that share a list of fewer than LONG members."""
    short = apart.filter(F.col("length") < LONG)
    other = short.select("token", F.col("key").alias("b"), F.col("n").alias("m"), F.col("before").alias("passed"), F.col("component").alias("other"))
    # No shingle before the first that two sets share is shared, so what comes from there on bounds what they share.
    left = lambda n, passed: F.col(n) - F.ceil(F.col(n) * F.col(passed) / 1000 - 1e-6)
    most = F.least(left("n", "before"), left("m", "passed"))
    fits = (F.least("n", "m") * 100 >= F.greatest("n", "m") * percent) & (F.col("component") != F.col("other")) & (most * 100 >= (F.col("n") + F.col("m") - most) * percent)
    return short.withColumnRenamed("key", "a").join(other, "token").filter((F.col("a") < F.col("b")) & fits).select("a", "b").distinct()


def _met(members: DataFrame, values: DataFrame, value: str, width: int) -> DataFrame:
    """Pairs of blocks (members, others) of the long lists of members (which have their list's length and size), each
    member with its value; a block has about BLOCK members and BLOCK_BYTES at a width of so many bytes a shingle."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("length") / BLOCK), F.ceil(F.col("size") * width / BLOCK_BYTES)).alias("blocks")
    mixed = members.select("token", "key", "n", "component", "before", "home", blocks).join(values.select("key", value), "key")
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).alias("block")
    long = common.materialize(mixed.groupBy("token", block).agg(F.collect_list(F.struct("key", "n", "component", "before", "home", value)).alias("members")), "blocks")
    second = long.select("token", F.col("block").alias("second"), F.col("members").alias("others"))
    return long.join(second, "token").filter("block <= second").select("members", "others")


def _between(members: DataFrame, joined: DataFrame, near: DataFrame, classes: DataFrame, base: DataFrame, documents: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Edges of the components as they are with the links that join what they left apart."""
    apart = _placed(members, joined)
    pairs = common.materialize(_short_pairs(apart, percent).join(near, ["a", "b"], "left_anti"), "pairs")
    pairs = common.materialize(_not_refuted(pairs, common.only(classes, _ends(pairs), "key"), percent), "possible")
    long = apart.filter(F.col("length") >= LONG)
    some = common.only(classes, common.materialize(long.select("key").distinct(), "keys"), "key")
    met = _met(long.withColumn("home", F.lit(0)), some, "sketch", 1)
    hopeful = common.materialize(met.mapInArrow(lambda rows: _hopeful(rows, percent), "key long").distinct(), "hopeful")
    sets = _sets_of(_ends(pairs).unionByName(hopeful).distinct(), base, documents, shingle)
    links = _verified(pairs, sets, percent)
    long = common.only(long, hopeful, "key").join(hopeful, "key", "left_semi")
    home = long.groupBy("key").agg(F.max(F.struct("length", "token", "n", "component")).alias("s")).select("key", "s.token", "s.n", "s.component")
    home = common.materialize(home, "homes")
    sizes = home.groupBy("token").agg(F.count(F.lit(1)).alias("length"), F.sum("n").alias("size"))
    # in its home a set meets all others of the list, whatever they share first
    together = home.join(sizes.filter("length > 1"), "token").withColumn("before", F.lit(0)).withColumn("home", F.lit(0))
    forest = common.materialize(_met(together, common.only(sets, hopeful, "key"), "set", 6).mapInArrow(lambda rows: _forest(rows, percent), "a long, b long"), "links")
    again = connected_components(_edges(joined).unionByName(links).unionByName(forest))
    left = _placed(long.drop("length", "size"), again).join(home.select("key", F.col("token").alias("home")), "key")
    rest = _met(left, common.only(classes, hopeful, "key"), "sketch", 1).mapInArrow(lambda rows: _block_pairs(rows, percent), "a long, b long").distinct()
    rest = common.materialize(rest, "possible")
    found = _edges(again).unionByName(_verified(rest, common.only(sets, _ends(rest), "key"), percent))
    common.discard(apart, pairs)
    return found


def _edges(components: DataFrame) -> DataFrame:
    """Components as stars, which take no more rounds to be found again."""
    return components.select(F.col("node").alias("a"), F.col("component").alias("b"))


def _ends(pairs: DataFrame) -> DataFrame:
    return common.materialize(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "keys")


def _bit_filter(values: DataFrame, bits: int) -> np.ndarray:
    """A bit for each value mod bits: at most bits/64 rows reach the driver, however many values there are."""
    at = F.pmod(F.col(values.columns[0]), F.lit(bits))
    rows = values.groupBy((F.shiftright(at, 6)).alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod({values.columns[0]}, {bits}) % 64 as int)))")).collect()
    out = np.zeros(bits // 64, np.uint64)
    for word, found in rows:
        out[word] = np.uint64(found & (2**64 - 1))
    return out


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, shingle: int = 5) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, rid, n, key; components: node (a class key), component (a class key))."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    told = base.withColumn("row", F.xxhash64(F.coalesce("text", F.lit(""))))
    documents = common.materialize(told.mapInArrow(lambda rows: _scan(rows, shingle), _SCANNED), "shingled")
    labels = common.even_labels(spark, common.shuffle_parts(spark))
    bits = max(64, SHARED_BITS // len(labels) // 64 * 64)
    counting = base.mapInArrow(lambda rows: _counting(rows, labels, shingle), "label int, part int, packed binary")
    maps = counting.repartition(len(labels), "label").mapInArrow(lambda rows: _shared(rows, bits), "part int, bits binary, squares long, n long").collect()
    frequent = np.zeros((len(labels), bits // 8), np.uint8)
    for r in maps:
        frequent[r["part"]] = np.frombuffer(zstandard.decompress(r["bits"]), np.uint8)
    list_length = sum(r["squares"] for r in maps) / max(sum(r["n"] for r in maps), 1)
    step = F.when(F.col("n") <= 64, F.col("n")).otherwise(F.floor(F.pow(F.lit(2.0), F.floor(F.log2("n") * 4) / 4)))
    sizes = [(int(r[0]), r[1]) for r in documents.filter("n > 0").groupBy(step.alias("size")).count().collect()]
    boundary = choose_boundary(sizes, percent, list_length)
    frequent = spark.sparkContext.broadcast(frequent)
    entries = base.mapInArrow(
        lambda rows: _spread(rows, frequent, percent, boundary, labels, shingle),
        "part int, entries binary, which binary, before binary, keys binary, sizes binary",
    )
    lists = common.materialize(
        entries.repartition(len(labels), "part").mapInArrow(
            lambda rows: _lists(rows, percent), "kind byte, token long, a long, b long, n long, before long"
        ),
        "lists",
    )
    members = lists.filter("kind = 1").select("token", F.col("a").alias("key"), "n", "before")
    near = lists.filter("kind = 0").select("a", "b").distinct()
    frequent.destroy()
    classes = documents.filter("key is not null").groupBy("key").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes, near = common.materialize(classes, "classes"), common.materialize(near, "near")
    possible = common.materialize(_not_refuted(near, common.only(classes, _ends(near), "key"), percent), "possible")
    sets = _sets_of(_ends(possible), base, documents, shingle)
    links = _verified(possible, sets, percent)
    common.discard(sets, possible)
    found = _between(members, connected_components(links), near, classes, base, documents, percent, shingle)
    common.discard(lists, near, classes)
    return documents, connected_components(found)


def join_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, shingle: int = 5) -> DataFrame:
    """doc_id, row (hash of the text), n_shingles, group (names the component; null without shingles) and component_id, the
    smallest doc_id reachable over links, for every row."""
    documents, components = similar_classes(docs, id_col, text_col, percent, shingle)
    classes = documents.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"))
    placed = classes.join(components.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = placed.join(named, "component").select("key", F.col("component").alias("group"), "component_id")
    return documents.join(by_class, "key", "left").select(
        "doc_id", "row", F.col("n").alias("n_shingles"), "group", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_similar(common.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
