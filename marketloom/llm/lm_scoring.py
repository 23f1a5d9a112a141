"""Language-model scoring: a hierarchical Pitman-Yor bigram model, its seating sampled by Gibbs, over Spark.

Restaurants are contexts (the word before, or the start of a text); all share one parent, the restaurant of single
words, over a uniform base of the V training tokens and one unknown. A child's tables are the parent's customers.

1. Texts become batches of token numbers (written to the shared folder). 2. Each batch sends its words' counts to the
partition of the word's hash; the sums go back to the batches. 3. Each batch sends its distinct pairs with training
counts to the partition of the context's hash; contexts with a large share of all tokens are dealt over several by the
following word's hash, with broadcast totals (at most HOT * partitions + 1 of them). There equal pairs of all batches
become one dish, so the first state (one table for each pair) does not depend on batches or partitions. 4. BURN_IN +
SAMPLES times: the tables of each word in all restaurants of a partition are summed and sent to the word's partition,
where the parent is seated anew for these customers by Gibbs sweeps; its probabilities go back to the partitions of the
contexts, and their restaurants are seated by one Gibbs sweep: the customers of one dish are lifted and seated anew by
the Chinese restaurant rule (waiting times to the next new table are beta-geometric, so a dish costs as many steps as
tables), and the move is accepted by Metropolis-Hastings. Predictive probabilities are averaged over the sweeps after
burn-in; what stays of the restaurants is written once, what a sweep changes after each. 5. The batches add up their texts' log probabilities. Only pre-aggregated pairs and words are shuffled, never
texts; nothing of the size of the vocabulary is broadcast or collected. There are as many partitions as a shuffle has,
but no more than the texts fill (PART_BYTES): a small table in many partitions would send little else than empty messages.

What is approximate: within a sweep the parent's probabilities and the restaurants' table totals are those of its
start, and a dish's last weight is kept although they have changed.

Defined results: null and empty texts are the end token alone; words that no training text holds share the unknown's
probability; a null id is never held out; repeated rows count as often as they occur; an empty table gives no rows;
without training texts the model is uniform. Words are told apart by 64-bit hashes, those after a context by 48 bits of them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import common, words

D, THETA = 0.8, 1.0
D_PARENT, THETA_PARENT = 0.75, 1.0
BURN_IN, SAMPLES = 1, 3
BATCH_TOKENS = 800_000
#: Bytes of text for which one more partition of words and contexts is made: partitions write to each other, so their
#: messages grow with the square of their number.
PART_BYTES = 12_000_000
#: A context is hot from 1/HOT of a mean partition's tokens on.
HOT = 4
#: Dishes from which on they are seated together, as arrays.
FEW = 48
END, START = np.uint64(xxhash.xxh64_intdigest(b"\x00end")), np.uint64(xxhash.xxh64_intdigest(b"\x00start"))
#: Log probabilities travel as multiples of this.
GRAIN = 1 / 2048


def _zip(x: np.ndarray) -> bytes:
    """Compressed by bytes of the same weight, of which the higher ones seldom differ."""
    data = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize)
    return zstandard.compress(b"".join(np.ascontiguousarray(data[:, i]) for i in range(x.itemsize)), 1)


def _unzip(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    out = np.empty(planes.shape[::-1], np.uint8)
    for i, plane in enumerate(planes):
        out[:, i] = plane
    return out.ravel().view(kind)


def _lgamma(x: np.ndarray) -> np.ndarray:
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7))
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) - shift


def _reseat_one(c: float, n: float, t: float, weight: float, a: float, step: float, d: float, rng: np.random.Generator) -> tuple[float, float]:
    """What reseat does, for one dish of which n customers have t tables."""
    while n < c:
        x = n - d * t
        m = min(rng.geometric(min(max(rng.beta(max(a, 1e-9), x), 1e-12), 1.0)) - 1, c - n)
        weight += math.lgamma(x + m + a) - math.lgamma(x + a)
        n += m
        if n < c:
            weight += math.log(x + m + a)
            n, t, a = n + 1, t + 1, a + step
    return t, weight


def reseat(c: np.ndarray, a: np.ndarray, step: np.ndarray, d: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Seats c customers (1 or more) of a dish anew by the Chinese restaurant rule, a being the mass of a new table and
    step what each table adds to it. Returns the tables and the log weight of the draw."""
    n, t, weight = np.ones(len(c)), np.ones(len(c)), np.zeros(len(c))
    a = a.astype(float).copy()
    live = np.flatnonzero(c > 1)
    while len(live) > FEW:
        x = n[live] - d * t[live]
        q = np.clip(rng.beta(np.maximum(a[live], 1e-9), x), 1e-12, 1.0)
        m = np.minimum(rng.geometric(q) - 1, c[live] - n[live])
        weight[live] += _lgamma(x + m + a[live]) - _lgamma(x + a[live])
        n[live] += m
        more = n[live] < c[live]
        weight[live[more]] += np.log(x[more] + m[more] + a[live[more]])
        live = live[more]
        n[live] += 1
        t[live] += 1
        a[live] += step[live]
        live = live[n[live] < c[live]]
    for i in live.tolist():  # the few with many tables, one after the other
        t[i], weight[i] = _reseat_one(float(c[i]), n[i], t[i], weight[i], a[i], float(step[i]), d, rng)
    return t, weight


def gibbs(c: np.ndarray, t: np.ndarray, weight: np.ndarray, base: np.ndarray, group: np.ndarray, customers: np.ndarray, elsewhere: np.ndarray,
          d: float, theta: float, rng: np.random.Generator, burn_in: int, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Averaged predictive probabilities of dishes, and the last tables and weights: c customers (0: not seen) and t
    tables each in restaurant group, weight the log weight of that seating (-inf: none drawn yet), base the parent's
    probability; customers: of all dishes, and elsewhere: tables in other partitions, by restaurant."""
    seen = np.flatnonzero(c > 0)
    t, weight, total = t.astype(float), weight.astype(float), np.zeros(len(c))
    for sweep in range(burn_in + samples):
        tables = elsewhere + np.bincount(group, t, minlength=len(customers))
        mass = (theta + d * (tables[group[seen]] - t[seen] + 1)) * base[seen]
        new, w = reseat(c[seen], mass, d * base[seen], d, rng)
        with np.errstate(invalid="ignore"):
            take = (weight[seen] == -np.inf) | (np.log(rng.random(len(seen))) < w - weight[seen])
        t[seen[take]], weight[seen[take]] = new[take], w[take]
        if sweep >= burn_in:
            tables = elsewhere + np.bincount(group, t, minlength=len(customers))
            total += (c - d * t * (c > 0) + (theta + d * tables[group]) * base) / (theta + customers[group])
    return total / max(samples, 1), t, weight


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return (words.mix(h) % np.uint64(parts)).astype(np.int64)


def _batches(rows: Iterator[pa.RecordBatch], parts: int, fold: int) -> Iterator[pa.RecordBatch]:
    seq, ids, held, tokens, index = 0, [], [], [], words.Index()

    def flush():
        nonlocal seq, ids, held, tokens, index
        if not ids:
            return
        h = np.concatenate((np.array(index.hashes, np.uint64), [END, START]))
        order = np.lexsort((h, _part(h, parts)))
        place = np.argsort(order)
        lens = np.array([len(x) + 1 for x in tokens], np.int32)
        end = [np.array([len(h) - 2])]
        flat = place[np.concatenate([y for x in tokens for y in (x, *end)])].astype(np.int32)
        batch = TaskContext.get().partitionId() * 2**32 + seq
        seq += 1
        values = [batch, ids, held, lens.tobytes(), h[order].tobytes(), _zip(flat)]
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=["batch", "ids", "held", "lens", "words", "tokens"])
        ids, held, tokens, index = [], [], [], words.Index()

    size = 0
    for row in rows:
        for i, text in zip(row.column(0).to_pylist(), words.column_bytes(row, "text"), strict=True):
            ids.append(i)
            held.append(i is not None and zlib.crc32(str(i).encode()) % fold == 0)
            tokens.append(index.numbers(words.split(text)))
            size += len(tokens[-1]) + 1
            if size >= BATCH_TOKENS:
                yield from flush()
                size = 0
    yield from flush()


class Batch:
    """A batch's tokens, with the pairs of context and word that they make."""

    def __init__(self, row: dict) -> None:
        self.row, self.lens = row, np.frombuffer(row["lens"], np.int32)
        self.words, self.tokens = np.frombuffer(row["words"], np.uint64), _unzip(row["tokens"], np.int32).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lens)[:-1]))
        self.train = np.repeat(~np.array(row["held"], bool), self.lens)
        before = np.concatenate(([0], self.tokens[:-1]))
        before[self.starts] = int(np.flatnonzero(self.words == START)[0])
        self.before = before

    def pair(self) -> Batch:
        """Numbers the distinct pairs of context and word."""
        self.pairs, self.of = np.unique(self.before * len(self.words) + self.tokens, return_inverse=True)
        self.u, self.w = self.pairs // len(self.words), self.pairs % len(self.words)
        self.count = np.bincount(self.of[self.train], minlength=len(self.pairs))
        return self

    def bounds(self, part: np.ndarray, parts: int) -> np.ndarray:
        return np.searchsorted(part, np.arange(parts + 1))

    def dealt(self, hot: dict, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """The order in which pairs are sent, and their partitions in that order."""
        hu, salt = self.words[self.u], np.zeros(len(self.u), np.uint64)
        for h, (_, _, n) in hot.items():
            at = np.flatnonzero(hu == np.uint64(h))
            salt[at] = words.mix(self.words[self.w[at]]) % np.uint64(n) + np.uint64(1)
        part = _part(hu + salt * np.uint64(0x9E3779B97F4A7C15), parts)
        order = np.lexsort((self.u, part))
        return order, part[order]


def _asking(rows: Iterator[pa.RecordBatch], labels: list[int]) -> Iterator[pa.RecordBatch]:
    for row in (r for b in rows for r in b.to_pylist()):
        b = Batch(row)
        n = len(b.words)
        counts = np.bincount(b.tokens[b.train], minlength=n)
        counts[b.words == START] = int(np.sum(~np.array(row["held"], bool)))
        ends = b.bounds(_part(b.words, len(labels)), len(labels))
        for p, label in enumerate(labels):
            s = slice(ends[p], ends[p + 1])
            if ends[p] < ends[p + 1]:
                values = [label, p, row["batch"], b.words[s].tobytes(), _zip(counts[s].astype(np.int32))]
                types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=["label", "part", "batch", "words", "counts"])


_COUNTED = "kind byte, batch long, part int, a long, b long, counts binary"


def _counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: answers to batches; kind 1: sums of a partition (a: tokens, b: distinct); kind 2: hot contexts (batch:
    hash, a: tokens)."""

    def out(*values) -> pa.RecordBatch:
        types = [pa.int8(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=[c.split()[0] for c in _COUNTED.split(", ")])

    for part, asked in _by_part(rows).items():
        h, of = np.unique(np.concatenate([np.frombuffer(r["words"], np.uint64) for r in asked]), return_inverse=True)
        counts = np.bincount(of, np.concatenate([_unzip(r["counts"], np.int32) for r in asked]))
        token = h != START
        n, v = int(counts[token].sum()), int((counts[token] > 0).sum())
        yield out(1, 0, part, n, v, None)
        for i in np.flatnonzero((counts * HOT >= max(n, HOT * 1000)) | ~token):
            yield out(2, int(h[i].view(np.int64)), part, int(counts[i]), 0, None)
        at = 0
        for r in asked:
            s = of[at : at + len(r["words"]) // 8]
            at += len(s)
            yield out(0, r["batch"], part, 0, 0, _zip(counts[s].astype(np.int64)))


def _by_part(rows: Iterator[pa.RecordBatch]) -> dict[int, list]:
    found: dict[int, list] = {}
    for r in (r for b in rows for r in b.to_pylist()):
        found.setdefault(r["part"], []).append(r)
    return found


def _joined(row: dict, column: str, kind) -> np.ndarray:
    return np.concatenate([_unzip(x[column], kind) for x in sorted(row["answers"], key=lambda x: x["part"])])


#: What partitions send each other: label and part say to whom, source (a partition or a batch) from whom.
_SENT = "kind byte, label int, part int, source long, a long, x double, y double, blobs array<binary>"
#: Pairs of a batch; their places among the pairs of a partition; the restaurants of a partition, and their seating;
#: tables by word; the parent's masses by word; sums of the parent (a: tables, x: mass, y: the unknown's); tables of a
#: hot context (source: hash, a: tables); the log probabilities of the pairs of a partition; the probabilities of a hot
#: context's pairs (a: place of the first), as if it had y tables, and what each table adds (x: those of this partition).
PAIRS, PLACES, LAYOUT, STATE, OPENED, MASSES, PARENT, TABLES, LOGP, LATE = range(10)


def _coded(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.round(-np.log10(np.maximum(p, 1e-31)) / GRAIN), 65535).astype(np.uint16)


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int8(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary())]
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in _SENT.split(", ")])


def _sending(rows: Iterator[pa.RecordBatch], labels: list[int], shared) -> Iterator[pa.RecordBatch]:
    for row in (r for b in rows for r in b.to_pylist()):
        b = Batch(row).pair()
        order, part = b.dealt(shared.value["hot"], len(labels))
        ends = b.bounds(part, len(labels))
        for p, label in enumerate(labels):
            e = order[ends[p] : ends[p + 1]]
            if len(e):
                u, runs = np.unique(b.u[e], return_counts=True)
                blobs = [_zip(b.words[u]), _zip(runs.astype(np.int32)), words.pack(b.words[b.w[e]] >> np.uint64(16), 6), _zip(b.count[e].astype(np.int32))]
                yield _sent([(PAIRS, label, p, row["batch"], len(e), 0.0, 0.0, blobs)])


def _pairs(sent: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Context, word and training count of the distinct pairs in order of the hashes, and the pair of each sent one."""
    u = np.concatenate([np.repeat(_unzip(r["blobs"][0], np.uint64), _unzip(r["blobs"][1], np.int32)) for r in sent])
    w = np.concatenate([words.unpack(r["blobs"][2], 6) for r in sent]) << np.uint64(16)
    counts = np.concatenate([_unzip(r["blobs"][3], np.int32) for r in sent])
    order = np.lexsort((w, u))
    new = np.ones(len(u), bool)
    new[1:] = (u[order][1:] != u[order][:-1]) | (w[order][1:] != w[order][:-1])
    of = np.empty(len(u), np.int64)
    of[order] = np.cumsum(new) - 1
    first = order[new]
    return u[first], w[first], np.bincount(of, counts).astype(np.int64), of


class Restaurants:
    """The restaurants of a partition, as sent from sweep to sweep: contexts with their pairs, the pairs' words (numbers into words, which are in
    order of partition and hash) and customers, which stay; and their seating: tables and weights of the pairs, their
    tables summed over the samples, and each sample's probabilities of the words and tables of the contexts."""

    LAYOUT = {"context": np.uint64, "runs": np.int32, "words": np.uint64, "w": np.int32, "c": np.int32}
    STATE = {"t": np.int32, "weight": np.float32, "seats": np.int32, "bases": np.float32, "tables": np.int64}

    def __init__(self, **columns: np.ndarray) -> None:
        self.__dict__.update(columns)
        self.group = np.repeat(np.arange(len(self.context)), self.runs)
        self.bases, self.tables = self.bases.reshape(-1, len(self.words)), self.tables.reshape(-1, len(self.context))

    @classmethod
    def of_pairs(cls, u: np.ndarray, w: np.ndarray, c: np.ndarray, parts: int) -> Restaurants:
        context, runs = np.unique(u, return_counts=True)
        known, at = np.unique(w, return_inverse=True)
        order = np.lexsort((known, _part(known, parts)))
        place = np.argsort(order)
        # one customer has one table, whatever is drawn
        return cls(context=context, runs=runs, words=known[order], w=place[at], c=c, t=np.minimum(c, 1), weight=np.where(c > 1, -np.inf, 0.0),
                   seats=np.zeros(len(c), np.int32), bases=np.zeros(0), tables=np.zeros(0, np.int64))

    @classmethod
    def unpack(cls, layout: list[bytes], state: list[bytes]) -> Restaurants:
        kinds = cls.LAYOUT | cls.STATE
        return cls(**{k: _unzip(x, kind) for (k, kind), x in zip(kinds.items(), [*layout, *state], strict=True)})

    def pack(self, kinds: dict) -> list[bytes]:
        return [_zip(getattr(self, k).astype(kind)) for k, kind in kinds.items()]

    def hot(self, hot: dict) -> list[int]:
        return np.flatnonzero(np.isin(self.context, np.array(list(hot), np.uint64))).tolist()

    def customers(self, hot: dict) -> np.ndarray:
        customers = np.bincount(self.group, self.c, minlength=len(self.context))
        for i in self.hot(hot):
            customers[i] = hot[int(self.context[i])][0]
        return customers

    def sweep(self, base: np.ndarray, hot: dict, tables: dict, rng: np.random.Generator, sample: bool) -> None:
        """Seats all dishes once, base being the parent's probabilities of words; a sample is remembered. How many tables a hot
        context has after it is known in the next sweep alone, when other partitions have told theirs."""
        elsewhere, here = np.zeros(len(self.context)), np.bincount(self.group, self.t, minlength=len(self.context))
        for i in self.hot(hot):
            elsewhere[i] = max(0.0, tables.get(int(self.context[i]), 0) - here[i])
            self.tables[-1:, i] = tables.get(int(self.context[i]), 0)
        _, t, weight = gibbs(self.c, self.t, self.weight, base[self.w], self.group, self.customers(hot), elsewhere, D, THETA, rng, 1, 0)
        self.t, self.weight = t.astype(np.int32), np.where(self.c > 1, weight, 0.0)
        if sample:
            now = elsewhere + np.bincount(self.group, self.t, minlength=len(self.context))
            self.seats = self.seats + self.t
            self.bases, self.tables = np.vstack((self.bases, base)), np.vstack((self.tables, now.astype(np.int64)))

    def probabilities(self, hot: dict) -> np.ndarray:
        """The pairs' predictive probabilities, averaged over the samples."""
        total = len(self.bases) * self.c - D * self.seats
        for base, tables in zip(self.bases, self.tables, strict=True):
            total += (THETA + D * tables)[self.group] * base[self.w]
        return total / (len(self.bases) * (THETA + self.customers(hot)))[self.group]

    def late(self, part: int, labels: list[int], hot: dict, p: np.ndarray) -> list[tuple]:
        """The probabilities p of contexts that are dealt over several partitions, whose last tables are not known yet."""
        here, starts, out = np.bincount(self.group, self.t, minlength=len(self.context)), np.concatenate(([0], np.cumsum(self.runs))), []
        for i in (i for i in self.hot(hot) if hot[int(self.context[i])][2] > 1):
            s = slice(starts[i], starts[i + 1])
            each = D * self.bases[-1][self.w[s]] / (len(self.bases) * (THETA + hot[int(self.context[i])][0]))
            blobs = [_zip(x.astype(np.float32)) for x in (p[s], each)]
            out.append((LATE, labels[part], part, int(self.context[i].view(np.int64)), int(starts[i]), float(here[i]), float(self.tables[-1][i]), blobs))
        return out

    def rows(self, part: int, labels: list[int], hot: dict) -> list[tuple]:
        """The seating, the tables of each word for the word's partition, and those of hot contexts."""
        out = [(STATE, labels[part], part, part, 0, 0.0, 0.0, self.pack(self.STATE))]
        opened = np.bincount(self.w, self.t, minlength=len(self.words)).astype(np.int64)
        ends = np.searchsorted(_part(self.words, len(labels)), np.arange(len(labels) + 1))
        for q, label in enumerate(labels):
            s = slice(ends[q], ends[q + 1])
            if ends[q] < ends[q + 1]:
                out.append((OPENED, label, q, part, 0, 0.0, 0.0, [_zip(self.words[s]), _zip(opened[s])]))
        here = np.bincount(self.group, self.t, minlength=len(self.context))
        out += [(TABLES, labels[part], part, int(self.context[i].view(np.int64)), int(here[i]), 0.0, 0.0, []) for i in self.hot(hot)]
        return out


def _gathered(rows: Iterator[pa.RecordBatch], labels: list[int], shared) -> Iterator[pa.RecordBatch]:
    for part, sent in _by_part(rows).items():
        u, w, c, of = _pairs(sent)
        at = 0
        for r in sent:
            n = r["a"]
            yield _sent([(PLACES, labels[part], part, r["source"], 0, 0.0, 0.0, [_zip(of[at : at + n].astype(np.int32))])])
            at += n
        all_ = Restaurants.of_pairs(u, w, c, len(labels))
        yield _sent([(LAYOUT, labels[part], part, part, 0, 0.0, 0.0, all_.pack(all_.LAYOUT)), *all_.rows(part, labels, shared.value["hot"])])


def seat_parent(opened: np.ndarray, v: int, elsewhere: float, rng: np.random.Generator) -> tuple[np.ndarray, float, int]:
    """The parent's masses of words (0: not known), the unknown's mass and the tables, seated for opened customers."""
    base = 1.0 / (v + 1)
    start = np.where(opened > 1, -np.inf, 0.0)
    mass, t, _ = gibbs(opened, np.minimum(opened, 1), start, np.full(len(opened), base), np.zeros(len(opened), np.int64), np.array([0.0]),
                       np.array([elsewhere]), D_PARENT, THETA_PARENT, rng, BURN_IN, SAMPLES)
    return np.where(opened > 0, mass * THETA_PARENT, 0.0), (THETA_PARENT + D_PARENT * (elsewhere + t.sum())) * base, int(t.sum())


def _parents(rows: Iterator[pa.RecordBatch], labels: list[int], shared, sweep: int) -> Iterator[pa.RecordBatch]:
    v, before = shared.value["v"], shared.value["parent_tables"]
    for part, asked in _by_part(rows).items():
        asked.sort(key=lambda r: r["source"])
        theirs = [_unzip(r["blobs"][0], np.uint64) for r in asked]
        h, of = np.unique(np.concatenate(theirs), return_inverse=True)
        opened = np.bincount(of, np.concatenate([_unzip(r["blobs"][1], np.int64) for r in asked])).astype(np.int64)
        elsewhere = float(sum(before.values()) - before[part] if before else v - (opened > 0).sum())
        mass, unknown, tables = seat_parent(opened, v, elsewhere, np.random.default_rng([7, sweep, part]))
        out, at = [(PARENT, labels[part], part, part, tables, float(mass.sum()), unknown, [])], 0
        for r, words_ in zip(asked, theirs, strict=True):
            s = of[at : at + len(words_)]
            at += len(s)
            out.append((MASSES, labels[r["source"]], r["source"], part, 0, 0.0, 0.0, [_zip(mass[s].astype(np.float32))]))
        yield _sent(out)


def _seated(rows: Iterator[pa.RecordBatch], labels: list[int], shared, sweep: int) -> Iterator[pa.RecordBatch]:
    s = shared.value
    for part, got in _by_part(rows).items():
        layout, seating = (next(r["blobs"] for r in got if r["kind"] == kind) for kind in (LAYOUT, STATE))
        state = Restaurants.unpack(layout, seating)
        masses = sorted((r for r in got if r["kind"] == MASSES), key=lambda r: r["source"])
        mass = np.concatenate([_unzip(r["blobs"][0], np.float32) for r in masses]).astype(float)
        base = np.where(mass > 0, mass, s["unknown"]) / s["mass"]
        state.sweep(base, s["hot"], s["tables"], np.random.default_rng([8, sweep, part]), sweep >= BURN_IN)
        if sweep < BURN_IN + SAMPLES - 1:
            yield _sent(state.rows(part, labels, s["hot"]))
        else:
            p = state.probabilities(s["hot"])
            yield _sent([(LOGP, labels[part], part, part, 0, 0.0, 0.0, [_zip(_coded(p))]), *state.late(part, labels, s["hot"], p)])


def _found(rows: Iterator[pa.RecordBatch], tables) -> Iterator[pa.RecordBatch]:
    """The log probabilities of the pairs that each batch has sent; tables: of the contexts of several partitions."""
    for part, got in _by_part(rows).items():
        logp = _unzip(next(r["blobs"][0] for r in got if r["kind"] == LOGP), np.uint16)
        for r in (r for r in got if r["kind"] == LATE):
            p, each = (_unzip(x, np.float32).astype(float) for x in r["blobs"])
            logp[r["a"] : r["a"] + len(p)] = _coded(p + (tables.value[r["source"]] - r["y"]) * each)
        for r in (r for r in got if r["kind"] == PLACES):
            found = _zip(logp[_unzip(r["blobs"][0], np.int32)])
            yield pa.RecordBatch.from_arrays([pa.array([r["source"]], pa.int64()), pa.array([part], pa.int32()), pa.array([found], pa.binary())], names=["batch", "part", "logp"])


def _scored(rows: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    s = shared.value
    for row in (r for b in rows for r in b.to_pylist()):
        b = Batch(row).pair()
        counts = _joined(row, "counts", np.int64)[b.tokens]
        order, _ = b.dealt(s["hot"], s["parts"])
        logp = np.empty(len(order))
        logp[order] = np.concatenate([_unzip(x["logp"], np.uint16) for x in sorted(row["found"], key=lambda x: x["part"])]) * -GRAIN
        add = lambda x: np.add.reduceat(x, b.starts)  # noqa: B023, E731
        base = np.log10((counts + 0.1) / (s["n"] + 0.1 * (s["v"] + 1)))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(row["ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(b.lens.astype(np.int64)), pa.array(add((counts > 0).astype(np.int64))),
                pa.array(np.full(len(b.lens), s["n"], np.int64)), pa.array(add(base)), pa.array(add(logp[b.of])),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 10) -> DataFrame:
    """doc_id, held_out (crc32 of the id mod fold is 0), n_tokens, n_known, train_tokens, base_score, score per row."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, min(common.shuffle_parts(spark), -(-size // PART_BYTES)))
    labels = common.even_labels(spark, parts)
    batches = common.materialize(
        base.mapInArrow(lambda r: _batches(r, parts, fold), "batch long, ids array<long>, held array<boolean>, lens binary, words binary, tokens binary"), "batches"
    )
    asking = batches.mapInArrow(lambda r: _asking(r, labels), "label int, part int, batch long, words binary, counts binary")
    counted = common.materialize(asking.repartition(parts, "label").mapInArrow(_counted, _COUNTED), "counted")
    n, v = (x or 0 for x in counted.filter("kind = 1").agg(F.sum("a"), F.sum("b")).first())
    hot = {r[0] & (2**64 - 1): (r[1], 0, max(1, -(-r[1] * HOT * parts // max(n, 1)))) for r in counted.filter("kind = 2").select("batch", "a").collect()}
    model = {"hot": hot, "n": n, "v": v, "parts": parts, "parent_tables": {}}
    shared = spark.sparkContext.broadcast(model)
    sending = batches.mapInArrow(lambda r, shared=shared: _sending(r, labels, shared), _SENT)
    layout = common.materialize(sending.repartition(parts, "label").mapInArrow(lambda r, shared=shared: _gathered(r, labels, shared), _SENT), "restaurants")
    state = layout
    for sweep in range(BURN_IN + SAMPLES):
        now = spark.sparkContext.broadcast(model)
        opened = state.filter(F.col("kind") == OPENED).repartition(parts, "label")
        parents = common.materialize(opened.mapInArrow(lambda r, now=now, sweep=sweep: _parents(r, labels, now, sweep), _SENT), "parents")
        sums = parents.filter(F.col("kind") == PARENT).select("part", "a", "x", "y").collect()
        tables = state.filter(F.col("kind") == TABLES).groupBy("source").agg(F.sum("a")).collect()
        unknown = float(np.mean([r[3] for r in sums])) if sums else 1.0
        model = model | {
            "parent_tables": {p: 0 for p in range(parts)} | {r[0]: r[1] for r in sums}, "tables": {r[0] & (2**64 - 1): r[1] for r in tables},
            "mass": sum(r[2] for r in sums) + unknown, "unknown": unknown,
        }
        then = spark.sparkContext.broadcast(model)
        got = layout.filter(F.col("kind") == LAYOUT).unionByName(state.filter(F.col("kind") == STATE)).unionByName(parents.filter(F.col("kind") == MASSES))
        got, last = got.repartition(parts, "label"), [parents, state] if sweep else [parents]
        state = common.materialize(got.mapInArrow(lambda r, then=then, sweep=sweep: _seated(r, labels, then, sweep), _SENT), "restaurants")
        common.discard(*last)
        now.destroy()
        then.destroy()
    late = spark.sparkContext.broadcast(dict(state.filter(F.col("kind") == LATE).groupBy("source").agg(F.sum("x")).collect()))
    seated = layout.filter(F.col("kind") == PLACES).unionByName(state.filter(F.col("kind").isin(LOGP, LATE))).repartition(parts, "label")
    seated = common.materialize(seated.mapInArrow(lambda r: _found(r, late), "batch long, part int, logp binary"), "probabilities")
    late.destroy()
    common.discard(layout, state)
    answers = counted.filter("kind = 0").groupBy("batch").agg(F.collect_list(F.struct("part", "counts")).alias("answers"))
    found = seated.groupBy("batch").agg(F.collect_list(F.struct("part", "logp")).alias("found"))
    whole = batches.join(answers, "batch").join(found, "batch")
    return whole.mapInArrow(
        lambda r: _scored(r, shared),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(common.table(spark, sf_dir, "documents"))
