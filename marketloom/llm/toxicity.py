"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, calibrated votes.

Terms are a text's letter words, A-Z lower-cased. The examples are at most SAMPLE labelled documents (those with the
smallest hashes of id and label; of a repeated id the text with the smallest hash). All their terms are indexed. A
term's weight is (1 + log tf) * idf * relevance: document frequencies are counted over all documents, and relevance is
FLOOR plus the standard deviations, beyond NOISE, by which the labels of the examples that hold the term differ from
the mean; so a term that tells nothing about the labels still counts, by FLOOR. Terms that no example holds have no
part in a vector.

The index is bounded by SAMPLE texts and broadcast: for each term its postings in blocks of BLOCK examples, with the
largest weight of each block. Terms that 1/LONG of the examples or more hold are kept as columns of a matrix instead (at
most COLUMNS). A document's K nearest examples are found exactly: the bound of a block is the largest sum over the
matrix plus, over the other terms, weight times block maximum; the blocks with the largest bounds are scored first, then
those whose bound reaches the K-th best cosine found, and no others. Votes are weighted by 1/(distance + 0.05) and
smoothed by the base rate; the vote is calibrated by isotonic regression on the examples, each scored without
itself. Evidence is the ids of the nearest examples.

Defined results: documents without a term of the examples have cosine 0 with all and get the calibrated base rate, so
do null and empty texts; labels of ids that are missing or null are not used; an id with both labels is an example
for each, and equal rows of labels count once; without any labelled example every score is 0; an empty table gives no
rows; ties go to the example with the smaller number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import common, words

SAMPLE = 6144
FLOOR, NOISE = 0.3, 3.0
BLOCK = 64
LONG, COLUMNS = 16, 512
#: What sums in single precision may be off by, at most.
SLACK = 1e-5
K = 15
#: Documents that are scored together, at most, and the index entries that they look up, but for a text that has more.
TOGETHER, ENTRIES = 64, 400_000
#: Blocks that a document scores before the others are held against its K-th best cosine.
FIRST_BLOCKS = 4
THRESHOLD = 0.7
#: Terms whose counts travel in one row.
RANGE = 8192

_LETTERS = re.compile(r"[^\W\d_]+")
#: For ASCII texts the same words by bytes: letters in lower case, all else spaces.
_ASCII = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(256))


def _words(text: bytes) -> list:
    return text.translate(_ASCII).split() if text.isascii() else _LETTERS.findall(text.lower().decode("utf-8", "replace"))


class Terms:
    """Counts the terms of texts: as numbers of a known vocabulary (ascending hashes), or as hashes if there is none."""

    def __init__(self, known: np.ndarray | None = None) -> None:
        self.known, self.index, self.numbers = known, words.Index(), np.zeros(0, np.int64)

    def counts(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the texts, their distinct terms and how often each occurs, ascending."""
        if self.index.full:
            self.index, self.numbers = words.Index(), self.numbers[:0]
        parts = [self.index.numbers(_words(t)) if t else np.zeros(0, np.int64) for t in texts]
        new = np.array(self.index.hashes[len(self.numbers) :], np.uint64)
        if self.known is None:
            self.numbers = np.concatenate((self.numbers, new.view(np.int64)))
        elif len(new):
            at = np.minimum(np.searchsorted(self.known, new), max(len(self.known) - 1, 0))
            found = self.known[at] == new if len(self.known) else np.zeros(len(new), bool)
            self.numbers = np.concatenate((self.numbers, np.where(found, at, -1)))
        place = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        words_ = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        if self.known is not None:  # what no example holds need not be counted
            held = self.numbers[words_] >= 0
            place, words_ = place[held], words_[held]
        pairs, n = np.unique(place * max(len(self.numbers), 1) + words_, return_counts=True)
        place, words_ = np.divmod(pairs, max(len(self.numbers), 1))
        term = self.numbers[words_]
        return place, term if self.known is not None else term.view(np.uint64), n


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, length long, one after the other."""
    return np.repeat((start - np.cumsum(length) + length).astype(np.int32), length) + np.arange(length.sum(), dtype=np.int32)


class BlockMaxIndex:
    """Vectors of n examples: (example, term, weight) triples, weights above 0, by term, in blocks of BLOCK examples with
    each block's largest weight; the terms most held as columns of a matrix."""

    def __init__(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, terms: int) -> None:
        self.n, self.blocks = n, max(1, -(-n // BLOCK))
        held = np.bincount(term, minlength=terms)
        long = np.flatnonzero(held * LONG >= max(n, 4 * LONG))
        long = long[np.argsort(-held[long], kind="stable")[:COLUMNS]]
        self.column = np.full(terms, -1)
        self.column[long] = np.arange(len(long))
        self.matrix, self.narrow = np.zeros((n, len(long))), None
        dense = self.column[term] >= 0
        self.matrix[example[dense], self.column[term[dense]]] = weight[dense]
        order = np.lexsort((example[~dense], term[~dense]))
        self.example, term, self.weight = example[~dense][order].astype(np.int32), term[~dense][order], weight[~dense][order]
        key = term.astype(np.int64) * self.blocks + self.example // BLOCK
        self.entry = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))).astype(np.int32) if len(key) else np.zeros(0, np.int32)
        self.length = np.diff(np.append(self.entry, len(key))).astype(np.int8)
        self.block = (key[self.entry] % self.blocks).astype(np.int16 if self.blocks < 2**15 else np.int32)
        self.most = np.maximum.reduceat(self.weight, self.entry).astype(np.float32) if len(key) else np.zeros(0, np.float32)
        self.start = np.searchsorted(key[self.entry] // self.blocks, np.arange(terms + 1)).astype(np.int32)

    def nearest(self, place: np.ndarray, term: np.ndarray, weight: np.ndarray, queries: int, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each query (unit vectors as triples) the k examples with the largest cosine above 0, best first, and the
        cosines; -1 and 0 where there are fewer. skip: an example that each query leaves out."""
        dense = self.column[term] >= 0
        q = np.zeros((queries, self.matrix.shape[1]))
        q[place[dense], self.column[term[dense]]] = weight[dense]
        if self.narrow is None:
            self.narrow = np.ascontiguousarray(self.matrix.T, np.float32)
        # Single precision finds the candidates, with a margin of SLACK; their cosines are then taken in double precision.
        base = np.zeros((queries, self.blocks * BLOCK))
        base[:, : self.n] = q.astype(np.float32) @ self.narrow
        if skip is not None:
            base[np.arange(queries), skip] = -10.0
        place, term, weight = place[~dense], term[~dense], weight[~dense]
        entries = self.start[term + 1] - self.start[term]
        at = _ranges(self.start[term], entries)
        who, by = np.repeat(place.astype(np.int32), entries), np.repeat(weight, entries)
        cell = who * self.blocks + self.block[at]
        rare = np.bincount(cell, by * self.most[at], minlength=queries * self.blocks).reshape(queries, -1)
        bound = base.reshape(queries, self.blocks, BLOCK).max(axis=2) + rare

        def scored(chosen: np.ndarray) -> np.ndarray:
            """The cosines of all examples in the chosen blocks of each query; -1 elsewhere."""
            use = np.flatnonzero(chosen.ravel()[cell])
            entry = at[use]
            n = self.length[entry].astype(np.int32)
            posts = _ranges(self.entry[entry], n)
            flat = np.repeat(who[use] * (self.blocks * BLOCK), n) + self.example[posts]
            out = np.where(np.repeat(chosen, BLOCK, axis=1), base, -1.0).ravel()
            return (out + np.bincount(flat, np.repeat(by[use], n) * self.weight[posts], minlength=len(out))).reshape(queries, -1)

        k = min(k, self.n)
        first = np.zeros((queries, self.blocks), bool)
        np.put_along_axis(first, np.argsort(-bound, axis=1, kind="stable")[:, :FIRST_BLOCKS], True, axis=1)
        s = scored(first)
        enough = np.maximum(-np.partition(-s, k - 1, axis=1)[:, k - 1], 1e-12)  # no block below this can hold a better example
        rest = ~first & (bound >= enough[:, None] - SLACK)
        if rest.any():
            s = np.maximum(s, scored(rest))
            enough = np.maximum(-np.partition(-s, k - 1, axis=1)[:, k - 1], 1e-12)
        rows, found = np.nonzero((s >= enough[:, None] - SLACK) & (s > 1e-12))
        exact = s[rows, found] - base[rows, found] + np.einsum("ij,ij->i", q[rows], self.matrix[found])
        order = np.lexsort((found, -np.round(exact, 11), rows))
        rows, found, exact = rows[order], found[order], exact[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        rows, found, exact, rank = rows[rank < k], found[rank < k], exact[rank < k], rank[rank < k]
        near, cosine = np.full((queries, k), -1), np.zeros((queries, k))
        near[rows, rank], cosine[rows, rank] = found, exact
        return near, cosine


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing steps that fit y best: (right ends of the steps, values)."""
    ends, sums, counts = [], [], []
    values, of = np.unique(x, return_inverse=True)
    for a, s, c in zip(values, np.bincount(of, y), np.bincount(of), strict=True):
        ends.append(a)
        sums.append(float(s))
        counts.append(int(c))
        while len(sums) > 1 and sums[-2] / counts[-2] >= sums[-1] / counts[-1]:
            s, c, e = sums.pop(), counts.pop(), ends.pop()
            sums[-1] += s
            counts[-1] += c
            ends[-1] = e
    return np.array(ends), np.array(sums) / np.maximum(np.array(counts), 1)


class Model:
    """The terms of the examples (ascending hashes) with their weights, the index, and the calibration."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, example: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> None:
        self.ids, self.labels = ids, labels.astype(float)
        self.known, term = np.unique(hashes, return_inverse=True)
        self.example, self.term, self.counts = example, term.astype(np.int32), counts
        self.base = float(self.labels.mean()) if len(labels) else 0.0
        self.ends, self.values = np.zeros(1), np.zeros(1)

    def complete(self, df: np.ndarray, total: int) -> Model:
        """Weighs the terms by their document frequencies among total documents, builds the index and calibrates."""
        n, rate = len(self.labels), self.base
        held, hits = np.bincount(self.term, minlength=len(self.known)), np.bincount(self.term, self.labels[self.example], minlength=len(self.known))
        z = np.abs(hits - held * rate) / np.sqrt(np.maximum(held * rate * (1 - rate) * (1 - held / max(n, 1)), 1e-9))
        z[held == n] = 0
        self.weights = (np.log((1 + total) / (1 + df)) + 1) * (FLOOR + np.maximum(z - NOISE, 0))
        self.index = BlockMaxIndex(*self._unit(self.example, self.term, self.counts, n), n, len(self.known))
        raw, order = np.zeros(n), np.argsort(self.example, kind="stable")
        step = TOGETHER // 4  # on the driver, whose memory is scarcer
        starts = np.searchsorted(self.example[order], np.arange(0, n + step, step))
        for at, a, b in zip(range(0, n, step), starts, starts[1:]):
            some, skip = order[a:b], np.arange(at, min(at + step, n))
            raw[skip] = self._votes(self.example[some] - at, self.term[some], self.counts[some], len(skip), skip)[0]
        if n:
            self.ends, self.values = isotonic(raw, self.labels)
        self.example = self.term = self.counts = self.index.narrow = None  # each worker makes its own
        return self

    def _unit(self, place: np.ndarray, term: np.ndarray, n: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w = (1 + np.log(n)) * self.weights[term]
        return place, term, w / np.sqrt(np.bincount(place, w * w, minlength=texts))[place]

    def _votes(self, place, term, n, texts: int, skip=None) -> tuple[np.ndarray, np.ndarray]:
        """Distance-weighted shares of label 1, smoothed by one vote of the base rate at distance 1, and the voters."""
        near, cosine = self.index.nearest(*self._unit(place, term, n, texts), texts, K, skip)
        weight = np.where(near >= 0, 1 / (1 - np.minimum(cosine, 1) + 0.05), 0)
        return np.round(((weight * self.labels[near]).sum(axis=1) + self.base) / (weight.sum(axis=1) + 1), 9), near

    def entries(self, place: np.ndarray, term: np.ndarray, texts: int) -> np.ndarray:
        """How many entries of the index the terms of each text look up."""
        return np.bincount(place, np.diff(self.index.start)[term], minlength=texts).astype(np.int64)

    def score(self, place: np.ndarray, term: np.ndarray, n: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores of texts given as triples, and the numbers of their nearest examples (-1: none)."""
        if not len(self.labels):
            return np.zeros(texts), np.zeros((texts, 0), np.int64)
        raw, near = self._votes(place, term, n, texts)
        return self.values[np.minimum(np.searchsorted(self.ends, raw), len(self.values) - 1)], near


def _occurring(batches: Iterator[pa.RecordBatch], known) -> Iterator[pa.RecordBatch]:
    """How many of a task's texts each term of the vocabulary is in: a row for each RANGE terms."""
    words.release()
    terms, total = Terms(known.value), np.zeros(len(known.value), np.int64)
    for batch in (b.slice(at, words.SLICE) for b in batches for at in range(0, b.num_rows, words.SLICE)):
        total += np.bincount(terms.counts(words.column_bytes(batch, "text"))[1], minlength=len(total))
    starts = range(0, len(total), RANGE)
    yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array([total[a : a + RANGE].tobytes() for a in starts], pa.binary())], names=["start", "n"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for start, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[start] = total.get(start, 0) + np.frombuffer(n, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(total, pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["start", "n"])


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms = Terms()
    for batch in (b.slice(at, words.SLICE) for b in batches for at in range(0, b.num_rows, words.SLICE)):
        place, hashes, n = terms.counts(words.column_bytes(batch, "text"))
        ends = np.searchsorted(place, np.arange(batch.num_rows + 1))
        packed = [[x[a:b].tobytes() for a, b in zip(ends, ends[1:])] for x in (hashes, n.astype(np.int32))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(p, pa.binary()) for p in packed]], names=["doc_id", "label", "terms", "n"])


def fit(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from labelled (id, label) rows; their number used is bounded by SAMPLE."""
    spark = docs.sparkSession
    labels = labelled.select(F.col(id_col).cast("long").alias("doc_id"), (F.col("label") == 1).cast("int").alias("label")).dropna().distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chosen = common.materialize(common.smallest_hashes(labels, ["doc_id", "label"], SAMPLE), "labels")
    # At most SAMPLE ids, so that the semi-join with all documents needs no shuffle of their texts.
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = found.mapInArrow(_example_terms, "doc_id long, label int, terms binary, n binary").collect()
    rows.sort(key=lambda r: (r["label"], r["doc_id"]))  # examples of one label share blocks, which makes the bounds tighter
    lengths = [len(r["n"]) // 4 for r in rows]
    joined = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in rows]) if rows else np.zeros(0, kind)
    packed = [np.array([r["doc_id"] for r in rows], np.int64), np.array([r["label"] for r in rows], float), np.repeat(np.arange(len(rows), dtype=np.int32), lengths), joined("terms", np.uint64), joined("n", np.int32)]
    del rows, joined  # the driver's memory is scarce
    model = Model(*packed)
    del packed
    known = spark.sparkContext.broadcast(model.known)
    counted = texts.select("text").mapInArrow(lambda rows: _occurring(rows, known), "start long, n binary")
    parts = max(1, min(common.shuffle_parts(spark), -(-len(model.known) // RANGE)))
    df, total = np.zeros(len(model.known), np.int64), texts.count()
    for start, n in counted.repartition(parts, "start").mapInArrow(_summed, "start long, n binary").collect():
        df[start : start + RANGE] = np.frombuffer(n, np.int64)
    known.destroy()
    model.complete(df, total)
    words.release()
    return model


def together(entries: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs (start, end) of texts that look up so many index entries each: TOGETHER texts and ENTRIES at most, one text at least."""
    at, total = 0, np.concatenate(([0], np.cumsum(entries)))
    while at < len(entries):
        end = max(at + 1, min(at + TOGETHER, int(np.searchsorted(total, total[at] + ENTRIES, "right")) - 1))
        yield at, end
        at = end


def _scored(model: Model, terms: Terms, texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    place, term, n = terms.counts(texts)
    for at, end in together(model.entries(place, term, len(texts))):
        a, b = np.searchsorted(place, (at, end))
        yield model.score(place[a:b] - at, term[a:b], n[a:b], end - at)


def _scores(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    words.release()
    model = shared.value
    terms = Terms(model.known)
    for batch in (b.slice(at, words.SLICE) for b in batches for at in range(0, b.num_rows, words.SLICE)):
        scores, nearest = [np.zeros(0)], []
        for score, near in _scored(model, terms, words.column_bytes(batch, "text")):
            scores.append(score)
            nearest += [model.ids[row[row >= 0]].tolist() for row in near]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.concatenate(scores)), pa.array(nearest, pa.list_(pa.int64()))], names=["doc_id", "score", "nearest"]
        )


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and nearest (ids of the examples that voted, nearest first) for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _scores(batches, shared), "doc_id long, score double, nearest array<long>")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)
    del model
    words.release()

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words.release()
        terms = Terms(shared.value.known)
        for batch in (b.slice(i, words.SLICE) for b in batches for i in range(0, b.num_rows, words.SLICE)):
            texts = batch.column(at).cast(pa.large_binary()).to_pylist()
            scores = [np.zeros(0), *(s for s, _ in _scored(shared.value, terms, texts))]
            yield batch.filter(pa.array(np.concatenate(scores) < threshold))

    return common.filtered(docs, kept)


def fold(id_col: str, folds: int):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def fitted(spark: SparkSession, sf_dir: str, docs: DataFrame) -> Model:
    """The model of the query: labels only of ids whose crc32 mod 3 is not 1."""
    labels = common.table(spark, sf_dir, "labels").filter(fold("doc_id", 3) != 1)
    return fit(docs, labels.select("doc_id", F.col("toxic").alias("label")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scored = score(docs, fitted(spark, sf_dir, docs))
    return scored.select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "nearest"
    )
