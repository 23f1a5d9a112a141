"""Benchmark decontamination: every training passage queries a BM25 index of test items with block-max WAND.

Passages are windows of twice the longest item's words, half overlapping, so that any item copied into a text lies in
one of them. Items of more than MOST_WORDS / 2 words do not widen the passages of the others: they are searched by
passages of their own, one length for each power of two. Words of marks alone count neither in items nor in texts. Term weights of an item are divided by the item's score for its own
text, so one threshold fits all items. Block-max WAND retrieves all items at or above the threshold, for all
items of many passages at once: with the terms in ascending order of their largest weight, those before the pivot
(the first at which the sum of the largest weights reaches the threshold) cannot lift an item over it alone, so
only items in later terms' postings are candidates; a candidate whose score there plus the block maxima of the
other terms stays below the threshold is passed over; the rest are scored in full. Before that, passages are passed
over together whose rare terms' largest weights, in each of at most GROUPS runs of blocks, fall short of the
threshold less the most that frequent terms give any item of the run.
A retrieved item counts only if word trigrams of both its question (all but the last third of its words) and
its answer (the last third) are in the passage to a share of OVERLAP.

The index is bounded: items are taken ITEMS at a time, each such block is indexed, broadcast and run over all
documents in turn, so the benchmark may be of any size. Document frequencies, mean length and passage lengths are those
of all items, and each pass takes the rows of the one before, so results don't depend on the number of blocks.

Defined results: null and empty texts, and items without words, are never contaminated or found; repeated items
are found each; an item of one word is all answer; a repeated document row is a row of its own; without items no document is contaminated; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import common, words

THRESHOLD = 0.5
OVERLAP = 0.5
K1, B = 1.2, 0.75
GRAM = 3
BLOCK = 16
GROUPS = 24
ITEMS = 20_000
#: Pairs of a passage and an item whose scores are held at once.
CELLS = 1_000_000
LEAST_WORDS, MOST_WORDS = 32, 512
BLANK = -2
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


class Vocabulary(dict):
    """Item words by number, looked up by any raw word; words of no item are -1, and those of marks alone BLANK."""

    def __init__(self, known: dict[bytes, int]) -> None:
        self.known = known

    def __missing__(self, word: bytes) -> int:
        if len(self) > words.MOST_WORDS:
            self.clear()
        bare = word.strip(_MARKS)
        self[word] = number = self.known.get(bare, -1) if bare else BLANK
        return number


@dataclass
class Statistics:
    """Of all items: how many have words, their mean length, the longest of each class of lengths, and the number of items
    that hold a word, for the words at hand."""

    n: int
    mean: float
    longest: dict[int, int]
    counts: dict[bytes, int]


def item_words(text: str | None) -> list[bytes]:
    return [w for w in (w.strip(_MARKS) for w in words.split((text or "").encode())) if w]


def sizes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of items as far as passages go by them, and the class of each."""
    size = np.maximum(lengths.astype(np.int64), LEAST_WORDS)
    return size, np.where(size <= MOST_WORDS // 2, 0, np.ceil(np.log2(size))).astype(np.int64)


class BenchmarkIndex:
    """Postings of normalised BM25 weights by term, in blocks of BLOCK items with each block's largest weight."""

    def __init__(self, items: list[tuple[int, str]], of_all: Statistics | None = None) -> None:
        """of_all: of all items, if these are a part of them; scores and passages are then the same as with all together."""
        known: dict[bytes, int] = {}
        kept = []
        for item_id, text in sorted(items, key=lambda x: x[0]):
            numbers = [known.setdefault(w, len(known)) for w in item_words(text)]
            if numbers:
                kept.append((item_id, numbers))
        self.known, self.ids = known, [k[0] for k in kept]
        n = len(kept)
        lengths = np.array([len(k[1]) for k in kept], float)
        size, span = sizes(lengths)
        longest = of_all.longest if of_all else {int(x): int(size[span == x].max()) for x in np.unique(span)}
        #: Half the words of an item's passages, and all there are.
        self.stride = np.array([longest[x] for x in span.tolist()], np.int64)
        self.strides = sorted(longest.values()) or [LEAST_WORDS]
        mean = of_all.mean if of_all else lengths.mean() if n else 1.0
        counts = [dict(zip(*np.unique(k[1], return_counts=True), strict=True)) for k in kept]
        df = np.zeros(len(known))
        for c in counts:
            df[list(c)] += 1
        total = of_all.n if of_all else n
        if of_all:
            df = np.array([of_all.counts[w] for w in known], float)
        idf = np.log(1 + (total - df + 0.5) / (df + 0.5))
        postings: dict[int, list[tuple[int, float]]] = {}
        for i, c in enumerate(counts):
            w = {t: idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * lengths[i] / mean)) for t, f in c.items()}
            own = sum(w.values())
            for t, x in w.items():
                postings.setdefault(int(t), []).append((i, x / own))
        self.n, self.blocks = n, -(-n // BLOCK)
        self.most = np.zeros(len(known) + 1)  # the last is for words of no item
        ids, weights, block_ids, block_most, lengths, block_lengths = [], [], [], [], [], []
        for t in range(len(known)):
            rows = sorted(postings[t])
            at, weight = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
            blocks, start = np.unique(at // BLOCK, return_index=True)
            self.most[t] = weight.max()
            ids.append(at)
            weights.append(weight)
            block_ids.append(blocks)
            block_most.append(np.maximum.reduceat(weight, start))
            lengths.append(len(at))
            block_lengths.append(len(blocks))
        joined = lambda x: np.concatenate(x) if x else np.zeros(0)
        self.postings = (np.concatenate(([0], np.cumsum(lengths))).astype(np.int64), joined(ids), joined(weights))
        self.block_most = (np.concatenate(([0], np.cumsum(block_lengths))).astype(np.int64), joined(block_ids), joined(block_most))
        groups = min(GROUPS, max(1, self.blocks))
        of = lambda i: np.asarray(i) // BLOCK * groups // max(1, self.blocks)
        self.rare = np.zeros((len(known) + 1, groups), np.float32)
        frequent = np.zeros(n)
        for t in range(len(known)):
            if df[t] * 16 <= max(total, 32):
                np.maximum.at(self.rare[t], of(ids[t]), weights[t].astype(np.float32))
            else:
                frequent[ids[t]] += weights[t]
        self.frequent = np.zeros(groups, np.float32)
        np.maximum.at(self.frequent, of(np.arange(n)), frequent.astype(np.float32))
        cut = [len(k[1]) - max(1, len(k[1]) // 3) for k in kept]
        self.parts = [(_grams(k[1][:c]) if c else set(), _grams(k[1][c:])) for k, c in zip(kept, cut, strict=True)]

    def retrieve(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """All items whose score for these distinct terms reaches the threshold."""
        return next(self.retrieve_all([terms], threshold))

    def retrieve_all(self, passages: list[np.ndarray], threshold: float) -> Iterator[list[tuple[int, float]]]:
        """For each passage (its distinct terms) all items whose score reaches the threshold; many are taken up together."""
        many = max(1, CELLS // max(1, self.n))
        for at in range(0, len(passages), many):
            yield from self._retrieved(passages[at : at + many], threshold)

    def _retrieved(self, passages: list[np.ndarray], threshold: float) -> list[list[tuple[int, float]]]:
        p = np.repeat(np.arange(len(passages)), [len(x) for x in passages])
        terms = np.concatenate(passages)
        order = np.lexsort((self.most[terms], p))
        p, terms = p[order], terms[order]
        # The sum of the largest weights up to each term of its passage: from the pivot on it reaches the threshold.
        sums = np.cumsum(self.most[terms])
        first = np.searchsorted(p, np.arange(len(passages)))
        before = np.concatenate(([0.0], sums))[first]
        late = sums - before[p] >= threshold - 1e-9
        score = _summed(self.postings, terms[late], self.n, p[late], len(passages))
        found = np.flatnonzero(score)
        blocks = _summed(self.block_most, terms[~late], self.blocks, p[~late], len(passages))
        found = found[score[found] + blocks[found // self.n * self.blocks + found % self.n // BLOCK] >= threshold - 1e-9]
        out: list[list[tuple[int, float]]] = [[] for _ in passages]
        if len(found):
            left = np.isin(p, np.unique(found // self.n)) & ~late
            score += _summed(self.postings, terms[left], self.n, p[left], len(passages))
            for x in found[score[found] >= threshold - 1e-9].tolist():
                out[x // self.n].append((x % self.n, float(score[x])))
        return out

    def overlap(self, item: int, passage: set) -> bool:
        return all(len(part & passage) >= OVERLAP * len(part) for part in self.parts[item])


def _summed(lists: tuple[np.ndarray, np.ndarray, np.ndarray], terms: np.ndarray, n: int, of: np.ndarray | None = None, many: int = 1) -> np.ndarray:
    """The sums over the terms' lists (starts, places, values), by place, or by passage (of each term; so many) and place."""
    starts, places, values = lists
    first, length = starts[terms], starts[terms + 1] - starts[terms]
    if not length.sum():
        return np.zeros(n * many)
    at = np.repeat(first - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
    return np.bincount(places[at] if of is None else np.repeat(of * n, length) + places[at], values[at], minlength=n * many)


def _grams(numbers: list[int]) -> set:
    n = min(GRAM, len(numbers))
    return {tuple(numbers[i : i + n]) for i in range(len(numbers) - n + 1)}


def _passage_grams(numbers: list[int]) -> set:
    return {tuple(numbers[i : i + n]) for n in range(1, GRAM + 1) for i in range(len(numbers) - n + 1)}


def _searched(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    index: BenchmarkIndex = shared.value
    vocabulary = Vocabulary(index.known)
    for batch in (b.slice(at, words.SLICE) for b in batches for at in range(0, b.num_rows, words.SLICE)):
        all_found, all_best, all_n = [], [], []
        for text in words.column_bytes(batch, "text"):
            ws = words.split(text)
            v = np.fromiter(map(vocabulary.__getitem__, ws), np.int64, len(ws))
            v = v[v != BLANK]
            found, best, n = set(), 0.0, 0
            for stride in index.strides if len(v) else ():
                starts = np.arange(0, max(len(v) - stride, 1), stride)
                n += len(starts)
                halves = np.add.reduceat(index.rare[v], np.arange(0, len(v), stride), axis=0)
                bound = halves[: len(starts)] + index.frequent
                bound[: len(halves) - 1] += halves[1 : len(starts) + 1]
                told = [v[s : s + 2 * stride] for s in starts[(bound >= THRESHOLD - 1e-4).any(axis=1)].tolist()]
                terms = [np.unique(x) for x in told]
                terms = [t[np.searchsorted(t, 0) :] for t in terms]
                for passage, items in zip(told, index.retrieve_all(terms, THRESHOLD), strict=True):
                    for item, score in items:
                        if index.stride[item] == stride and index.overlap(item, _passage_grams(passage.tolist())):
                            found.add(index.ids[item])
                            best = max(best, score)
            all_found.append(sorted(found))
            all_best.append(best)
            all_n.append(n)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(all_n, pa.int64()), pa.array(all_found, pa.list_(pa.int64())), pa.array(all_best, pa.float64())],
            names=["doc_id", "row", "n_passages", "item_ids", "best"],
        )


def find_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, row (hash of the text), n_passages, item_ids (verified items, ascending) and best (score) per row of docs."""
    spark = docs.sparkSession
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("row"), F.col(text_col).cast("string").alias("text")
    )
    schema = "doc_id long, row long, n_passages long, item_ids array<long>, best double"
    parts = list(_indexes(spark, items, item_id, item_text))
    if len(parts) == 1:
        return base.mapInArrow(lambda rows, shared=parts[0]: _searched(rows, shared), schema)
    # Each pass takes the rows of the one before with what was found, so rows need no names to meet again.
    found = base.select("*", F.lit(0).cast("long").alias("n_passages"), F.array().cast("array<long>").alias("item_ids"), F.lit(0.0).alias("best"))
    for shared in parts:
        found = common.materialize(found.mapInArrow(lambda rows, shared=shared: _added(rows, shared), f"{schema}, text string"), "searched")
    return found.drop("text")


def _added(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, row, text, n_passages, item_ids, best) with what another part of the items adds."""
    names = ["doc_id", "row", "n_passages", "item_ids", "best", "text"]
    for batch in (b.slice(at, words.SLICE) for b in batches for at in range(0, b.num_rows, words.SLICE)):
        before = {c: batch.column(batch.schema.get_field_index(c)) for c in names}
        own = pa.RecordBatch.from_arrays([before[c] for c in ("doc_id", "row", "text")], names=["doc_id", "row", "text"])
        n, ids, best = next(_searched(iter([own]), shared)).columns[2:]
        told = [
            [max(a, b) for a, b in zip(before["n_passages"].to_pylist(), n.to_pylist(), strict=True)], [sorted({*a, *b}) for a, b in zip(before["item_ids"].to_pylist(), ids.to_pylist(), strict=True)],
            [max(a, b) for a, b in zip(before["best"].to_pylist(), best.to_pylist(), strict=True)],
        ]
        columns = [before["doc_id"], before["row"], *[pa.array(c, t) for c, t in zip(told, (pa.int64(), pa.list_(pa.int64()), pa.float64()), strict=True)], before["text"]]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item's part, number of words (in its first row) and words, each once."""
    for batch in batches:
        for part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = item_words(text)
            once = sorted(set(found))
            if once:
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(once), pa.int64()), pa.array([len(found)] + [None] * (len(once) - 1), pa.int64()), pa.array(once, pa.binary())], names=["part", "length", "word"])


def _indexes(spark: SparkSession, items: DataFrame, item_id: str, item_text: str) -> Iterator:
    """Broadcast indexes of at most about ITEMS items each. Of several, each knows what is counted over all of them."""
    tests = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).filter("i is not null")
    parts = max(1, -(-tests.count() // ITEMS))
    if parts == 1:
        yield spark.sparkContext.broadcast(BenchmarkIndex([(r[0], r[1]) for r in tests.collect()]))
        return
    tests = tests.withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(parts)))
    told = common.materialize(tests.select("part", "t").mapInArrow(_told, "part long, length long, word binary"), "items")
    lengths = told.filter("length is not null").groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each length
    n, (size, span) = sum(r.n for r in lengths), sizes(np.array([r.length for r in lengths]))
    longest = {int(x): int(size[span == x].max()) for x in np.unique(span)}
    mean = sum(r.n * r.length for r in lengths) / n if n else 1.0
    counts = common.materialize(told.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "counts")
    for part in range(parts):
        own = counts.join(told.filter(F.col("part") == part).select("word").distinct(), "word").collect()
        of_all = Statistics(n, mean, longest, {bytes(r.word): r.n for r in own})
        yield spark.sparkContext.broadcast(BenchmarkIndex([(r.i, r.t) for r in tests.filter(F.col("part") == part).collect()], of_all))
    common.discard(told, counts)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, in whose text no item is found."""
    at = docs.columns.index(text_col)
    for shared in _indexes(docs.sparkSession, items, item_id, item_text):

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(i, words.SLICE) for b in batches for i in range(0, b.num_rows, words.SLICE)):
                number = pa.array(np.arange(batch.num_rows))
                texts = pa.RecordBatch.from_arrays([number, number, batch.column(at)], names=["doc_id", "row", "text"])
                found = next(_searched(iter([texts]), shared)).column(3)
                yield batch.filter(pa.array([not x for x in found.to_pylist()], pa.bool_()))

        docs = common.filtered(docs, clean)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "n_passages", "best")
