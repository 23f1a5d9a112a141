"""Similarity of titles by their sets of words: longest common subsequences, bit-parallel over whole batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from marketloom.functions.folding import let

#: Characters that fit in one machine word, and pairs that are taken up together.
WORD, PAIRS = 64, 2048


def common_length(x: str, y: str) -> int:
    """The length of the longest common subsequence, with one big number for all of x: a bit is cleared where the
    subsequence grows."""
    places: dict[str, int] = {}
    for i, c in enumerate(x):
        places[c] = places.get(c, 0) | 1 << i
    whole = (1 << len(x)) - 1
    row = whole
    for c in y:
        met = row & places.get(c, 0)
        row = ((row + met) | (row - met)) & whole
    return len(x) - row.bit_count()


def common_lengths(pairs: list[tuple[str, str]]) -> np.ndarray:
    """The same for many pairs whose shorter text has WORD characters at most: one step for all pairs and each
    character of the longer texts. Others go one by one."""
    out = np.zeros(len(pairs), np.int64)
    short = []
    for i, (x, y) in enumerate(pairs):
        if min(len(x), len(y)) > WORD:
            out[i] = common_length(x, y)
        elif x and y:
            short.append((i, *sorted((x, y), key=len)))
    short.sort(key=lambda p: len(p[2]))  # pairs of alike length end together
    for start in range(0, len(short), PAIRS):
        at, xs, ys = zip(*short[start : start + PAIRS], strict=True)
        letters = {c: n for n, c in enumerate(sorted(set("".join(xs))), 1)}  # 0: what no x has
        places = np.zeros((len(xs), len(letters) + 1), np.uint64)
        rows = np.arange(len(xs))
        for i in range(max(map(len, xs))):
            use = [n for n, x in enumerate(xs) if i < len(x)]
            places[use, [letters[xs[n][i]] for n in use]] |= np.uint64(1 << i)
        codes = np.zeros((len(ys), max(map(len, ys))), np.int64)
        for n, y in enumerate(ys):
            codes[n, : len(y)] = [letters.get(c, 0) for c in y]
        row = np.full(len(xs), np.uint64(2**64 - 1))
        for c in codes.T:
            met = row & places[rows, c]
            row = (row + met) | (row - met)
        length = np.array([len(x) for x in xs], np.uint64)
        unused = ~np.uint64(0) << (length % np.uint64(64)) if len(length) else length
        unused[length == 64] = 0
        out[list(at)] = 64 - np.bitwise_count(row | unused).astype(np.int64)
    return out


@F.arrow_udf(LongType())
def _common(x: pa.Array, y: pa.Array) -> pa.Array:
    return pa.array(common_lengths([(a or "", b or "") for a, b in zip(x.to_pylist(), y.to_pylist(), strict=True)]), pa.int64())


def words(text: Column) -> Column:
    """A text's words in order, once each."""
    return F.sort_array(F.array_distinct(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), "")))


def token_set_ratio(x: Column, y: Column) -> Column:
    """The similarity of two texts by their words."""
    return word_ratio(words(x), words(y))


def word_ratio(a: Column, b: Column) -> Column:
    """0 to 100 by the words of two texts: the best of three similarities (insertions and deletions against both lengths)
    among the shared words in order, and these with what either text has besides. 100 if one text's words are all in the
    other, 0 if either has none. Spark takes both as often as they are read here: better columns than expressions."""
    ratio = lambda distance, total: F.lit(100.0) - F.lit(100.0) * distance / total
    shared, rest_a, rest_b = (F.array_join(w, " ") for w in (F.array_intersect(a, b), F.array_except(a, b), F.array_except(b, a)))

    def best(v: Column) -> Column:
        s, m, n = v["s"], v["m"], v["n"]
        gap = F.when(s > 0, 1).otherwise(0)
        both = ratio(m + n - 2 * v["common"], 2 * (s + gap) + m + n)
        most = F.when(s > 0, F.greatest(both, ratio(gap + m, 2 * s + gap + m), ratio(gap + n, 2 * s + gap + n))).otherwise(both)
        return F.when(v["none"], 0.0).when((s > 0) & ((m == 0) | (n == 0)), 100.0).otherwise(most)

    none = (F.size(a) == 0) | (F.size(b) == 0)
    return let(F.struct(F.length(shared).alias("s"), F.length(rest_a).alias("m"), F.length(rest_b).alias("n"), _common(rest_a, rest_b).alias("common"), none.alias("none")), best)
