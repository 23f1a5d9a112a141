"""Substring deduplication by sliding sentence spans.

A sentence ends at . ! or ? with white space after it, or at line ends. Every run of SPAN consecutive sentences with at
least LEAST_WORDS words, and every single sentence of at least LONG words, is hashed (words of A-Z lower-cased, 64 bits); the first occurrence of each hash, by
document and position, is found by an aggregation with partial sums in the tasks, and joined with the spans.
Sentences covered by any later occurrence are removed; the rest of the text stays as it was. Only whole sentences go: a
repeated passage that holds neither SPAN whole sentences nor a whole one of LONG words stays, however long it is.

Defined results: null and empty texts have no sentences; a text with fewer than SPAN sentences is one span if it
has enough words; a null id counts as larger than all others; rows that repeat id and text are one document and
both keep what the first keeps; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import common, words

SPAN = 2
LEAST_WORDS = 10
#: A sentence of so many words is a span by itself.
LONG = 25
_END = re.compile(rb"[.!?]+[\x20\x09-\x0D]+|\n+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def sentences(text: bytes | None) -> list[bytes]:
    """The text in pieces, each with the white space after it; joined, they are the text."""
    if not text:
        return []
    ends = [m.end() for m in _END.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def spans(text: bytes | None) -> tuple[np.ndarray, np.ndarray, int]:
    """(place, hash) of each span, and the number of sentences; the place is twice the first sentence, and one more
    if the span is that sentence alone."""
    parts = [words.split(s) for s in sentences(text)]
    n = np.array([len(p) for p in parts], np.int64)
    h = np.array([xxhash.xxh64_intdigest(b" ".join(p)) for p in parts], np.uint64)
    k = min(SPAN, len(parts))
    if not k:
        return n, h, 0
    alone = np.flatnonzero(n >= (LONG if k == SPAN else LEAST_WORDS))
    if k < SPAN:
        return 2 * alone + 1, words.mix(h[alone]), len(parts)
    count, total = n[: len(n) - k + 1].copy(), h[: len(h) - k + 1].copy()
    for i in range(1, k):
        count += n[i : len(n) - k + 1 + i]
        total = total * _STEP + h[i : len(h) - k + 1 + i]
    at = np.flatnonzero(count >= LEAST_WORDS)
    return np.concatenate((2 * at, 2 * alone + 1)), words.mix(np.concatenate((total[at], h[alone]))), len(parts)


def _spanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(at, words.SLICE) for b in batches for at in range(0, b.num_rows, words.SLICE)):
        ids, rows = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        all_at, all_h, length = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], []
        for text in words.column_bytes(batch, "text"):
            at, h, _ = spans(text)
            all_at.append(at)
            all_h.append(h)
            length.append(len(at))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(all_h).view(np.int64)), pa.array(np.repeat(ids, length)), pa.array(np.repeat(rows, length)), pa.array(np.concatenate(all_at).astype(np.int32))],
            names=["h", "id", "row", "pos"],
        )


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(at, words.SLICE) for b in batches for at in range(0, b.num_rows, words.SLICE)):
        n, gone, texts = [], [], []
        removed = batch.column(batch.schema.get_field_index("starts")).to_pylist()
        for text, starts in zip(words.column_bytes(batch, "text"), removed, strict=True):
            parts = sentences(text)
            drop = {i for s in starts or () for i in range(s // 2, s // 2 + (1 if s % 2 else SPAN))}
            n.append(len(parts))
            gone.append(len(drop))
            texts.append(text if not drop else b"".join(p for i, p in enumerate(parts) if i not in drop))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_sentences", "n_removed", "text"],
        )


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_sentences, n_removed and the kept text for every row of docs."""
    text = F.col(text_col).cast("string")
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(common.NO_ID)).alias("id"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("row"), text.alias("text"),
    )
    found = common.materialize(base.select("id", "row", "text").mapInArrow(_spanned, "h long, id long, row long, pos int"), "spans")
    first = found.groupBy("h").agg(F.min(F.struct("id", "row", "pos")).alias("first"), F.max(F.struct("id", "row", "pos")).alias("last"))
    repeated = first.filter("first <> last").select("h", "first")
    later = found.join(repeated, "h").filter(F.struct("id", "row", "pos") != F.col("first"))
    starts = later.groupBy("id", "row").agg(F.collect_set("pos").alias("starts"))
    return base.join(starts.hint("shuffle_hash"), ["id", "row"], "left").select("doc_id", "text", "starts").mapInArrow(
        _kept, "doc_id long, n_sentences long, n_removed long, text string"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_spans(common.table(spark, sf_dir, "documents")).select(
        "doc_id", "n_sentences", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )
