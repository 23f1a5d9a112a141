"""Fill-in-middle transformation of whole texts by a piece table.

A document is a list of pieces (descriptors: buffer, start, length) over buffers that never change: its UTF-8 text and
the three sentinels. Cutting splits a descriptor in two; an arrangement permutes the three parts and puts sentinel
descriptors between them; the inverse permutation restores the text. No text is copied on the way: hashes are fed the
pieces' bytes one after the other, and an output text is only put together where the caller asks for it. Restoring
starts from the finished output alone: its sentinels are looked up, which cuts it into pieces, and these go back.

Units are runs of A-Z and a-z, and every other code point by itself; two places among the units, drawn from a hash
of the id, end the prefix and the middle. A text that is empty or holds a sentinel stays plain, as does a drawn share.

Defined results: a null text counts as empty; a null id draws like an id without digits; rows that repeat an id draw
alike; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import common, words

TEXT, PREFIX, SUFFIX, MIDDLE = range(4)
#: Sentinels before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Which parts (0 prefix, 1 middle, 2 suffix) follow each other, each behind its own sentinel.
ORDERS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
_MARK = {0: PREFIX, 1: MIDDLE, 2: SUFFIX}


class Piece(NamedTuple):
    buffer: int
    start: int
    length: int


def cut(pieces: list[Piece], at: int) -> list[Piece]:
    """The pieces with a border at this distance from the start: the descriptor that spans it is split, perhaps into
    an empty and a whole one."""
    done, out = 0, []
    for n, piece in enumerate(pieces):
        if done + piece.length >= at:
            left = Piece(piece.buffer, piece.start, at - done)
            return [*out, left, Piece(piece.buffer, piece.start + left.length, piece.length - left.length), *pieces[n + 1 :]]
        out.append(piece)
        done += piece.length
    return out


def arrange(parts: list[Piece], form: str, marks: tuple[int, int, int]) -> list[Piece]:
    """Prefix, middle and suffix in the order of the form, each behind its sentinel. marks: the sentinels' bytes."""
    return [p for part in ORDERS[form] for p in (Piece(_MARK[part], 0, marks[_MARK[part] - 1]), parts[part])]


def restore(output: bytes, form: str, sentinels: tuple[bytes, bytes, bytes]) -> list[Piece]:
    """The pieces of a finished output that give the original text back."""
    if form == "plain":
        return [Piece(TEXT, 0, len(output))]
    at, found = 0, []
    for part in ORDERS[form]:
        mark = sentinels[_MARK[part] - 1]
        begins = output.index(mark, at) + len(mark)
        if found:
            found[-1] = found[-1]._replace(length=begins - len(mark) - found[-1].start)
        found.append(Piece(TEXT, begins, len(output) - begins))
        at = begins
    back = np.argsort(ORDERS[form])  # the inverse permutation
    return [found[i] for i in back]


def stream(pieces: Iterable[Piece], buffers: tuple[bytes, ...]) -> Iterator[memoryview]:
    for piece in pieces:
        yield memoryview(buffers[piece.buffer])[piece.start : piece.start + piece.length]


def digest(pieces: Iterable[Piece], buffers: tuple[bytes, ...]) -> str:
    found = sha256()
    for part in stream(pieces, buffers):
        found.update(part)
    return found.hexdigest()


def unit_starts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The byte at which each unit begins, and a mark for each byte that begins a code point."""
    b = np.frombuffer(text, np.uint8)
    letter = ((b | np.uint8(32)) - np.uint8(97)) < 26
    points = (b & np.uint8(0xC0)) != 0x80
    begins = points.copy()
    begins[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(begins), points


def _rows(batches: Iterator[pa.RecordBatch], seed: str, sentinels: tuple[str, ...], plain: int, spm: int, texts: bool) -> Iterator[pa.RecordBatch]:
    marks = tuple(s.encode() for s in sentinels)
    for batch in (b.slice(at, words.SLICE) for b in batches for at in range(0, b.num_rows, words.SLICE)):
        ids, out = batch.column(0), []
        for doc_id, text in zip(ids.to_pylist(), words.column_bytes(batch, "text"), strict=True):
            text = text or b""
            h = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
            h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
            starts, points = unit_starts(text)
            n, buffers, pieces = len(starts), (text, *marks), [Piece(TEXT, 0, len(text))]
            form, prefix, middle = "plain", None, None
            if text and h3 % 100 < 100 - plain and not any(m in text for m in marks):
                form = "spm" if h4 % 100 < spm else "psm"
                first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
                ends = [int(starts[k]) if k < n else len(text) for k in (first, second)]
                parts = cut(pieces, ends[0])
                parts = [parts[0], *cut(parts[1:], ends[1] - ends[0])]
                prefix, middle = (int(np.count_nonzero(points[p.start : p.start + p.length])) for p in parts[:2])
                pieces = arrange(parts, form, tuple(map(len, marks)))
            made = b"".join(stream(pieces, buffers))
            back = restore(made, form, marks)
            out.append((n, form, prefix, middle, [p._asdict() for p in pieces], digest(pieces, buffers), digest(back, (made,)), made if texts else None))
        columns = list(zip(*out, strict=True))
        piece = pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())])
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(piece), pa.string(), pa.string(), pa.binary()]
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "pieces", "output_sha256", "restored_sha256", "output"]
        yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=names)


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, seed: str = "1", sentinels: tuple[str, str, str] = SENTINELS,
    plain: int = 10, spm: int = 20, texts: bool = True,
) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars and middle_chars (code points; null if plain), pieces (the
    output's piece table: buffer 0 is the text, 1 to 3 the sentinels; start and length in bytes), output_sha256,
    restored_sha256 and output (the text itself; null unless texts). plain, spm: percent of texts that stay plain, and
    of the others that go suffix first. No sentinel may be part of another or begin as another ends."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = (
        "doc_id long, n long, form string, prefix_chars long, middle_chars long, pieces array<struct<buffer int, start long, length long>>, "
        "output_sha256 string, restored_sha256 string, output binary"
    )
    found = rows.mapInArrow(lambda batches: _rows(batches, seed, sentinels, plain, spm, texts), schema)
    return found.withColumn("output", F.col("output").cast("string"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(common.table(spark, sf_dir, "documents"), texts=False)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


ORACLE_SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS l,
         sha256('1:' || doc_id) AS h
  FROM documents
), numbers AS (
  SELECT doc_id, t, l, len(l) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM drawn
), cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), parts AS (
  SELECT *, coalesce(array_to_string(list_slice(l, 1, a), ''), '') AS p,
         CASE WHEN b > a THEN array_to_string(list_slice(l, a + 1, b), '') ELSE '' END AS m,
         CASE WHEN n > b THEN array_to_string(list_slice(l, b + 1, n), '') ELSE '' END AS s
  FROM cuts
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
