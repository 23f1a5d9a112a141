"""Quality by positive-unlabelled learning: non-negative unbiased risk over trusted positives and unlabelled text.

Documents are described by FEATURES shape statistics (shares of letters, capitals, marks, short words, repeated
words and lines and the like) and their squares. A bounded sample of trusted positives and of unlabelled documents
is fitted by a logistic model on the driver (SAMPLE rows each at most); the class prior is estimated from the
unlabelled sample. Scoring covers every whole text on the cluster.

The prior is estimated from the scores of a positive-against-unlabelled model (label frequency c on the trusted
positives, share of unlabelled mass E[s]/c, kept within [0.05, 0.98]); then the risk
pi E_p[l(g, +1)] + max(0, E_u[l(g, -1)] - pi E_p[l(g, -1)]) is minimised by full-batch Adam steps; when the
bracket is negative its gradient is reversed, as the published algorithm has it.

Defined results: null and empty texts have all features 0; without a trusted positive every score is 0.5; labels of
missing ids are not used; repeated rows count as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import common, words
from marketloom.llm.toxicity import fold

SAMPLE = 20_000
STEPS = 600
THRESHOLD = 0.3
FEATURES = (
    "log_words", "letters", "capitals", "digits", "marks", "doubled_marks", "word_length", "long_words", "short_words", "distinct",
    "most_common", "repeated_pairs", "repeated_halves", "lines_per_word", "repeated_lines", "bars", "ending_marks", "capital_words",
    "mark_words", "sentence_length", "non_ascii", "doubled_words",
)

_MARK_RUN = re.compile(rb"[!-/:-@\[-`{-~]{2,}")
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_UPPERS, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))


def features(text: bytes | None) -> list[float]:
    """The statistics of one text, each about 0 to 1."""
    text = text or b""
    ws = text.split()
    n, size = len(ws), len(text) - text.count(b" ") - text.count(b"\n")
    if not n:
        return [0.0] * len(FEATURES)
    without = lambda chars: size - (len(text.translate(None, chars)) - text.count(b" ") - text.count(b"\n"))
    marks, capitals, digits = without(_MARKS), without(_UPPERS), without(_DIGITS)
    counts: dict[bytes, int] = {}
    for w in ws:
        counts[w] = counts.get(w, 0) + 1
    pairs = list(zip(ws, ws[1:]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    tails = sum(1 for w in ws if w[-1:] in b"!$%&*#|~^")
    runs = sum(len(x) for x in _MARK_RUN.findall(text))
    half = n // 2
    return [
        np.log1p(n) / 10, 1 - (marks + digits) / size, capitals / size, digits / size, marks / size, runs / size, size / n / 20,
        sum(1 for w in ws if len(w) > 12) / n, sum(1 for w in ws if len(w) <= 2) / n, len(counts) / n, max(counts.values()) / n,
        1 - len(set(pairs)) / len(pairs) if pairs else 0.0, sum(a == b for a, b in zip(ws[:half], ws[half:])) / half if half else 0.0,
        min(1.0, 10 * len(lines) / n), 1 - len(set(lines)) / len(lines), ws.count(b"|") / n, tails / n, sum(1 for w in ws if w.isupper() and len(w) > 1) / n,
        sum(1 for w in ws if not w.strip(_MARKS)) / n, min(1.0, n / (1 + text.count(b". ")) / 100), sum(1 for c in (text,) if not c.isascii()) * 0.1,
        sum(a == b for a, b in pairs) / len(pairs) if pairs else 0.0,
    ]


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(at, words.SLICE) for b in batches for at in range(0, b.num_rows, words.SLICE)):
        rows = [features(t) for t in words.column_bytes(batch, "text")]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])


def _design(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -6, 6)
    return np.concatenate((z, z * z / 6, np.ones((len(x), 1))), axis=1)


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -40, 40)))


def _adam(gradient, width: int, steps: int = STEPS, rate: float = 0.05) -> np.ndarray:
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, steps + 1):
        g = gradient(w) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The share of positives in the unlabelled rows: where density ratios to the positives are least, all mass is theirs.

    A balanced positive-against-unlabelled model gives s; s/(1-s) estimates p(x)/u(x). Its high quantile over the
    unlabelled rows is 1/prior."""
    x = np.concatenate((p, u))
    y = np.concatenate((np.ones(len(p)), np.zeros(len(u))))
    weight = np.concatenate((np.full(len(p), 0.5 / len(p)), np.full(len(u), 0.5 / len(u))))
    w = _adam(lambda w: x.T @ (weight * (_sigmoid(x @ w) - y)), x.shape[1])
    ratio = np.exp(np.clip(u @ w, -8, 8))
    return float(np.clip(1 / max(np.median(ratio[ratio >= 1.0]) if (ratio >= 1.0).any() else 1.0, 1e-6), 0.05, 0.98))


def fit_nnpu(p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """Weights of the least non-negative unbiased risk with the logistic loss."""

    def gradient(w: np.ndarray) -> np.ndarray:
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        positive = -prior * p.T @ (1 - sp) / len(p)
        negative = u.T @ su / len(u) - prior * p.T @ sp / len(p)
        risk = -np.log(np.maximum(1 - su, 1e-12)).mean() + prior * np.log(np.maximum(1 - sp, 1e-12)).mean()
        return positive + negative if risk >= 0 else -negative

    return _adam(gradient, p.shape[1])


class Model:
    def __init__(self, p: np.ndarray, u: np.ndarray) -> None:
        self.weights = None
        if len(p) and len(u):
            both = np.concatenate((p, u))
            self.mean, self.scale = both.mean(axis=0), both.std(axis=0) + 1e-6
            p, u = _design(p, self.mean, self.scale), _design(u, self.mean, self.scale)
            self.prior = estimate_prior(p, u)
            self.weights = fit_nnpu(p, u, self.prior)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return _sigmoid(_design(x, self.mean, self.scale) @ self.weights)


def fit(docs: DataFrame, positives: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """positives: ids of trusted documents. The rows used are those with the smallest hashes of their ids."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ids = positives.select(F.col(id_col).cast("long").alias("doc_id")).dropna()
    trusted = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    drawn = texts.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit("u")), "doc_id").limit(SAMPLE)
    both = trusted.withColumn("kind", F.lit(1)).unionByName(drawn.withColumn("kind", F.lit(0)))
    both = common.materialize(both, "drawn")  # at most 2 * SAMPLE ids
    chosen = texts.join(F.broadcast(both.select("doc_id").distinct()), "doc_id", "left_semi")
    x = {}
    for i, v in chosen.mapInArrow(_described, "doc_id long, x array<double>").collect():
        x[i] = v
    rows = both.collect()
    pick = lambda kind: np.array([x[r[0]] for r in rows if r[1] == kind and r[0] in x], float).reshape(-1, len(FEATURES))
    return Model(pick(1), pick(0))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _described(batches):
            x = np.array(batch.column(1).to_pylist(), float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(x))], names=["doc_id", "score"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(scored, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    labels = common.table(spark, sf_dir, "labels").filter((fold("doc_id", 5) != 0) & (F.col("quality") == 1))
    scored = score(docs, fit(docs, labels))
    return scored.select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
