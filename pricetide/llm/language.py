"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Lower-cased letters, with every run of other characters as one space, give hashed n-grams of one to three characters over
the whole text. Document frequencies are counted over all labelled training documents. The model is trained on a bounded
sample of them, ``PER_CLASS`` rows a language, with follow-the-regularised-leader and elastic-net penalties, which leaves
most weights at exactly zero; a part of the sample that training does not see sets the temperature of its probabilities.

Defined results: null text, or text without a letter, is ``und`` with score 0, as is every text if there is nothing to
learn from; ties go to the language first in order; repeated rows get a result each; rows without id are predicted but
never learned from; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm import arrays
from pricetide.llm.labelled import held_out, sample

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
PER_CLASS = 1200
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def ngrams(text: str | None) -> np.ndarray:
    """Hash buckets of the n-grams of a whole text; none without a letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
    letter = letter_table()[codes]
    if not letter.any():
        return np.empty(0, np.int64)
    shown = letter.copy()
    shown[1:] |= letter[:-1]
    codes = np.concatenate([[32], np.where(letter, codes, 32)[shown], [32]]).astype(np.uint32)
    out = []
    for order in ORDERS:
        n = len(codes) - order + 1
        h = np.full(n, order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for i in range(order):
            h = (h ^ codes[i : i + n]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        out.append(h & np.uint32(BUCKETS - 1))
    return np.concatenate(out).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each bucket occurs, summed per task first; the driver gets one number per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                total[:-1] += np.bincount(ngrams(text), minlength=BUCKETS) > 0
                total[-1] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    table = docs.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS + 1, np.int64)
    out[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return out[:-1], int(out[-1])


def weighted(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and unit-length TF-IDF values."""
    counts = np.bincount(ngrams(text), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    values = np.log1p(counts[at]) * idf[at]
    norm = np.sqrt((values * values).sum())
    return at, values / norm if norm else values


class Ftrl:
    """Follow-the-regularised-leader with elastic-net penalties, one weight per class and bucket."""

    def __init__(self, classes: int):
        self.z = np.zeros((classes, BUCKETS))
        self.n = np.zeros((classes, BUCKETS))

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[:, at], self.n[:, at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(w @ values)
        p[label] -= 1
        g = p[:, None] * values
        sigma = (np.sqrt(self.n[:, at] + g * g) - np.sqrt(self.n[:, at])) / ALPHA
        self.z[:, at] += g - sigma * w
        self.n[:, at] += g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def temperature(scores: list[np.ndarray], labels: list[int]) -> float:
    """The scale of scores that makes the labels likeliest, from a fixed grid."""
    if not labels:
        return 1.0
    s, y = np.array(scores), np.array(labels)
    loss = []
    grid = np.geomspace(0.02, 20, 61)
    for t in grid:
        x = s / t
        x -= x.max(axis=1, keepdims=True)
        loss.append((np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(y)), y]).mean())
    return float(grid[int(np.argmin(loss))])


def train(docs: DataFrame, per_class: int = PER_CLASS) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """Languages, weights, idf and temperature learned from the documents that are not held out."""
    known = docs.filter(~held_out() & F.col("lang").isNotNull())
    frequency, total = document_frequencies(known)
    idf = np.log((1 + total) / (1 + frequency)) + 1
    drawn = sample(known.select("doc_id", "lang", "text"), "lang", per_class, "language", ("doc_id", "text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.slices(batches, "text"):
            found = [weighted(t, idf) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("lang"), pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())),
                pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32()))], ["doc_id", "lang", "at", "value"])

    schema = "doc_id bigint, lang string, at array<int>, value array<float>"
    table = drawn.select("doc_id", "lang", "text").mapInArrow(features, schema).withColumn(
        "turn", F.xxhash64("doc_id", F.lit("turn"))).toArrow().sort_by([("turn", "ascending"), ("doc_id", "ascending")])
    languages = sorted(set(table.column("lang").to_pylist()))
    labels = [languages.index(x) for x in table.column("lang").to_pylist()]
    rows = [(np.array(a.values), np.array(v.values, np.float64), y) for a, v, y in zip(table.column("at"), table.column("value"), labels)]
    rows = [r for r in rows if len(r[0])]
    model = Ftrl(len(languages))
    for _ in range(EPOCHS):
        for i, row in enumerate(rows):
            if i % 5:
                model.learn(*row)
    weights = model.weights(slice(None))
    checked = rows[::5]
    return languages, weights, idf, temperature([weights[:, a] @ v for a, v, _ in checked], [y for *_, y in checked])


def identify(docs: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    languages, weights, idf, scale = train(docs, per_class)
    model = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), idf))  # fixed size for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, inverse = model.value
        for batch in arrays.slices(batches, "text"):
            names, scores = [], []
            for text in batch.column("text").to_pylist():
                at, values = weighted(text, inverse)
                p = softmax(w[:, at] @ values / scale) if len(at) and languages else None
                names.append(UNKNOWN if p is None else languages[int(p.argmax())])
                scores.append(0.0 if p is None else float(p.max()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names), pa.array(scores)],
                                             ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
