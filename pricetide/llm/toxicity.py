"""Toxicity by a counterfactual-regularised logistic regression.

Features say which words, and which word beginnings, occur in the whole text. The model is trained on a bounded sample of
labelled documents, ``PER_CLASS`` of each label. Training documents that mention an identity group also get a counterfactual
twin, in which each such term is replaced by the next one of its list; the loss charges the squared difference of the two
scores, so that a mention of one group rather than another moves no score, and a neutral mention does not count as toxic.

Features that too few sampled documents have, or that tell the labels apart no better than chance, are left out before
training, as they would only repeat the sample.

Defined results: null or empty text scores as the features' absence does; without labelled documents of both kinds the
score is 0; several labels of one document count as toxic if one does; rows without id are scored but never learned from;
repeated rows get a result each; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricetide.llm import arrays
from pricetide.llm.labelled import held_out, sample
from pricetide.sources.lineage import cut

BUCKETS = 1 << 18
PREFIX_BYTES = 5
PER_CLASS = 6000
LEAST_DOCUMENTS = 4
LEAST_Z = 4.0
STEPS = 400
RATE = 0.5
L2 = 2e-4
COUNTERFACTUAL = 0.5

#: identity terms by list; a counterfactual takes the next term of the same list; fixed values
IDENTITY_TERMS = [
    ["women", "men"], ["woman", "man"], ["girls", "boys"], ["she", "he"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"], ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["black", "white", "asian", "latino", "arab"], ["gay", "straight", "lesbian", "bisexual", "queer"],
    ["immigrants", "natives", "refugees"], ["disabled", "deaf", "blind"], ["frauen", "männer"], ["mujeres", "hombres"], ["femmes", "hommes"],
]
WORDS = re.compile(r"(\w+)")
SWAPS = {term: terms[(i + 1) % len(terms)] for terms in IDENTITY_TERMS for i, term in enumerate(terms)}


def _feature_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of each word and of its beginning, and where each text's words start."""
    w = arrays.words(pa.array([(t or "").lower() for t in texts], pa.large_string()), arrays.NOT_ALNUM)
    heads = arrays.byte_hashes(w.data, w.starts, np.minimum(w.ends, w.starts + PREFIX_BYTES))
    half = np.uint64(BUCKETS // 2 - 1)
    return (w.hashes & half).astype(np.int64), (heads & half).astype(np.int64) + BUCKETS // 2, w.of


def features(texts: list[str | None]) -> list[np.ndarray]:
    """Different feature buckets of each text."""
    words, heads, of = _feature_hashes(texts)
    return [np.unique(np.concatenate([words[a:b], heads[a:b]])) for a, b in zip(of[:-1], of[1:])]


def counterfactual(text: str | None) -> str | None:
    """The text with its identity terms swapped; none if it has none."""
    words = WORDS.split((text or "").lower())
    parts = [SWAPS.get(x, x) for x in words]
    return None if parts == words else "".join(parts)


def labelled_features(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """Features of the sampled documents and of their twins."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(
        ~held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = F.broadcast(sample(known, "toxic", per_class, "toxicity"))  # two times per_class rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            twins = [counterfactual(t) for t in texts]
            listed = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("toxic"), pa.array([f.astype(np.int32) for f in features(texts)], listed),
                pa.array([None if t is None else f.astype(np.int32) for t, f in zip(twins, features(twins))], listed),
            ], ["doc_id", "toxic", "own", "twin"])

    # one text of those that share an id, so that there are no more rows than were chosen
    nth = F.row_number().over(W.partitionBy("doc_id").orderBy("__text"))
    joined = docs.join(chosen, "doc_id").select("doc_id", "text", "toxic", F.xxhash64("text").alias("__text")).withColumn(
        "__nth", nth).filter("__nth = 1").select("doc_id", "text", "toxic")
    return cut(joined.mapInArrow(run, "doc_id bigint, toxic int, own array<int>, twin array<int>"))


def selected(rows: DataFrame) -> tuple[np.ndarray, pa.Table]:
    """Features worth a weight, and the sampled rows with these features only.

    A feature is kept if enough documents have it and its share differs between the labels beyond chance, or if it is what a
    swap of identity terms changes. Features are counted in Spark, so the driver gets the kept ones and a few numbers a row.
    """
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    kept = np.empty(0, np.int64)
    if pos and neg:
        counts = rows.select("toxic", F.explode("own").alias("feature")).groupBy("feature").agg(
            F.sum("toxic").alias("p"), F.count("*").alias("n"))
        rate = F.col("n") / (pos + neg)
        z = (F.col("p") / pos - (F.col("n") - F.col("p")) / neg) / F.sqrt(F.greatest(rate * (1 - rate), F.lit(1e-12)) * (1 / pos + 1 / neg))
        swapped = rows.filter("twin is not null").select(
            F.explode(F.concat(F.array_except("own", "twin"), F.array_except("twin", "own"))).alias("feature"))
        told = counts.filter((F.col("n") >= LEAST_DOCUMENTS) & (F.abs(z) >= LEAST_Z)).select("feature")
        kept = np.sort(told.union(swapped).distinct().toArrow().column("feature").to_numpy().astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            few = [pa.array([None if not x.is_valid else np.intersect1d(x.values.to_numpy(), kept).astype(np.int32) for x in batch.column(c)],
                            pa.list_(pa.int32())) for c in ("own", "twin")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), *few], batch.schema.names)

    return kept, rows.mapInArrow(run, rows.schema).toArrow().sort_by("doc_id")


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All features of a list column, and how many each row has; no copy is made of them."""
    listed = column.combine_chunks()
    offsets = listed.offsets.to_numpy()
    return listed.values.to_numpy()[offsets[0] : offsets[-1]], np.diff(offsets)


def fit(kept: np.ndarray, table: pa.Table) -> tuple[np.ndarray, float]:
    """Weights of the kept features, and the bias."""
    y = np.array(table.column("toxic").to_pylist(), np.float64)
    pos, neg = y.sum(), len(y) - y.sum()
    if not pos or not neg:
        return np.empty(0), 0.0
    own, sizes = _flat(table.column("own"))
    of_twin = np.flatnonzero(np.array(table.column("twin").is_valid()))
    twin, twin_sizes = _flat(table.column("twin").take(of_twin))
    place = np.full(BUCKETS, -1, np.int32)
    place[kept] = np.arange(len(kept))

    def rows(flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and kept feature of each entry that is kept."""
        at = place[flat]
        return np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)[at >= 0], at[at >= 0]

    r, c = rows(own, sizes)
    tr, tc = rows(twin, twin_sizes)
    twins = len(of_twin)
    w, b, size = np.zeros(len(kept)), np.log(pos / neg), np.zeros(len(kept) + 1)
    weight = np.where(y == 1, 0.5 / pos, 0.5 / neg)
    for _ in range(STEPS):
        score = b + np.bincount(r, w[c], len(y))
        error = (1 / (1 + np.exp(-score)) - y) * weight
        g = np.bincount(c, error[r], len(kept)) + L2 * w
        if twins:
            gap = (score[of_twin] - b - np.bincount(tr, w[tc], twins)) * 2 * COUNTERFACTUAL / twins
            whole = np.zeros(len(y))
            np.add.at(whole, of_twin, gap)
            g += np.bincount(c, whole[r], len(kept)) - np.bincount(tc, gap[tr], len(kept))
        step = np.append(g, error.sum())
        size += step * step
        move = RATE * step / np.sqrt(size + 1e-12)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def scored(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """All columns of the documents, and ``__toxicity`` for each row."""
    rows = labelled_features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, per_class)
    kept, table = selected(rows)
    w, b = fit(kept, table)
    weights_of = np.zeros(BUCKETS, np.float32)
    weights_of[kept[: len(w)]] = w
    shared = docs.sparkSession.sparkContext.broadcast(weights_of)  # one number per bucket

    learned = len(w) > 0

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = shared.value
        for texts in batches:
            out = []
            for i in range(0, len(texts), 1000):
                words, heads, of = _feature_hashes(texts.iloc[i : i + 1000].tolist())
                every = np.stack([words, heads], axis=1).ravel()
                at = np.flatnonzero(weights[every])
                doc = np.searchsorted(of, at // 2, "right") - 1
                pairs = np.unique(doc * BUCKETS + every[at])
                total = np.bincount(pairs // BUCKETS, weights[pairs % BUCKETS], len(of) - 1)
                out.append(1 / (1 + np.exp(-(b + total))) if learned else total)
            yield pd.Series(np.concatenate(out) if out else np.empty(0))

    return docs.withColumn("__toxicity", score("text"))


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scored(docs, labels, per_class).select(
        "doc_id", held_out().alias("held_out"), F.col("__toxicity").alias("score"), (F.col("__toxicity") >= 0.5).cast("int").alias("predicted"))
