"""Resampling of documents towards a target distribution by importance weights.

1. A text's features are its runs of one to three words, hashed to ``BUCKETS`` buckets by CRC-32. The buckets' totals over all
   documents and over the target texts give each bucket a gain, a smoothed log ratio in thousandths.
2. The gains are an array of fixed size in every task; a document's weight is the sum of the gains of its features.
3. A keyed Gumbel draw is added to the weight, so that the highest scores are a draw without replacement by weight.
4. The cutoff among all scores is found without sorting them: a quantile sketch names a bracket, the rows above and below it
   are counted exactly, and a bracket that does not hold the cutoff is widened. Only the bracket's rows are sorted to find
   the cutoff among them. The drawn rows above the bracket are put in order for their ranks.

Defined results: null text, and text without words, has no features and weight 0; a row without id draws as if its id were
the empty text and stands before others of its score; rows of equal score and id, such as repeated rows, get ranks of their own
in the order of the table; texts of any length are read whole, a slice of a batch holds about 4 MiB or one longer text;
without target texts all gains come from smoothing; an empty table, or one with too few long documents for a single draw,
draws nothing; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.llm import arrays
from pricetide.operators.ordering import numbered
from pricetide.sources.lineage import cut

RUN = 3
BUCKETS = 10_000
PERCENT = 5
LEAST_WORDS = 20
SEED = "42"
#: the sketch's error is one part in so many; the first bracket reaches twice that to either side
ACCURACY = 10_000
#: bytes of a word that are hashed in arrays, the rest one by one
ARRAY_BYTES = 64
ONES = np.uint32(0xFFFFFFFF)


def crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return table


CRC = crc_table()


def run_crcs(w: arrays.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2, 3 words: the CRC-32 of the run that ends with each word, joined by spaces, and whether there is one.

    A longer run goes on from the register of the run without its last word. All words of the slice take a byte at a time,
    the longest first, so that those with a byte left are always in front.
    """
    lengths = w.ends - w.starts
    order = np.argsort(-lengths, kind="stable")
    at, left = w.starts[order], lengths[order]
    active = np.searchsorted(-left, -np.arange(min(ARRAY_BYTES, left[0] if len(left) else 0)), "left")
    place = np.arange(len(lengths)) - np.repeat(w.of[:-1], np.diff(w.of))
    register = np.full(len(lengths), ONES, np.uint32)
    for run in range(RUN):
        if run:
            register = np.r_[ONES, register[:-1]][: len(lengths)]
            register = CRC[(register ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (register >> np.uint32(8))
        sorted_register = register[order]
        for k, n in enumerate(active.tolist()):
            r = sorted_register[:n]
            sorted_register[:n] = CRC[(r ^ w.data[at[:n] + k]) & np.uint32(0xFF)] ^ (r >> np.uint32(8))
        for i in range(int(np.searchsorted(-left, -ARRAY_BYTES, "left"))):
            rest = w.data[at[i] + ARRAY_BYTES : at[i] + left[i]].tobytes()
            sorted_register[i] = zlib.crc32(rest, int(sorted_register[i] ^ ONES)) ^ 0xFFFFFFFF
        register = np.empty_like(sorted_register)
        register[order] = sorted_register
        yield register ^ ONES, place >= run


def _words(texts: pa.Array) -> arrays.Words:
    return arrays.words(texts, arrays.NOT_ALNUM, lower=True)


def bucket_totals(texts: DataFrame) -> np.ndarray:
    """How many features of all texts fall into each bucket; at most ``BUCKETS`` numbers of a task are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(BUCKETS, np.int64)
        for batch in arrays.slices(batches, "text"):
            for crc, there in run_crcs(_words(batch.column("text"))):
                totals += np.bincount(crc[there] % np.uint32(BUCKETS), minlength=BUCKETS)
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(totals[used], pa.int64())], ["bucket", "n"])

    table = texts.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    totals = np.zeros(BUCKETS, np.int64)
    totals[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return totals


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a weight."""
    s, t = source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in arrays.slices(batches, "text"):
            w = _words(batch.column("text"))
            sums = np.zeros(len(w.starts) + 1, np.int64)
            for crc, there in run_crcs(w):
                sums[1:] += np.where(there, gain[crc % np.uint32(BUCKETS)], 0)
            sums, n = np.cumsum(sums), np.diff(w.of)
            features = sum(np.maximum(n - k, 0) for k in range(RUN))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in (n, features, sums[w.of[1:]] - sums[w.of[:-1]])]],
                ["doc_id", "n_words", "n_features", "weight"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return chosen.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def gumbel(doc_id: Column) -> Column:
    """A draw in thousandths that follows from the seed and the id."""
    key = F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def bracket(scores: DataFrame, wanted: int, total: int, accuracy: int = ACCURACY) -> tuple[int, int, int]:
    """Scores ``low <= high`` that hold the ``wanted``-th highest between them, and how many rows score above ``high``."""
    reach, share = 2 / accuracy, 1 - wanted / total
    while True:
        ends = [max(0.0, share - reach), min(1.0, share + reach)]
        low, high = scores.agg(F.percentile_approx("score", ends, accuracy).alias("q")).first()["q"]
        if ends[0] == 0 or ends[1] == 1:  # the sketch's own ends may miss the true ones
            least, most = scores.agg(F.min("score"), F.max("score")).first()
            low, high = least if ends[0] == 0 else low, most if ends[1] == 1 else high
        above, below = scores.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score") < low)).first()
        if above < wanted <= total - below:
            return low, high, above
        reach *= 4


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, accuracy: int = ACCURACY) -> DataFrame:
    """Every document with its weight and score; those drawn, ``percent`` of the ones with ``least_words`` words, have a rank."""
    gain = gains(bucket_totals(docs), bucket_totals(target))
    scored = cut(weights(docs, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"))))
    scored = scored.withColumn("__row", F.monotonically_increasing_id())
    long_enough = F.col("n_words") >= least_words
    total = scored.filter(long_enough).count()
    wanted = percent * total // 100
    out = ["doc_id", "n_words", "n_features", "weight", "score"]
    if not wanted:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    low, high, above = bracket(scored.filter(long_enough), wanted, total, accuracy)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("__row").asc()]
    top = numbered(scored.filter(long_enough & (F.col("score") > high)), order, "rank")
    middle = numbered(scored.filter(long_enough & F.col("score").between(low, high)), order, "place")
    middle = middle.withColumn("rank", F.when(F.col("place") <= wanted - above, F.col("place") + above))
    rest = scored.filter(~long_enough | (F.col("score") < low)).withColumn("rank", F.lit(None).cast("long"))
    return rest.select(*out, "rank").union(top.select(*out, "rank")).union(middle.select(*out, "rank"))
