"""Quality rules with a hashed n-gram likelihood ratio, in DataFrame expressions only.

Two multinomials over hashed word n-grams are counted over all documents: the raw corpus, and the trusted part of it. A
document's score is the mean over its n-grams of the log ratio of the two, so length does not matter, and every document
is held against one fixed threshold: the trusted documents' mean score less a few of their standard deviations. By
default a document is trusted if it meets strict surface rules, so no join moves texts.

The ratio table has one row per hash bucket, 16,384 whatever the input, and is broadcast. A document's
n-grams are spread to rows and summed inside the task that read it before anything is shuffled.

Defined results: null or empty text has no words, fails the base rules and scores 0; repeated rows and rows with a null
id get a result each; without a trusted document the ratio is 0 everywhere and only base rules decide; other columns of
the input are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.llm.rows import KEY, keyed
from pricetide.sources.lineage import cut

BUCKETS = 16384
ORDERS = (1, 2)
DEVIATIONS = 4.0
SPACE = r"[\x20\x09-\x0D]+"
#: strict rules of a trusted document
TRUST = "n_words >= 50 and n_symbols * 50 <= n_words and n_dup_lines = 0 and n_upper * 5 <= n_chars and n_different * 5 >= n_words"


def with_words(docs: DataFrame) -> DataFrame:
    return keyed(docs).select("doc_id", *KEY, "text", F.array_remove(F.split("text", SPACE), "").alias("words"))


def _removed(pattern: str) -> Column:
    return (F.length("text") - F.length(F.regexp_replace("text", pattern, ""))).cast("long")


def with_surface(words: DataFrame) -> DataFrame:
    """Counts that need no windows, and whether they meet the rules of a trusted document."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    repeated = F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0]
    return words.withColumns({
        "n_words": F.size("words").cast("long"), "n_symbols": _removed(r"[#*$%&|<>]+"), "n_dup_lines": repeated.cast("long"),
        "n_upper": _removed(r"\p{Lu}+"), "n_different": F.size(F.array_distinct("words")), "n_chars": F.length("text"),
    }).withColumn("trusted", F.expr(TRUST))


def measures(surface: DataFrame) -> DataFrame:
    """All counts of each whole text.

    A 3-word window becomes one number, its hash above and its place below, so that sorting numbers brings equal windows
    together and keeps their places; as many low bits are given to places as the text needs. Each repeated window adds the
    words that the previous one does not cover.
    """
    sized = surface.withColumn("n", F.size("words")).withColumn("bits", F.ceil(F.log2(F.col("n") + 2)).cast("int"))
    packed = sized.withColumn("packed", F.expr(
        "case when n >= 3 then sort_array(transform(sequence(0, n - 3), i -> "
        "shiftleft(xxhash64(words[i], words[i + 1], words[i + 2]), bits) | cast(i as bigint))) else array() end"))
    places = packed.withColumn("places", F.expr(
        "sort_array(transform(filter(packed, (x, j) -> "
        "(j > 0 and shiftright(packed[j - 1], bits) = shiftright(x, bits)) or "
        "(j < n - 3 and shiftright(packed[j + 1], bits) = shiftright(x, bits))), x -> x & (shiftleft(1L, bits) - 1)))"))
    repeats = F.expr("aggregate(places, named_struct('last', -3L, 'total', 0L), "
                     "(a, p) -> named_struct('last', p, 'total', a.total + least(3L, p - a.last)), a -> a.total)")
    return places.select(
        "doc_id", *KEY, "n_words", F.length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols", "n_dup_lines",
        repeats.alias("n_repeat_words"), "trusted",
    )


def grams(words: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row per n-gram of each document: its hash bucket."""
    one = [F.expr(f"transform(words, w -> cast(pmod(xxhash64(w), {buckets}) as int))")]
    two = [F.expr(f"case when size(words) > 1 then transform(sequence(0, size(words) - 2), i -> "
                  f"cast(pmod(xxhash64(words[i], words[i + 1]), {buckets}) as int)) else array() end")]
    chosen = F.concat(*(one if 1 in ORDERS else []), *(two if 2 in ORDERS else []))
    kept = [c for c in words.columns if c != "words"]
    return words.select(*kept, F.explode(chosen).alias("bucket"))


def ratio_table(surface: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Log ratio of the trusted to the raw multinomial, with one added to each bucket; ``buckets`` rows at most."""
    counts = cut(grams(surface.select("trusted", "words"), buckets).groupBy("bucket").agg(
        F.count("*").alias("raw"), F.count(F.when(F.col("trusted"), 1)).alias("target")))
    totals = counts.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
    raw, target = totals["raw"] or 0, totals["target"] or 0
    ratio = F.log((F.col("target") + 1.0) / (target + buckets)) - F.log((F.col("raw") + 1.0) / (raw + buckets))
    return counts.select("bucket", (ratio if target else F.lit(0.0)).alias("ratio"))


def score(docs: DataFrame, deviations: float = DEVIATIONS, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: its measures, its mean log ratio, and whether it is kept."""
    words = with_words(docs)
    surface = with_surface(words)
    table = ratio_table(surface, buckets)
    narrow = measures(surface)
    ratios = grams(words.select(*KEY, "words"), buckets).join(F.broadcast(table), "bucket").groupBy(*KEY).agg(F.avg("ratio").alias("llr"))
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    scored = cut(narrow.join(ratios, KEY, "left").select(
        *[c for c in narrow.columns if c not in KEY], F.round(F.coalesce("llr", F.lit(0.0)), 9).alias("score"),
        failed.alias("base_failed"),
    ))
    trusted = scored.filter("trusted").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("deviation")).first()
    least = -math.inf if trusted["mean"] is None else round(trusted["mean"] - deviations * trusted["deviation"], 6)
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("score") >= F.lit(least))).alias("kept"), "score",
    )
