"""Near-duplicate groups by MinHash bands, odd sketches and a check on full shingle sets.

1. Each text becomes its set of distinct 5-word shingles. Texts with equal sets form one class, whose least document stands
   for it; only these are compared.
2. A class has ``bands * rows`` MinHash values. Each band of values is a bucket key. Besides, its shingles are dealt to
   ``BINS`` bins; the least of each bin is one more MinHash sample, and these are folded into a parity bitmap, the odd
   sketch. The population count of two sketches' XOR estimates how many samples differ, precisely for similar sets.
3. Within a bucket every member meets two pivots, the least and the one with the most company in all its buckets, and pairs
   whose sketches agree well enough are checked on their full sets. The links found give groups.
4. In buckets that still hold several groups, members of different groups are compared. A bucket of up to ``SMALL`` classes
   is small enough for all its pairs. The members of larger ones are joined by an exact prefix filter instead: of each set only
   the rarest shingles, as many as can be missing from a similar set and one more, are looked up, in order of their rarity;
   a common shingle counts only where both sizes and its place in both orders leave room for enough others, and sets of
   sizes or of groups that rule each other out never meet. So a set with too many shingles of its own meets nobody, and
   a large group of loose near copies costs pairs in proportion to its members, not to their square.

A pair of similarity 0.85 shares no bucket of 24 bands with a chance under 1e-6, and a pair that is similar enough fails
the sketch test with a chance under 1e-9. A lower ``least`` needs more bands for that: 36 of them at 0.80. A second bitmap
folds all shingles of a set; it cannot differ in more bits than the sets differ in shingles, so its test loses nothing.

Defined results: null or empty text, or text without words, has no shingles and stands alone; a text of fewer than five
words is one shingle; equal rows repeat in the result; rows without id are returned as they are, in no group; equal ids
with different texts share their links; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.llm import arrays
from pricetide.llm.components import components
from pricetide.llm.texts import packed, unpacked
from pricetide.sources.lineage import cut, scratch, settled

SHINGLE = 5
BANDS, ROWS = 24, 5
BINS = 1024
SKETCH_BITS = 1024
DEVIATIONS = 5
LEAST = 85
#: largest bucket of which all pairs across groups are formed
SMALL = 128
#: sizes within this factor share a key of the prefix join
SIZE_STEP = 1.03
TASK_PARTNERS = 256


@lru_cache(maxsize=4)
def hash_functions(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Salts and factors of the MinHash functions, and the salts of the bands; fixed for each shape."""
    rng = np.random.Generator(np.random.PCG64(20240517))
    salts = rng.integers(0, 1 << 32, bands * rows, np.uint64).astype(np.uint32)
    factors = (rng.integers(0, 1 << 32, bands * rows, np.uint64) | np.uint64(1)).astype(np.uint32)
    return salts, factors, rng.integers(0, 1 << 63, (bands, rows), np.uint64) | np.uint64(1)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = arrays.words(texts, lower=True)
    runs = arrays.windows(w.hashes, SHINGLE)
    sets = []
    for a, b in zip(w.of[:-1].tolist(), w.of[1:].tolist()):
        if b - a >= SHINGLE:
            sets.append(np.unique(runs[a : b - SHINGLE + 1]))
        else:
            sets.append(arrays.windows(w.hashes[a:b], b - a, seed=b - a) if b > a else np.empty(0, np.uint64))
    return sets


def samples(shingles: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """The least value of a set under each of the hash functions."""
    salts, factors, _ = hash_functions(bands, rows)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(salts), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(least, ((x[i : i + 1024, None] ^ salts) * factors).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    *_, salts = hash_functions(bands, rows)
    values = least.reshape(bands, rows).astype(np.uint64)
    return arrays.mix((arrays.mix(values + salts) * salts).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity bitmap of the least shingle of each bin. Bins are the high bits of sorted hashes, so a bin's least is its first."""
    bins = shingles >> np.uint64(64 - BINS.bit_length() + 1)
    return parities(shingles[np.r_[True, bins[1:] != bins[:-1]]])


def parities(shingles: np.ndarray) -> np.ndarray:
    places = arrays.mix(shingles) % np.uint64(SKETCH_BITS)
    return np.packbits((np.bincount(places.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)).view(np.int64)


SIGNATURE = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>, sketch array<bigint>, whole array<bigint>"
SET = ["n_shingles", "set_a", "set_b"]


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Set size, two sums that identify the set, band keys and sketch of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in arrays.slices(batches, "text"):
                sets = shingle_sets(batch.column("text"))
                least = [samples(s, bands, rows) if len(s) else None for s in sets]
                sums = [[int(x.sum(dtype=np.uint64).astype(np.int64)) for x in (s, arrays.mix(s * arrays.BASE))] for s in sets]
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([a for a, _ in sums], pa.int64()), pa.array([b for _, b in sums], pa.int64()),
                    pa.array([[] if x is None else band_keys(x, bands, rows).view(np.int64) for x in least], longs),
                    pa.array([odd_sketch(x) if len(x) else [] for x in sets], longs),
                    pa.array([parities(x) for x in sets], longs),
                ], ["doc_id", *SET, "bands", "sketch", "whole"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SIGNATURE)


def most_bits(n: Column, m: Column, least: int = LEAST) -> Column:
    """Differing sketch bits that two sets of ``n`` and ``m`` shingles and similarity ``least`` stay under, but for rare chance.

    Sets that similar have ``(n + m) / (1 + j)`` shingles between them. From the bins that so many shingles, ``n`` and ``m``
    fill follows how many samples differ on average; the spread grows from that of a nearly complete sample, when bins are
    many, to that of independent draws. ``DEVIATIONS`` of it are allowed.
    """
    j = least / 100
    filled = lambda x: BINS * (1 - F.exp(-x / BINS))
    union = (n + m) / (1 + j)
    mean = filled(n) + filled(m) - 2 * j * filled(union)
    differing = mean + DEVIATIONS * F.sqrt(mean * F.least(F.lit(1.7), 0.25 + 0.3 * union / BINS)) + 2
    folded = SKETCH_BITS / 2 * (1 - F.exp(-2 * differing / SKETCH_BITS)) + 3 * F.sqrt(SKETCH_BITS / 4 * (1 - F.exp(-4 * differing / SKETCH_BITS)))
    return F.least(differing, folded)


def differing(a: Column, b: Column) -> Column:
    total = F.lit(0)
    for i in range(1, SKETCH_BITS // 64 + 1):
        total = total + F.bit_count(F.element_at(a, i).bitwiseXOR(F.element_at(b, i)))
    return total


MARKS = ["n_shingles", "sketch", "whole"]


def close(a: str, b: str, least: int) -> Column:
    """Whether two sets, whose columns have these prefixes, are near enough in size and in both bitmaps."""
    (n, s, w), (m, t, x) = ([F.col(p + c) for c in MARKS] for p in (a, b))
    return ((100 * F.least(n, m) >= least * F.greatest(n, m)) & ((100 + least) * differing(w, x) <= (100 - least) * (n + m))
            & (differing(s, t) <= most_bits(n, m, least)))


def linked(pairs: DataFrame, blobs: DataFrame, least: int) -> DataFrame:
    """The pairs whose full shingle sets are similar enough.

    The text of ``a`` is sent once to a task, before those of its partners; one with many partners is sent to several tasks.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / TASK_PARTNERS).cast("int").alias("spread"))
    salt = F.pmod(F.xxhash64("b"), F.col("spread")).cast("int").alias("salt")
    partners = pairs.join(sizes, "a").select("a", salt, "b").join(blobs.toDF("b", "blob"), "b").select("a", "salt", "b", "blob")
    pivots = sizes.join(blobs.toDF("a", "blob"), "a").select(
        "a", F.explode(F.sequence(F.lit(0), F.col("spread") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "blob")
    dealt = pivots.union(partners).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, own = None, []
        for batch, raw in unpacked(batches):
            keep = []
            sets = shingle_sets(pa.array(raw, pa.large_binary()))
            for a, part, b, s in zip(*[batch.column(c).to_pylist() for c in ("a", "salt", "b")], sets):
                if current != (a, part):
                    current, own = (a, part), []
                if b is None:
                    own.append(s)
                common = [len(np.intersect1d(s, x, assume_unique=True)) for x in own] if b is not None else []
                keep.append(any(100 * c >= least * (len(s) + len(x) - c) for c, x in zip(common, own)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return dealt.mapInArrow(run, "a bigint, b bigint")


def ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def marked(frame: DataFrame, classes: DataFrame, column: str, prefix: str) -> DataFrame:
    """Size and bitmaps of the classes in ``column``."""
    return frame.join(classes.select(F.col("rep").alias(column), *[F.col(c).alias(prefix + c) for c in MARKS]), column)


def small_pairs(members: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """Pairs across the groups of buckets that hold few classes, each in the least of its buckets only."""
    rows = cut(marked(members, classes, "rep", "").join(classes.select("rep", "bands"), "rep"))
    side = lambda p: rows.select("bucket", *[F.col(c).alias(p + c) for c in ("rep", "group", "bands", *MARKS)])
    once = F.array_min(F.array_intersect("l_bands", "r_bands")) == F.col("bucket")
    both = side("l_").join(side("r_"), "bucket").filter((F.col("l_rep") < F.col("r_rep")) & (F.col("l_group") != F.col("r_group")) & close("l_", "r_", least) & once)
    return both.select(F.col("l_rep").alias("a"), F.col("r_rep").alias("b"))


def shingle_rows(texts: DataFrame) -> DataFrame:
    """``rep, n, shingle`` of the texts given as ``rep, group, blob``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in unpacked(batches):
            sets = shingle_sets(pa.array(raw, pa.large_binary()))
            sizes = np.array([len(x) for x in sets])
            repeated = [np.repeat(batch.column(c).to_numpy(), sizes) for c in ("rep", "group")]
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, repeated), pa.array(np.repeat(sizes, sizes)), arrays.signed(np.concatenate(sets))], ["rep", "group", "n", "shingle"])

    return texts.select("rep", "group", "blob").mapInArrow(run, "rep bigint, group bigint, n bigint, shingle bigint")


def prefix_pairs(rows: DataFrame, least: int) -> DataFrame:
    """Pairs across groups that share a shingle which leaves room for enough common ones, of ``rep, group, n, shingle``."""
    counts = rows.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1")
    shared = rows.join(counts, "shingle").groupBy("rep", "group", "n").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("order"))
    needed = lambda n: F.ceil(n * least / 100)
    own = F.col("n") - F.size("order")  # shingles that no other set has come first in the order of rarity
    places = F.greatest(F.lit(0), F.col("n") - needed(F.col("n")) + 1 - own).cast("int")
    entries = cut(shared.select("rep", "group", "n", own.alias("own"), F.posexplode(F.slice("order", F.lit(1), places)).alias("at", "found")).select(
        "rep", "group", "n", (F.col("own") + F.col("at")).alias("at"), F.col("found.shingle").alias("shingle")))
    step = lambda n: F.floor(F.log(n.cast("double")) / float(np.log(SIZE_STEP))).cast("int")
    # enough common shingles with a set of size m: n - at >= least / (100 + least) * (n + m)
    most = lambda n, at: F.floor((n - at) * (100 + least) / least) - n
    high = F.least(F.col("n"), most(F.col("n"), F.col("at")))
    larger = entries.filter(high >= needed(F.col("n"))).withColumn("size", F.explode(F.sequence(step(needed(F.col("n"))), step(high))))
    smaller = entries.withColumn("size", step(F.col("n"))).select(
        "shingle", "size", F.col("group").alias("other"), F.col("rep").alias("m_rep"), F.col("n").alias("m"), F.col("at").alias("m_at"))
    groups = smaller.select("shingle", "size", "other").distinct()
    met = larger.join(groups, ["shingle", "size"]).filter("group != other").join(smaller, ["shingle", "size", "other"]).filter(
        (F.col("m") <= F.col("n")) & (F.col("m") <= most(F.col("n"), F.col("at"))) & (F.col("n") <= most(F.col("m"), F.col("m_at"))))
    return met.select(*ordered("rep", "m_rep"))


def links(docs: DataFrame, classes: DataFrame, least: int = LEAST) -> DataFrame:
    """Links between classes, enough of them to join all that are connected."""
    buckets = classes.select("rep", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = cut(buckets.join(shared, "bucket"))
    company = members.groupBy("rep").agg(F.sum("n").alias("company"))
    pivots = cut(members.join(company, "rep").groupBy("bucket").agg(
        F.min("rep").alias("p0"), F.max(F.struct("company", (-F.col("rep")).alias("rep")))["rep"].alias("p1")))
    texts = cut(packed(docs).join(company.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"))
    star = cut(members.join(pivots, "bucket").select("rep", F.explode(F.array("p0", -F.col("p1"))).alias("pivot")).filter("rep != pivot").select(
        *ordered("rep", "pivot")).distinct())
    near = marked(marked(star, classes, "a", "a_"), classes, "b", "b_").filter(close("a_", "b_", least))
    first = cut(linked(near.select("a", "b"), texts, least))
    grouped = members.join(components(first, "a", "b"), F.col("rep") == F.col("node"), "left").select(
        "bucket", "rep", "n", F.coalesce("component", "rep").alias("group"))
    apart = grouped.groupBy("bucket").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo < hi").select("bucket")
    rest = cut(grouped.join(apart, "bucket", "left_semi"))
    new = small_pairs(rest.filter(F.col("n") <= SMALL), classes, least)
    large = cut(rest.filter(F.col("n") > SMALL).select("rep", "group").distinct())
    if not large.isEmpty():
        rows = cut(shingle_rows(texts.withColumnRenamed("doc_id", "rep").join(large, "rep")))
        far = marked(marked(prefix_pairs(rows, least).distinct(), classes, "a", "a_"), classes, "b", "b_")
        new = new.union(far.filter(close("a_", "b_", least)).select("a", "b")).distinct()
    new = cut(new.join(star, ["a", "b"], "left_anti"))
    return first.union(linked(new, texts, least))


def near_duplicates(docs: DataFrame, least: int = LEAST, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: its set size, the least document of its group, and whether it is that document."""
    signed = cut(signatures(docs, bands, rows))
    classes = cut(signed.filter("n_shingles > 0 and doc_id is not null").groupBy(*SET).agg(
        F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("bands", "sketch", "whole")]))
    with scratch():
        groups = settled(components(links(docs, classes, least), "a", "b"))
    of_class = classes.select(*SET, "rep").join(groups, F.col("rep") == F.col("node"), "left").select(*SET, F.coalesce("component", "rep").alias("group"))
    return signed.select("doc_id", *SET).join(of_class, SET, "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("group", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
