"""Benchmark decontamination with spaced seeds.

A seed mask looks at five of eight consecutive words and ignores the rest, so a seed still matches where ignored words were
replaced. The four masks here hit every run of ``OVERLAP`` words in which at most three words differ. Seeds of the
benchmark go into a bitmap of fixed size; a document emits the seeds that the bitmap may hold, with the words around them.
Those few are joined with the benchmark's seeds by hash, and each resulting alignment of document and item is verified
word by word: the best run of ``OVERLAP`` words must agree in ``AGREE`` of them.

Words are lower-cased runs of ASCII letters, digits and all other characters above ASCII. An item shorter than a mask is
looked for as a whole, word for word; one as long as a mask also by its first and its last seven words, since all masks
look at its first and last word and either may be the one that differs; one of fewer than ``LEAST_WORDS`` words is too common to be told from chance and is
not looked for.

Defined results: null or empty documents and items match nothing; repeated documents or items give one row per pair of
ids; rows with a null id are not reported; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm import arrays
from pricetide.sources.lineage import cut

MASKS = [(0, 1, 2, 6, 7), (0, 2, 5, 6, 7), (0, 1, 4, 6, 7), (0, 1, 3, 5, 7)]
SPAN = 8
OVERLAP = 13
AGREE = 10
LEAST_WORDS = 5
#: bits of the bitmap: it takes 4 MiB whatever the benchmark's size; a fuller bitmap only lets more seeds through to the join
BITMAP_BITS = 1 << 25


def _words(texts: pa.Array) -> arrays.Words:
    return arrays.words(texts, arrays.NOT_ALNUM, lower=True)


def spaced_seeds(hashes: np.ndarray, lengths: list[int]) -> list[tuple[int, np.ndarray]]:
    """Seeds at each place for every mask, and whole runs of the given short lengths."""
    out = []
    n = len(hashes) - SPAN + 1
    if n > 0:
        for number, mask in enumerate(MASKS):
            seed = np.full(n, np.uint64(number + 101), np.uint64)
            for place in mask:
                seed = seed * arrays.BASE + hashes[place : place + n]
                seed ^= seed >> np.uint64(29)
            out.append((SPAN, arrays.mix(seed)))
    return out + [(k, arrays.windows(hashes, k, seed=k)) for k in lengths if len(hashes) >= k]


def _places(seeds: np.ndarray) -> list[np.ndarray]:
    mask = np.uint64(BITMAP_BITS - 1)
    return [seeds & mask, (seeds >> np.uint64(32)) & mask]


def item_words(benchmark: DataFrame) -> DataFrame:
    """``item_id, words``: hashed words of each item that is long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.slices(batches, "text"):
            w = _words(batch.column("text"))
            lists = [w.hashes[a:b].view(np.int64) for a, b in zip(w.of[:-1], w.of[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(lists, pa.list_(pa.int64()))], ["item_id", "words"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null")
    return items.mapInArrow(run, "item_id bigint, words array<bigint>").filter(F.size("words") >= LEAST_WORDS).distinct()


def whole_run(n_words: int) -> int:
    """Length of the runs that an item of so many words is looked for by, besides the masks."""
    return n_words if n_words < SPAN else SPAN - 1


def item_seeds(items: DataFrame) -> DataFrame:
    """``seed, item_id, place`` of every item; a short item has one seed, its whole run, one of eight words two runs of seven more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for item, listed in zip(batch.column("item_id").to_pylist(), batch.column("words")):
                    hashes = np.array(listed.values).view(np.uint64)
                    for _, seeds in spaced_seeds(hashes, [whole_run(len(hashes))] if len(hashes) <= SPAN else []):
                        yield pa.RecordBatch.from_arrays(
                            [arrays.signed(seeds), pa.array([item] * len(seeds), pa.int64()), pa.array(range(len(seeds)), pa.int64())],
                            ["seed", "item_id", "place"])

    return items.mapInArrow(run, "seed bigint, item_id bigint, place bigint")


def bitmap(seeds: DataFrame) -> np.ndarray:
    """Bits of all seeds. Or-ed per 64 bits in Spark, so at most ``BITMAP_BITS / 64`` numbers reach the driver."""
    bits = seeds.select(F.explode(F.array(
        F.col("seed").bitwiseAND(F.lit(BITMAP_BITS - 1)), F.shiftrightunsigned("seed", 32).bitwiseAND(F.lit(BITMAP_BITS - 1)))).alias("bit"))
    words = bits.select(F.shiftright("bit", 6).alias("at"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("word"))
    table = words.groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    out = np.zeros(BITMAP_BITS // 64, np.int64)
    out[table.column("at").to_numpy()] = table.column("word").to_numpy()
    return out


def candidates(docs: DataFrame, seeds: DataFrame, lengths: list[int]) -> DataFrame:
    """Regions of documents around seeds that the bitmap may hold: ``doc_id, first, words, hits(seed, place)``."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(seeds))
    margin = OVERLAP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value.view(np.uint64)

        def held(h: np.ndarray) -> np.ndarray:
            return (bits[h >> np.uint64(6)] >> (h & np.uint64(63))) & np.uint64(1) == 1

        with np.errstate(over="ignore"):
            for batch in arrays.slices(batches, "text"):
                w = _words(batch.column("text"))
                found = []
                for span, s in spaced_seeds(w.hashes, lengths):
                    one, two = _places(s)
                    at = np.flatnonzero(held(one))
                    at = at[held(two[at])]
                    doc = np.searchsorted(w.of, at, "right") - 1
                    inside = at + span <= w.of[doc + 1]
                    found.append(np.stack([doc[inside], at[inside], s[at[inside]].view(np.int64)]))
                if not found:
                    continue
                doc, at, seed = np.concatenate(found, axis=1)
                order = np.lexsort((seed, at))
                doc, at, seed = doc[order], at[order], seed[order]
                if not len(at):
                    continue
                new = np.flatnonzero(np.r_[True, (at[1:] - at[:-1] > 2 * margin) | (doc[1:] != doc[:-1])])
                rows: list[list] = [[], [], [], []]
                ids = batch.column("doc_id").to_pylist()
                for a, b in zip(new, np.r_[new[1:], len(at)]):
                    d, begin, end = doc[a], w.of[doc[a]], w.of[doc[a] + 1]
                    low, high = max(begin, at[a] - margin), min(end, at[b - 1] + SPAN + margin)
                    rows[0].append(ids[d])
                    rows[1].append(int(low - begin))
                    rows[2].append(w.hashes[low:high].view(np.int64))
                    rows[3].append([{"seed": int(s), "place": int(p - begin)} for s, p in zip(seed[a:b], at[a:b])])
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.struct([("seed", pa.int64()), ("place", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], ["doc_id", "first", "words", "hits"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    return chosen.mapInArrow(run, "doc_id bigint, first bigint, words array<bigint>, hits array<struct<seed:bigint,place:bigint>>")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best run of each alignment: agreeing words, and its place in the document."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            item, words = np.array(r["item"]), np.array(r["words"])
            at = r["diagonal"] - r["first"] + np.arange(len(item))
            inside = (at >= 0) & (at < len(words))
            same = np.zeros(len(item) + 1, np.int64)
            same[1:] = np.where(inside, words[np.clip(at, 0, len(words) - 1)] == item, False)
            length = min(OVERLAP, len(item))
            runs = np.cumsum(same)[length:] - np.cumsum(same)[:-length]
            best = int(runs.argmax())
            need = AGREE if length == OVERLAP else max(length - (length - LEAST_WORDS) // 3, 1)
            if runs[best] >= need:
                rows.append((r["doc_id"], r["item_id"], int(runs[best]), length, r["diagonal"] + best, int(same.sum()), len(item)))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 7)],
                                         ["doc_id", "item_id", "n_agree", "n_run", "run_at", "n_item_agree", "n_item_words"])


OVERLAPS = "doc_id bigint, item_id bigint, n_agree bigint, n_run bigint, run_at bigint, n_item_agree bigint, n_item_words bigint"


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item that overlap: the best run's agreement and place, and the item's whole."""
    items = cut(item_words(benchmark))
    seeds = cut(item_seeds(items))
    lengths = {whole_run(r["n"]) for r in items.select(F.size("words").alias("n")).filter(F.col("n") <= SPAN).distinct().collect()}
    regions = cut(candidates(docs, seeds, sorted(lengths)))
    hits = regions.select("doc_id", "first", F.explode("hits").alias("hit")).select("doc_id", "first", "hit.*")
    aligned = hits.join(seeds.withColumnRenamed("place", "item_place"), "seed").select(
        "doc_id", "first", "item_id", (F.col("place") - F.col("item_place")).alias("diagonal")).distinct()
    sides = aligned.join(regions.select("doc_id", "first", "words"), ["doc_id", "first"]).join(items.withColumnRenamed("words", "item"), "item_id")
    best = sides.select("doc_id", "item_id", "first", "diagonal", "words", "item").mapInArrow(_verify, OVERLAPS)
    rest = ["n_agree", "n_item_agree", "run_at", "n_run", "n_item_words"]
    return best.groupBy("doc_id", "item_id").agg(F.max(F.struct(*rest)).alias("best")).select("doc_id", "item_id", *[f"best.{c}" for c in rest])
