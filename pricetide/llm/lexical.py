"""Ranked lexical search over sharded, block-compressed posting lists by Block-Max MaxScore.

``index`` makes one row per shard, the documents of about ``SHARD_BYTES`` of text in a task. A shard has the sorted lists of all its
terms: document numbers as gaps and term counts, in the narrowest whole bytes a list needs. Every ``BLOCK`` postings form a
block, of which the last document and its impacts are kept: the (count, length) pairs that no other posting of the block
beats in both. A block's highest contribution follows from its impacts for any average length, so the index needs no
corpus statistics and lasts as documents are added.

``search`` takes the items in blocks of about ``ITEM_TERMS`` terms, the only thing that is broadcast. For a block of items:

1. Document frequencies of its terms, numbers of documents and terms are summed over the shards.
2. In each shard an item's lists are ordered by their highest contribution. Those that together stay under the item's
   threshold, the ``k``-th best score its task has seen, are non-essential: a document that is only in them cannot rank. The essential
   lists are read and give candidates with part of their scores. What the blocks of the non-essential lists can add at most
   rejects candidates before any of these blocks is decompressed; the blocks that the others fall into are read, list by
   list, with another test after each.
3. A task keeps one heap an item over its shards. The heaps are merged in groups of ``MERGED`` tasks, then all.

The result is exact, scores are whole numbers, and nothing is dropped that could rank.

Defined results: null texts and texts without terms are in no result and do not count; repeated rows are documents of their own
that follow each other in rank; a document without id stands before others of its score and has a null id; equal items
are ranked once, different texts under one item id each; an item without terms, or whose terms occur nowhere, has no
rows; ties of score go to the smaller id; texts are read whole, a longer text than a shard's size is a shard of its own; empty
tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricetide.llm import arrays
from pricetide.sources.lineage import cut

K = 50
BLOCK = 64
SHARD_BYTES = 8 << 20
ITEM_TERMS = 1 << 20
MERGED = 64
WIDTHS = [np.uint8, np.uint16, np.uint32]

#: binary columns of a shard and what they hold
PARTS = {
    "ids": np.int64, "no_id": np.uint8, "lengths": np.int64,  # of documents
    "term_ends": np.int32, "counts": np.int32, "gap_kind": np.uint8, "tf_kind": np.uint8,  # of terms
    "lasts": np.int32, "impacts": np.uint8, "impact_tf": np.int32, "impact_length": np.int32,  # of blocks
    **{f"gaps_{w().itemsize}": w for w in WIDTHS}, **{f"tfs_{w().itemsize}": w for w in WIDTHS},
}
INDEX = "n_documents bigint, n_terms bigint, terms binary, " + ", ".join(f"{c} binary" for c in PARTS)


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Every term of every text in order, and where each text's terms begin."""
    data, at = arrays.buffers(texts)
    inside = ~arrays.NOT_ALNUM[data]
    edges = np.zeros(len(data) + 1, bool)
    edges[at] = True
    begins = np.flatnonzero(inside & (np.r_[True, ~inside[:-1]] | edges[:-1]))
    letters = np.r_[0, np.cumsum(inside)]
    offsets = np.r_[letters[begins], letters[-1]].astype(np.int64)
    raw = arrays.LOWER[data[inside]]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]), np.searchsorted(begins, at)


def packed_lists(values: np.ndarray, of: np.ndarray, counts: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """The values of each list in the width its greatest needs: a stream a width, and the width of each list."""
    most = np.maximum.reduceat(values, np.cumsum(counts) - counts) if len(counts) else values
    kind = (most >= 1 << 8).astype(np.uint8) + (most >= 1 << 16)
    return {f"{name}s_{w().itemsize}": values[kind[of] == k].astype(w) for k, w in enumerate(WIDTHS)} | {f"{name}_kind": kind}


def stream_places(kind: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Where each list begins in the stream of its width."""
    own = np.where(kind == np.arange(len(WIDTHS))[:, None], counts, 0)
    return (np.cumsum(own, axis=1) - own)[kind, np.arange(len(kind))]


def impacts(block: np.ndarray, tf: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each block the (count, length) pairs that no other pair beats: how many it has, counts, lengths."""
    order = np.lexsort((length, -tf, block))
    block, tf, length = block[order], tf[order], length[order]
    if not len(block):
        return block, tf, length
    step = int(length.max()) + 1
    level = length + (block[-1] - block) * step  # every block lies under those before, so one running minimum serves all
    best = np.minimum.accumulate(level)
    kept = np.r_[True, level[1:] < best[:-1]]
    return np.bincount(block[kept], minlength=block[-1] + 1), tf[kept], length[kept]


def shard(ids: pa.Array, texts: pa.Array) -> dict[str, object]:
    """The lists of one shard."""
    terms, of = terms_of(texts)
    lengths = np.diff(of)
    coded = terms.dictionary_encode()
    documents = np.repeat(np.arange(len(texts)), lengths)
    pairs, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(texts) + documents, return_counts=True)
    term, document = np.divmod(pairs, max(len(texts), 1))
    counts = np.bincount(term, minlength=len(coded.dictionary))
    starts = np.cumsum(counts) - counts
    nth = np.arange(len(term)) - starts[term]
    gaps = np.where(nth > 0, document - np.r_[0, document[:-1]], document)
    block = np.cumsum(nth % BLOCK == 0) - 1
    n_impacts, impact_tf, impact_length = impacts(block, tf, lengths[document])
    _, term_at, raw = coded.dictionary.buffers()
    ends = np.frombuffer(term_at, np.int64)[1 : len(coded.dictionary) + 1]
    parts = {
        "ids": pc.fill_null(ids, 0).to_numpy(), "no_id": pc.is_null(ids).to_numpy(zero_copy_only=False), "lengths": lengths,
        "term_ends": ends, "counts": counts, **packed_lists(gaps, term, counts, "gap"), **packed_lists(tf, term, counts, "tf"),
        "lasts": document[np.r_[np.flatnonzero(np.diff(block)), len(block) - 1]] if len(block) else block,
        "impacts": n_impacts, "impact_tf": impact_tf, "impact_length": impact_length,
    }
    return {"n_documents": int((lengths > 0).sum()), "n_terms": len(terms), "terms": raw.to_pybytes()[: ends[-1]] if len(ends) else b""} | {
        c: parts[c].astype(kind).tobytes() for c, kind in PARTS.items()}


def index(docs: DataFrame) -> DataFrame:
    """One row per shard with the posting lists of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("n_documents", pa.int64()), ("n_terms", pa.int64()), *[(c, pa.binary()) for c in ("terms", *PARTS)]])
        for rows in gathered(batches):
            for batch in arrays.slices(iter([rows]), "text", SHARD_BYTES):
                yield pa.RecordBatch.from_pylist([shard(batch.column("doc_id"), batch.column("text"))], schema=kinds)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches joined until they have the size of a shard."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= SHARD_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
            held, size = [], 0
    if held and (rows := pa.Table.from_batches(held).combine_chunks().to_batches()):
        yield rows[0]


class Shard:
    """A shard opened for reading; ``lists`` has the place of each wanted term, -1 where the shard lacks it."""

    def __init__(self, batch: pa.RecordBatch, row: int, vocabulary: pa.Array, with_lists: bool = True) -> None:
        read = lambda c: np.frombuffer(batch.column(c)[row].as_buffer(), PARTS[c])
        ends = read("term_ends")
        offsets = np.r_[0, ends].astype(np.int64)
        terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), batch.column("terms")[row].as_buffer()])
        self.lists = pc.fill_null(pc.index_in(vocabulary, value_set=terms), -1).to_numpy().astype(np.int64)
        self.counts = read("counts").astype(np.int64)
        if with_lists:
            self.lengths, self.ids, self.no_id, self.lasts = read("lengths"), read("ids"), read("no_id"), read("lasts").astype(np.int64)
            self.impacts = [read(c).astype(np.int64) for c in ("impacts", "impact_tf", "impact_length")]
            self.kinds = {name: read(f"{name}_kind") for name in ("gap", "tf")}
            self.places = {name: stream_places(kind, self.counts) for name, kind in self.kinds.items()}
            self.first_block = np.r_[0, np.cumsum(-(-self.counts // BLOCK))]
            self.streams = {name: [read(f"{name}s_{w().itemsize}") for w in WIDTHS] for name in ("gap", "tf")}
            self.opened = 0

    def weigh(self, documents: int, terms: int) -> None:
        """Length norms of the documents, and the highest contribution of every block and list for a weight of one."""
        self.norms = norms(self.lengths, documents, terms)
        n, tf, lengths = self.impacts
        highest = saturation(tf, norms(lengths, documents, terms))
        self.block_max = np.maximum.reduceat(highest, np.cumsum(n) - n) if len(n) else highest
        self.list_max = np.maximum.reduceat(self.block_max, self.first_block[:-1]) if len(self.block_max) else self.block_max

    def values(self, name: str, term: int, at: np.ndarray) -> np.ndarray:
        return self.streams[name][self.kinds[name][term]][self.places[name][term] + at].astype(np.int64)

    def whole(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a list and what the term adds to each, for a weight of one."""
        at = np.arange(self.counts[term])
        documents = np.cumsum(self.values("gap", term, at))
        self.opened += int(self.first_block[term + 1] - self.first_block[term])
        return documents, saturation(self.values("tf", term, at), self.norms[documents])

    def block_of(self, term: int, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block of a list that each document would be in, and the most it can add; 0 behind the last block."""
        first, end = self.first_block[term], self.first_block[term + 1]
        block = np.searchsorted(self.lasts[first:end], documents)
        inside = block < end - first
        return block, np.where(inside, self.block_max[first + np.minimum(block, end - first - 1)], 0)

    def look_up(self, term: int, block: np.ndarray, documents: np.ndarray) -> np.ndarray:
        """What the term adds to each document; only the blocks named are decompressed."""
        first = self.first_block[term]
        wanted = np.unique(block[block < self.first_block[term + 1] - first])
        self.opened += len(wanted)
        at = wanted[:, None] * BLOCK + np.arange(BLOCK)
        there = at < self.counts[term]
        gaps = np.where(there, self.values("gap", term, np.minimum(at, self.counts[term] - 1)), 0)
        gaps[:, 0] += np.where(wanted > 0, self.lasts[first + wanted - 1], 0)
        found = np.cumsum(gaps, axis=1)[there]
        out, place = np.zeros(len(documents), np.int64), np.searchsorted(found, documents)
        hit = np.flatnonzero(place < len(found))
        hit = hit[found[place[hit]] == documents[hit]]
        out[hit] = saturation(self.values("tf", term, at[there][place[hit]]), self.norms[documents[hit]])
        return out


def norms(lengths: np.ndarray, documents: int, terms: int) -> np.ndarray:
    return 50 + 50 * lengths * documents // max(terms, 1)


def saturation(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * norm)


@dataclass
class Heap:
    """The best ``k`` rows seen: score, whether there is an id, id."""

    k: int
    rows: np.ndarray

    @property
    def threshold(self) -> int:
        return int(self.rows[-1, 0]) if len(self.rows) >= self.k else 1

    def add(self, scores: np.ndarray, no_id: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k:
            enough = scores >= np.partition(scores, -self.k)[-self.k]
            scores, no_id, ids = scores[enough], no_id[enough], ids[enough]
        rows = np.concatenate([self.rows, np.stack([scores, 1 - no_id.astype(np.int64), ids], axis=1)])
        self.rows = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))[: self.k]]


def rank_in_shard(s: Shard, terms: np.ndarray, weights: np.ndarray, heap: Heap) -> None:
    """Bring an item's heap up to date with one shard."""
    lists = s.lists[terms]
    there = (lists >= 0) & (weights > 0)
    lists, weights = lists[there], weights[there]
    highest = weights * s.list_max[lists]
    order = np.argsort(highest, kind="stable")
    lists, weights, reach = lists[order], weights[order], np.cumsum(highest[order])
    threshold = heap.threshold
    essential = int(np.searchsorted(reach, threshold, "left"))  # lists before it cannot reach the threshold together
    if essential == len(lists):
        return
    partial = np.zeros(len(s.lengths), np.int64)
    for term, weight in zip(lists[essential:].tolist(), weights[essential:].tolist()):
        documents, adds = s.whole(term)
        partial[documents] += weight * adds
    candidates = np.flatnonzero(partial + (reach[essential - 1] if essential else 0) >= threshold)
    candidates = candidates[partial[candidates] > 0]
    scores = partial[candidates]
    if essential and len(candidates):
        blocks, most = zip(*(s.block_of(t, candidates) for t in lists[:essential].tolist()))
        blocks, most = np.stack(blocks), np.cumsum(np.stack(most) * weights[:essential, None], axis=0)
        for i in reversed(range(essential)):
            alive = scores + most[i] >= threshold
            if not alive.all():
                candidates, scores, blocks, most = candidates[alive], scores[alive], blocks[:, alive], most[:, alive]
            if not len(candidates):
                return
            scores = scores + weights[i] * s.look_up(int(lists[i]), blocks[i], candidates)
    kept = scores >= threshold
    heap.add(scores[kept], s.no_id[candidates[kept]], s.ids[candidates[kept]])


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int, list[bytes]]]]:
    """The items with their distinct terms, in blocks of about ``ITEM_TERMS`` terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.slices(batches, "text"):
            terms, of = terms_of(batch.column("text"))
            lists = [terms.slice(a, b - a).unique().to_pylist() for a, b in zip(of[:-1].tolist(), of[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(lists, pa.list_(pa.binary()))], ["item_id", "terms"])

    chosen = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    found = cut(chosen.mapInArrow(run, "item_id bigint, terms array<binary>").filter(F.size("terms") > 0))
    total = found.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-total // ITEM_TERMS)
    for b in range(blocks):
        own = found.filter(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == b)
        yield [(r["item_id"], [bytes(t) for t in r["terms"]]) for r in own.toLocalIterator()]


def frequencies(shards: DataFrame, vocabulary: pa.Array) -> np.ndarray:
    """In how many documents each term is."""
    shared = shards.sparkSession.sparkContext.broadcast(vocabulary.to_pylist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array(shared.value, pa.large_binary())
        totals = np.zeros(len(terms), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                s = Shard(batch, row, terms, with_lists=False)
                there = s.lists >= 0
                totals[there] += s.counts[s.lists[there]]
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(totals[used], pa.int64())], ["term", "n"])

    counted = shards.select("terms", "term_ends", "counts").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(vocabulary), np.int64)
    out[counted.column("term").to_numpy()] = counted.column("n").to_numpy()
    return out


FOUND = "item bigint, item_id bigint, doc_id bigint, score bigint"


def heaps(shards: DataFrame, block: list[tuple[int, list[bytes]]], documents: int, terms: int, k: int) -> DataFrame:
    """The best ``k`` documents of every task for each item of a block."""
    vocabulary = pa.array(sorted({t for _, own in block for t in own}), pa.large_binary())
    df = frequencies(shards, vocabulary).astype(float)
    weights = np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)
    place = {t: i for i, t in enumerate(vocabulary.to_pylist())}
    asked = [(item_id, np.array([place[t] for t in own])) for item_id, own in block]
    shared = shards.sparkSession.sparkContext.broadcast((vocabulary.to_pylist(), weights, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weights, asked = shared.value
        words = pa.array(words, pa.large_binary())
        held = [Heap(k, np.empty((0, 3), np.int64)) for _ in asked]
        for batch in batches:
            for row in range(batch.num_rows):
                s = Shard(batch, row, words)
                if not len(s.counts):
                    continue
                s.weigh(documents, terms)
                for (_, own), heap in zip(asked, held):
                    rank_in_shard(s, own, weights[own], heap)
        sizes = [len(h.rows) for h in held]
        rows = np.concatenate([h.rows for h in held]) if held else np.empty((0, 3), np.int64)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(len(held)), sizes), pa.int64()),
            pa.array([item_id for (item_id, _), n in zip(asked, sizes) for _ in range(n)], pa.int64()),
            pa.array(rows[:, 2], pa.int64(), mask=rows[:, 1] == 0), pa.array(rows[:, 0], pa.int64()),
        ], ["item", "item_id", "doc_id", "score"])

    return shards.mapInArrow(run, FOUND)


def merged(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` rows of each item, over groups of tasks first."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    for keys in (["item", "lane"], ["item"]):
        found = found.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    return found


def search(shards: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of an index for each item, those with a score above 0."""
    totals = shards.agg(F.sum("n_documents").alias("documents"), F.sum("n_terms").alias("terms")).first()
    out = shards.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for block in item_blocks(items) if totals["documents"] else ():
        found = cut(heaps(shards, block, totals["documents"], totals["terms"], k).withColumn("lane", F.floor(F.spark_partition_id() / MERGED)))
        out = out.union(merged(found, k).select("item_id", "rank", "doc_id", "score"))
    return out


def ranked(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """Index the documents, keep the index in the checkpoint folder, and search it."""
    return search(cut(index(docs)), items, k)
