"""Substring deduplication with suffix automata of reference passages.

A window is ``WINDOW`` consecutive words. A word is removed if a window covers it that also starts in a document with a
smaller id.

1. Each window selects the run of ``GRAM`` words in it with the least hash as its anchor, so equal windows have equal
   anchors. Anchors seen in more than one document are kept, with the smallest document that has each.
2. That document is the reference for the windows with this anchor: the stretches of it around its anchors are reference
   passages, and the stretches of other documents around the same anchors are streamed against them. Passages of one
   reference meet in one task, which builds their suffix automaton and reads the matching statistics of each stretch. An
   anchor of many documents is dealt to as many tasks as it needs, and its passages, a few words each, are sent to all.
3. A window that does not occur in its reference may still occur in another document with the same anchor. All such
   documents have it left over too, so counting the left-over windows by hash settles them.
4. The words covered are removed.

Texts are compressed wherever they are shuffled.

Defined results: null or empty text has no words; a text of fewer than ``WINDOW`` words stays whole; equal rows give equal
results, and rows of one id are told apart by their texts; a row without id is neither a source nor changed; an empty table
gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm import arrays
from pricetide.llm.texts import packed, unpacked
from pricetide.sources.lineage import cut

WINDOW = 13
GRAM = 6
#: documents of one anchor that a task takes
TASK_DOCUMENTS = 512


def text_key(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def window_anchors(w: arrays.Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows inside one text, the place of each one's anchor, and the hash of every run of words."""
    runs = arrays.windows(w.hashes, gram)
    n = len(w.hashes) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), runs
    least, place = runs[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, window - gram + 1):
        lower = runs[j : n + j] < least
        np.copyto(least, runs[j : n + j], where=lower)
        place[lower] = j
    end_of = np.repeat(w.of[1:], np.diff(w.of))[:n]
    starts = np.flatnonzero(np.arange(n) + window <= end_of)
    return starts, starts + place[starts], runs


def anchors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id, anchor``: the different anchors of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in arrays.slices(batches, "text"):
                w = arrays.words(batch.column("text"))
                starts, places, runs = window_anchors(w, window, gram)
                bounds = np.searchsorted(starts, w.of)
                lists = []
                for a, b in zip(bounds[:-1], bounds[1:]):
                    p = places[a:b]
                    lists.append(np.unique(runs[p[np.r_[True, p[1:] != p[:-1]]]] if len(p) else runs[:0]))
                sizes = np.fromiter(map(len, lists), np.int64, len(lists))
                ids = np.repeat(np.array(batch.column("doc_id"), np.int64), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(ids), arrays.signed(np.concatenate(lists))], ["doc_id", "anchor"])

    return docs.filter("doc_id is not null").mapInArrow(run, "doc_id bigint, anchor bigint")


PASSAGE = "ref bigint, spread int, doc_id bigint, text_key bigint, start bigint, passage binary"


def passages(texts: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Stretches of documents whose windows have one reference: rows with ``doc_id = ref`` are reference passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch, raw in unpacked(batches):
                rows: list[list] = [[], [], [], [], [], []]
                w = arrays.words(pa.array(raw, pa.large_binary()))
                starts, places, runs = window_anchors(w, window, gram)
                bounds = np.searchsorted(starts, w.of)
                found = batch.column("found")
                for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                    at, keys = starts[bounds[i] : bounds[i + 1]], runs[places[bounds[i] : bounds[i + 1]]].view(np.int64)
                    if not len(at):
                        continue
                    anchor, ref, spread = (np.array(found[i].values.field(c)) for c in ("anchor", "ref", "spread"))
                    order = np.argsort(anchor)
                    anchor, ref, spread = anchor[order], ref[order], spread[order]
                    hit = np.minimum(np.searchsorted(anchor, keys), len(anchor) - 1)
                    shared = anchor[hit] == keys
                    r, s = np.where(shared, ref[hit], 0), np.where(shared, spread[hit], 0)
                    new = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (s[1:] != s[:-1])])
                    words, base, key = raw[i].split(), w.of[i], text_key(raw[i])
                    for a, b in zip(new.tolist(), [*new[1:].tolist(), len(at)]):
                        if s[a]:
                            first = int(at[a] - base)
                            piece = b" ".join(words[first : first + b - a + window - 1])
                            for column, value in zip(rows, (int(r[a]), int(s[a]), doc_id, key, first, piece)):
                                column.append(value)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], [c.split()[0] for c in PASSAGE.split(", ")])

    return texts.mapInArrow(run, PASSAGE)


class SuffixAutomaton:
    """All runs of words of the added passages; passages are kept apart by marks that equal no word."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.last, self.marks = 0, 0

    def add(self, words: list[bytes]) -> None:
        self.marks += 1
        for word in [*words, self.marks]:
            self._append(word)

    def _append(self, word) -> None:
        nexts, link, length = self.next, self.link, self.length
        new, p = len(nexts), self.last
        nexts.append({})
        length.append(length[p] + 1)
        link.append(0)
        while p >= 0 and word not in nexts[p]:
            nexts[p][word] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][word]
            if length[q] != length[p] + 1:
                copy = len(nexts)
                nexts.append(nexts[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(word) == q:
                    nexts[p][word] = copy
                    p = link[p]
                link[q] = copy
                q = copy
            link[new] = q
        self.last = new

    def statistics(self, words: list[bytes]) -> list[int]:
        """For each word, how many words up to it stand together in a passage."""
        nexts, link, length = self.next, self.link, self.length
        state, matched, out = 0, 0, []
        for word in words:
            to = nexts[state].get(word)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = nexts[state].get(word)
            if to is not None:
                state, matched = to, matched + 1
            out.append(matched)
        return out


FOUND = "doc_id bigint, text_key bigint, a bigint, b bigint, hash bigint, settled boolean"


def matches(stretches: DataFrame, window: int = WINDOW) -> DataFrame:
    """Stretches of each passage that its reference holds, settled, and each window that it does not, by its hash. Settled
    rows get a hash of their own, so that they spread."""
    own = F.col("doc_id") == F.col("ref")
    salts = F.when(own, F.sequence(F.lit(0), F.col("spread") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id"), F.col("spread")).cast("int")))
    dealt = stretches.withColumn("salt", F.explode(salts)).withColumn("streamed", ~own)
    key = ["ref", "spread", "salt"]
    # a reference without a stream of its own salt or spread is built and dropped again
    dealt = dealt.repartition(*key).sortWithinPartitions(*key, "streamed", "doc_id", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, automaton, whole, pending = None, SuffixAutomaton(), set(), []
        for batch in batches:
            rows: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in (*key, "streamed", "doc_id", "text_key", "start", "passage")]
            for ref, spread, salt, streamed, doc_id, text, start, passage in zip(*columns):
                if current != (ref, spread, salt):
                    current, automaton, whole, pending = (ref, spread, salt), None, set(), []
                if not streamed:
                    if passage not in whole:
                        whole.add(passage)
                        pending.append(passage)
                    continue
                words = passage.split(b" ")
                spans: list[list[int]] = []
                if passage in whole:
                    spans.append([start, start + len(words)])
                else:
                    if automaton is None:
                        automaton = SuffixAutomaton()
                        for p in pending:
                            automaton.add(p.split(b" "))
                    for end, n in enumerate(automaton.statistics(words)[window - 1 :], start + window):
                        if n < window:
                            run_of = b" ".join(words[end - window - start : end - start])
                            rows.append((doc_id, text, end - window, end, text_key(run_of), False))
                        elif spans and spans[-1][1] >= end - window:
                            spans[-1][1] = end
                        else:
                            spans.append([end - window, end])
                rows += [(doc_id, text, a, b, text_key(b"%d %d %d" % (doc_id, a, b)), True) for a, b in spans]
            kinds = [pa.int64()] * 5 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], [c.split()[0] for c in FOUND.split(", ")])

    return dealt.select(*key, "streamed", "doc_id", "text_key", "start", "passage").mapInArrow(run, FOUND)


CLEANED = "doc_id bigint, n_words bigint, n_removed bigint, kept binary"


def removed_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: the kept words of every document, joined by a space."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = packed(docs)
    shared = cut(anchors(docs, window, gram).groupBy("anchor").agg(F.min("doc_id").alias("ref"), F.count("*").alias("n")).filter("n > 1").select(
        "anchor", "ref", F.expr(f"cast(power(2, ceil(log2(greatest(1, n / {TASK_DOCUMENTS})))) as int)").alias("spread")))
    found = anchors(docs, window, gram).join(shared, "anchor").groupBy("doc_id").agg(F.collect_set(F.struct("anchor", "ref", "spread")).alias("found"))
    # one exchange by hash serves the count and the join, and one exchange of the texts serves this and the last join
    matched = matches(passages(texts.join(found, "doc_id"), window, gram), window).repartition("hash")
    repeated = matched.filter("not settled").groupBy("hash").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
    spans = matched.join(repeated.select("hash", "least"), "hash", "left").filter("settled or doc_id > least")
    per_doc = spans.groupBy("doc_id").agg(F.collect_set(F.struct("text_key", "a", "b")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in unpacked(batches):
            rows: list[list] = [[], [], [], []]
            spans = batch.column("spans")
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                words = raw[i].split()
                n = len(words)
                if spans[i].is_valid:
                    inside = spans[i].values
                    mine = np.array(inside.field("text_key")) == text_key(raw[i])
                    change = np.zeros(n + 1, np.int64)
                    np.add.at(change, np.array(inside.field("a"))[mine], 1)
                    np.add.at(change, np.array(inside.field("b"))[mine], -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(change[:n]) == 0).tolist()]
                for column, value in zip(rows, (doc_id, n, n - len(words), b" ".join(words))):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], [c.split()[0] for c in CLEANED.split(", ")])

    return texts.join(per_doc, "doc_id", "left").mapInArrow(run, CLEANED)
