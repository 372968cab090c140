"""Encoding and decoding with merge-type piece vocabularies.

A text is normalized and begins as a chain of single characters. Every two neighbours that together are a piece stand in an
agenda, ordered by the piece's score and then by place. The best pair is merged, its new neighbours join the agenda, and
what stood there for its sides goes. What is left is looked up; a symbol that is no piece becomes its bytes.

No piece of such a vocabulary holds a space mark after another character, which is tested when the vocabulary is read. So
merges never cross the place before a space mark, and a text falls into stretches with agendas of their own. The agendas of
all stretches that a batch is the first to have are worked off together, in arrays that take the best pair of each stretch
at a time; a stretch of more than ``ARRAY_CHARS`` characters has a heap of its own. Results are kept in a table of bounded
size. A vocabulary for which the test fails gets one agenda per text.

Every stretch is also encoded by the sentencepiece library, in Arrow batches, when it enters the table; ``agrees`` tells
whether all stretches of a text have the library's ids. Normalization and ``decode`` are the library's.

Defined results: null is the empty text, which has only the begin and end ids; bytes that are not UTF-8 read as U+FFFD;
texts of any length are encoded whole, a batch holds about ``SLICE_BYTES`` of text or one longer text; repeated rows, null
and repeated ids are encoded row by row; ties of score go to the leftmost pair; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm import arrays

MARK = "▁"
STRETCHES = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: longest stretch whose agenda is worked off in arrays, and so many stretches are kept at a time
ARRAY_CHARS, KEPT = 48, 400_000
#: stretches that the library encodes in a row
COMPARED = 2048
SLICE_BYTES = 4 << 20
#: a pair's value holds the rank of its score above the piece it makes
PIECE_BITS = 24
NO_PAIR = 1 << 48


class PairTable:
    """What two symbols merge to, in a hash table of numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, values: np.ndarray, symbols: int) -> None:
        self.symbols = symbols
        self.bits = max(8, int(len(values) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NO_PAIR, np.int64)
        keys, todo = left * symbols + right, np.arange(len(values))
        slots = self._slots(keys)
        while len(todo):
            free = todo[self.keys[slots[todo]] < 0]
            self.keys[slots[free]] = keys[free]  # of several for one slot the last stays
            self.values[slots[free]] = values[free]
            todo = todo[self.keys[slots[todo]] != keys[todo]]
            slots[todo] = (slots[todo] + 1) & (len(self.keys) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * arrays.BASE) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.symbols + right
        slots, out, todo = self._slots(keys), np.full(len(keys), NO_PAIR, np.int64), np.arange(len(keys))
        while len(todo):
            at = slots[todo]
            found = self.keys[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            todo = todo[~hit & (found >= 0)]
            slots[todo] = (slots[todo] + 1) & (len(self.keys) - 1)
        return out


class Vocabulary:
    """Pieces with scores, the byte pieces, and the library's processor for normalization, decoding and comparison."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.library = sp = SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        special = {i for i in ids if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        self.ids = {sp.id_to_piece(i): i for i in ids if i not in special}
        self.scores = {piece: sp.get_score(i) for piece, i in self.ids.items()}
        self.bytes = [i for i in ids if sp.is_byte(i)]
        if len(self.bytes) != 256 or any(sp.is_unused(i) for i in ids):
            raise ValueError("a merge-type vocabulary with all byte pieces and without unused pieces is needed")
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (sp.bos_id(), sp.eos_id()))
        self.apart = sp.normalize("a") == f"{MARK}a" and not any(re.search(f"[^{MARK}]{MARK}", piece) for piece in self.ids)
        self._tables(len(ids))
        #: by stretch: its ids as bytes, and whether the library has the same
        self.seen: dict[str, bytes] = {}
        self.differing: set[str] = set()

    def _tables(self, n: int) -> None:
        self.n, symbols = n, dict(self.ids)
        for ch in {c for piece in self.ids for c in piece}:
            symbols.setdefault(ch, len(symbols) + n)  # a character that is only part of pieces
        self.of_char = np.full(0x110000, 2 * n + len(symbols), np.int64)
        for ch, i in symbols.items():
            if len(ch) == 1:
                self.of_char[ord(ch)] = i
        ranks = {s: r for r, s in enumerate(sorted(set(self.scores.values()), reverse=True))}
        rows = [(symbols[a], symbols[b], ranks[self.scores[piece]] << PIECE_BITS | i) for piece, i in self.ids.items()
                for cut in range(1, len(piece)) if (a := piece[:cut]) in symbols and (b := piece[cut:]) in symbols]
        self.pairs = PairTable(*np.array(rows, np.int64).reshape(-1, 3).T, 2 * n + len(symbols) + 1)

    def merged(self, text: str) -> list[str]:
        """The symbols left when no two neighbours are a piece, by a heap."""
        scores, symbols = self.scores, list(text)
        before, after = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
        agenda = [(-scores[pair], i, i + 1, pair) for i in range(len(symbols) - 1) if (pair := symbols[i] + symbols[i + 1]) in scores]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, pair = heapq.heappop(agenda)
            if after[left] != right or symbols[left] + symbols[right] != pair:
                continue
            symbols[left], symbols[right] = pair, ""
            after[left] = following = after[right]
            after[right] = -2
            if following >= 0:
                before[following] = left
            for a, b in ((before[left], left), (left, following)):
                if a >= 0 and b >= 0 and (new := symbols[a] + symbols[b]) in scores:
                    heapq.heappush(agenda, (-scores[new], a, b, new))
        return [s for s in symbols if s]

    def merged_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for many texts at once: symbols, the characters they begin with, and how many each text has."""
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
        lengths = np.array([len(t) for t in texts])
        symbols, first, text = self.of_char[chars], np.arange(len(chars)), np.repeat(np.arange(len(texts)), lengths)
        starts = np.cumsum(lengths) - lengths
        value = np.full(len(chars), NO_PAIR, np.int64)
        inner = np.flatnonzero(text[1:] == text[:-1])
        value[inner] = self.pairs(symbols[inner], symbols[inner + 1])
        done: list[tuple[np.ndarray, ...]] = []
        while len(starts):
            best = np.minimum.reduceat((value >> PIECE_BITS << 32) | np.arange(len(value)), starts)
            going = best < NO_PAIR >> PIECE_BITS << 32
            if not going.all():
                sizes = np.diff(np.r_[starts, len(symbols)])
                stays = np.repeat(going, sizes)
                done.append((text[~stays], symbols[~stays], first[~stays]))
                shift = np.cumsum(~stays)  # places lost before each one that stays
                best, sizes = best[going], sizes[going]
                at = (best & 0xFFFFFFFF) - shift[best & 0xFFFFFFFF]
                symbols, first, text, value = symbols[stays], first[stays], text[stays], value[stays]
                starts = np.cumsum(sizes) - sizes
            else:
                at = best & 0xFFFFFFFF
            if not len(starts):
                break
            symbols[at] = value[at] & ((1 << PIECE_BITS) - 1)
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, first, text, value = symbols[keep], first[keep], text[keep], value[keep]
            nth = np.arange(len(starts))  # each text loses one place
            starts, at = starts - nth, at - nth
            last = np.r_[starts[1:], len(symbols)] - 1
            value[last] = NO_PAIR
            new = np.r_[at[at > starts] - 1, at[at < last]]
            value[new] = self.pairs(symbols[new], symbols[new + 1])
        of, symbols, first = (np.concatenate(c) for c in zip(*done))
        order = np.argsort(of, kind="stable")
        return symbols[order], chars[first[order]], np.bincount(of, minlength=len(texts))

    def learn(self, stretches: list[str]) -> None:
        """Encode stretches and compare them with the library's ids."""
        short = [s for s in stretches if len(s) <= ARRAY_CHARS]
        if short:
            symbols, chars, sizes = self.merged_all(short)
            other = np.flatnonzero(symbols >= self.n)
            pieces = {c: [self.bytes[b] for b in chr(c).encode()] for c in np.unique(chars[other]).tolist()}
            counts = np.ones(len(symbols), np.int64)
            counts[other] = [len(pieces[c]) for c in chars[other].tolist()]
            ends, ids = np.cumsum(counts), np.repeat(symbols, counts)
            for end, c in zip(ends[other].tolist(), chars[other].tolist()):
                ids[end - len(pieces[c]) : end] = pieces[c]
            raw, at = ids.astype("<u4").tobytes(), 4 * np.r_[0, ends][np.r_[0, np.cumsum(sizes)]]
            self.seen.update(zip(short, (raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist()))))
        for s in stretches:
            if len(s) > ARRAY_CHARS:
                ids = [i for symbol in self.merged(s) for i in ([self.ids[symbol]] if symbol in self.ids else [self.bytes[b] for b in symbol.encode()])]
                self.seen[s] = np.array(ids, "<u4").tobytes()
        joined = [s for s in stretches if self.apart and not s.endswith(MARK)]
        for i in range(0, len(joined), COMPARED):
            self.compare(joined[i : i + COMPARED])
        for s in stretches:
            if not self.apart or s.endswith(MARK):
                self.compare([s])

    def compare(self, stretches: list[str]) -> None:
        """Note the stretches for which the library has other ids; as a rule it has the same for all of them in a row."""
        lead = "a" * self.apart  # a stretch's own mark then stands behind a character, as it does in texts
        theirs = self.library.encode(lead + "".join(stretches))[len(self.library.encode(lead)) :]
        if np.array(theirs, "<u4").tobytes() == b"".join(map(self.seen.__getitem__, stretches)):
            return
        if len(stretches) > 1:
            half = len(stretches) // 2
            self.compare(stretches[:half])
            self.compare(stretches[half:])
        else:
            self.differing.update(stretches)

    def stretches(self, text: str) -> list[str]:
        if not self.apart:
            return [text]
        normal = self.library.normalize(text)
        if MARK * 2 in normal or normal.endswith(MARK):
            return STRETCHES.findall(normal)
        return [MARK + s for s in normal.split(MARK)[1:]]

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """Ids of each text with begin and end, as little-endian unsigned 32-bit integers, and whether the library agrees."""
        parts = [self.stretches(t) for t in texts]
        wanted = {s for p in parts for s in p}
        new = wanted - self.seen.keys()
        if len(self.seen) + len(new) > KEPT:
            self.seen.clear()
            self.differing.clear()
            new = wanted
        if new:
            self.learn(list(new))
        get = self.seen.__getitem__
        return [(b"".join([self.begin, *map(get, p), self.end]), not self.differing or self.differing.isdisjoint(p)) for p in parts]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


ENCODED = "doc_id bigint, n_tokens bigint, ids binary, decoded string, agrees boolean"


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """One row per document: its ids as little-endian unsigned 32-bit integers, their count, what they decode to, and
    whether the library has the same ids. ``model`` is the vocabulary's path, the same on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in arrays.slices(batches, "text", SLICE_BYTES):
            texts = [(t or b"").decode(errors="replace") for t in batch.column("text").cast(pa.binary()).to_pylist()]
            ids, agrees = zip(*v.encode(texts))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                pa.array([v.library.decode(np.frombuffer(x, "<u4").tolist()) for x in ids], pa.string()), pa.array(agrees, pa.bool_()),
            ], ["doc_id", "n_tokens", "ids", "decoded", "agrees"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ENCODED)
