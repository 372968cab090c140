"""Best-fit decreasing packing of tokenized documents into fixed windows.

A document is tokenized, closed by an end id and cut: full windows first, the rest as one shorter piece. Pieces are dealt
to lanes of bounded size by a hash, in which every row has a salt of its own so that repeated rows spread; inside a lane they are placed in decreasing length, each into the open window with
the least room that still holds it. A segment tree over the remaining room finds that window in ``log2(window)`` steps.

Defined results: a null or empty text is its end id alone; repeated rows are packed each; ties of length are broken by
document and start; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm.arrays import slices, words
from pricetide.sources.lineage import cut

WINDOW = 4096
END_ID = 2
LANE_PIECES = 16384
CACHED_WORDS = 1_200_000
UNITS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+([!-&(-/:-@\[-`{-~]*)")
#: bytes of ASCII letters, digits and white space, and of the characters whose first UTF-8 byte is C3
NOT_MARKS = bytes([*b" \t\n\r\x0b\x0c0123456789", *range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3])
PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
PLACED = f"{PIECE}, sequence_id bigint, offset bigint"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordIds:
    """Packed ids of each word between ASCII white space: the tokenizer never joins across it, so words can be reused.

    The tokenizer lowers letters and parts letters from the punctuation after them. Texts of plain letters, digits and
    single stops and commas are lowered and parted beforehand, which leaves fewer different words to encode; all other
    texts go word by word as they are. Words are told apart by 64-bit hashes; each different one of a slice is looked up
    once, and the ids of the slice are then gathered as arrays.
    """

    def __init__(self, path: str):
        self.known: dict[int, bytes] = {}
        self.tokenizer = _tokenizer(path)
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for token, i in vocab.items() if token.endswith("</w>")]] = True

    def normalized(self, text: str) -> bytes:
        raw = text.encode()
        marks = raw.translate(None, NOT_MARKS)
        if marks.translate(None, b".,") or any(m in raw for m in (b",,", b"..", b",.", b".,", b"\xc3\x97", b"\xc3\xb7")):
            return raw
        return raw.lower().replace(b",", b" , ").replace(b".", b" . ")

    def learn(self, hashes: list[int], texts: list[bytes]) -> None:
        plain, rest = [], []
        for h, text in zip(hashes, texts):
            m = UNITS.fullmatch(text)
            (plain if m else rest).append((h, text, 1 + bool(m and m[1])))
        for i in range(0, len(plain), 2000):
            # letters are one unit for the tokenizer, the marks after them another, and the last id of a unit says so
            some = plain[i : i + 2000]
            ids = np.array(self._encode([b" ".join([w for _, w, _ in some])])[0], "<u4")
            ends = np.flatnonzero(self.last[ids])[np.cumsum([n for *_, n in some]) - 1] + 1
            packed, at = ids.tobytes(), 0
            for (h, _, _), end in zip(some, (4 * ends).tolist(), strict=True):
                self.known[h] = packed[at:end]
                at = end
        for (h, _, _), ids in zip(rest, self._encode([w for _, w, _ in rest])):
            self.known[h] = np.array(ids, "<u4").tobytes()

    def _encode(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def pack(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        w = words(pa.array([self.normalized(t or "") for t in texts], pa.large_binary()))
        if not len(w.hashes):
            return [b""] * len(texts)
        order = np.argsort(w.hashes)
        ordered = w.hashes[order]
        first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        which = np.empty(len(order), np.int32)
        which[order] = np.cumsum(first) - 1
        different, example = ordered[first].tolist(), order[first]
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        new = [i for i, h in enumerate(different) if h not in self.known]
        raw = w.data.tobytes()
        bounds = zip(w.starts[example[new]].tolist(), w.ends[example[new]].tolist())
        self.learn([different[i] for i in new], [raw[a:b] for a, b in bounds])
        parts = [self.known[h] for h in different]
        of, bits = w.of.tolist(), which.tolist()
        return [b"".join(map(parts.__getitem__, bits[a:b])) for a, b in zip(of, of[1:])]


@lru_cache(maxsize=2)
def _word_ids(path: str) -> WordIds:
    """Kept by a worker for its later tasks."""
    return WordIds(path)


def token_pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document: full windows, then the rest."""
    closing = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out: list[tuple] = []
            packed_texts = _word_ids(tokenizer).pack(batch.column("text").to_pylist())
            for doc_id, packed in zip(batch.column("doc_id").to_pylist(), packed_texts):
                packed += closing
                total = len(packed) // 4
                for start in range(0, total, window):
                    piece = packed[4 * start : 4 * (start + window)]
                    out.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), total))
            kinds = [("doc_id", pa.int64()), *((n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens"))]
            columns = list(zip(*out)) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], [n for n, _ in kinds])

    return docs.select("doc_id", "text").mapInArrow(run, PIECE)


class TightestRoom:
    """Segment tree over remaining room 1..window; a leaf holds the open windows with exactly that room."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.used = [0] * (2 * self.size)
        self.open: dict[int, list[int]] = {}

    def add(self, room: int, which: int) -> None:
        self.open.setdefault(room, []).append(which)
        i = room + self.size
        while i:
            self.used[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The open window with the least room of at least ``need``."""
        used, i = self.used, need + self.size
        if not used[i]:
            while i > 1 and (i & 1 or not used[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i *= 2
                if not used[i]:
                    i += 1
        room = i - self.size
        while i:
            used[i] -= 1
            i >>= 1
        return room, self.open[room].pop()


def place(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """Window and offset of each length, given in decreasing order."""
    tree, count = TightestRoom(window), 0
    which, offsets = [], []
    for n in lengths:
        found = tree.take(n) if n < window else None
        if found is None:
            room, at = window, count
            count += 1
        else:
            room, at = found
        which.append(at)
        offsets.append(window - room)
        if room > n:
            tree.add(room - n, at)
    return which, offsets


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, lane_pieces: int = LANE_PIECES) -> DataFrame:
    """One row per piece with its window and offset. Lanes follow from the piece count, so a task's memory is bounded."""
    pieces = cut(token_pieces(docs, tokenizer, window, end_id))
    lanes = max(1, -(-pieces.count() // lane_pieces))

    def lane(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        which, offsets = place(table.column("length").to_pylist(), window)
        base = key[0].as_py() << 32
        table = table.append_column("sequence_id", pa.array([base + w for w in which], pa.int64()))
        return table.append_column("offset", pa.array(offsets, pa.int64())).drop_columns(["__lane"])

    # places in the checkpointed pieces stay the same when a task is rerun
    dealt = pieces.withColumn("__lane", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(lanes)))
    return dealt.groupBy("__lane").applyInArrow(lane, PLACED)
