"""Piece encoding against a plain merge loop, the library and round trips."""

from __future__ import annotations

import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest

from pricetide.llm import pieces
from tests.llm.common import AWKWARD, by_id, documents, prose

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.vocabulary(MODEL)


def library_ids(v, texts):
    return [np.array(x, "<u4").tobytes() for x in v.library.encode(texts, add_bos=True, add_eos=True, num_threads=1)]


def plain_ids(v, text):
    """Merge the best pair of the whole text, the leftmost of equals, until there is none."""
    symbols = list(v.library.normalize(text))
    while pairs := [(-v.scores[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in v.scores]:
        i = min(pairs)[1]
        symbols[i : i + 2] = ["".join(symbols[i : i + 2])]
    ids = [i for s in symbols for i in ([v.ids[s]] if s in v.ids else [v.bytes[b] for b in s.encode()])]
    return np.array([v.library.bos_id(), *ids, v.library.eos_id()], "<u4").tobytes()


ODD = ["", " ", "   ", "a", " a  b ", "▁", "▁▁x▁", "a▁b\0c\r\n", "<s></s><unk><0x0A>", "ﬁ Å Å é", "漢字かな😀‍😀", "﻿x", "0123456789 " * 9,
       "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "слово " * 30, "\t\t\t\n\n  \n"]


def mixed(seed, n):
    rng = random.Random(seed)
    signs = [*"abc theing▁  \n\t\0é漢ß😀ﬁ<s>0x0A19.,-_AZ", "▁▁", "</s>", "\r\n", "     "]
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_agenda_equals_the_plain_loop_and_the_library(vocabulary):
    texts = ODD + mixed(1, 400) + [prose(3, 60)]
    ours = vocabulary.encode(texts)
    assert [x for x, _ in ours] == library_ids(vocabulary, texts) and all(ok for _, ok in ours)
    assert [x for x, _ in ours] == [plain_ids(vocabulary, t) for t in texts]


def test_long_texts_one_agenda_and_a_full_table(vocabulary, monkeypatch):
    unbroken = "".join(random.Random(2).choice("abcdefgh") for _ in range(20_000))
    texts = [unbroken, prose(4, 40_000, 5000), *mixed(5, 2000)]
    theirs = library_ids(vocabulary, texts)
    assert [x for x, _ in vocabulary.encode(texts)] == theirs
    monkeypatch.setattr(pieces, "KEPT", 50)
    for text, ids in zip(texts, theirs):
        assert vocabulary.encode([text]) == [(ids, True)]
    monkeypatch.setattr(vocabulary, "apart", False)
    monkeypatch.setattr(vocabulary, "stretches", lambda t: [vocabulary.library.normalize(t)] if t else [])
    vocabulary.seen.clear()
    assert [x for x, _ in vocabulary.encode(texts[2:500])] == theirs[2:500]
    vocabulary.seen.clear()
    vocabulary.differing.clear()


def test_a_difference_is_found(vocabulary, monkeypatch):
    monkeypatch.setattr(vocabulary, "seen", {})
    monkeypatch.setattr(vocabulary, "differing", set())
    vocabulary.encode(["one two three"])
    vocabulary.seen["▁two"] = b"\x05\0\0\0"
    vocabulary.compare(["▁one", "▁two", "▁three"])
    assert vocabulary.differing == {"▁two"}
    assert [ok for _, ok in vocabulary.encode(["one", "two", "one two"])] == [True, False, False]


def test_rows(spark, vocabulary):
    rows = AWKWARD + [(950, " lead  and trail "), (951, "\0"), (951, "other text of one id")]
    found = by_id(pieces.encoded(documents(spark, rows), MODEL))
    assert sum(map(len, found.values())) == len(rows) and len(found[907]) == 2 == len(found[951])
    for doc_id, text in rows:
        ids = library_ids(vocabulary, [text or ""])[0]
        same = [r for r in found[doc_id] if r["ids"] == ids]
        assert same and all(r["agrees"] and r["n_tokens"] == len(ids) // 4 for r in same)
        assert same[0]["decoded"] == vocabulary.library.decode(np.frombuffer(ids, "<u4").tolist())
        if text and not text.startswith(" "):
            assert same[0]["decoded"] == text
    assert pieces.encoded(documents(spark, []), MODEL).count() == 0


def test_query_digests(spark, tmp_path, vocabulary):
    from pricetide.llm.queries import op12_pieces

    documents(spark, AWKWARD).write.parquet(str(tmp_path / "documents.parquet"))
    found = by_id(op12_pieces(spark, str(tmp_path)))
    for doc_id, text in AWKWARD:
        ids = library_ids(vocabulary, [text or ""])[0]
        assert {r["ids_sha256"] for r in found[doc_id]} == {sha256(ids).hexdigest()}
        decoded = vocabulary.library.decode(np.frombuffer(ids, "<u4").tolist())
        assert {r["decoded_sha256"] for r in found[doc_id]} == {sha256(decoded.encode()).hexdigest()}
