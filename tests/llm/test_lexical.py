"""Block-Max MaxScore against scoring every document."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pricetide.llm import lexical
from tests.llm.common import ASCII_LOWER, AWKWARD, documents, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [t.translate(ASCII_LOWER) for t in TERM.findall(text or "")]


def plain(docs, items, k=50):
    """Sorted (item_id, rank, doc_id, score) by the definition."""
    texts = [(doc_id, terms(t)) for doc_id, t in docs]
    big_n, big_l = sum(bool(t) for _, t in texts), sum(len(t) for _, t in texts)
    df = {}
    for _, t in texts:
        for term in set(t):
            df[term] = df.get(term, 0) + 1
    out = []
    for item_id, text in sorted(set(items), key=str):
        scored = []
        for doc_id, t in texts:
            m, score = 50 + 50 * len(t) * big_n // max(big_l, 1), 0
            for term in set(terms(text)) & set(t):
                w, tf = math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[term] + 1))), t.count(term)
                score += w * (10**9 * tf // (1000 * tf + 20 * m))
            if score > 0:
                scored.append((-score, doc_id is not None, doc_id or 0))
        out += [(item_id, rank, doc if there else None, -score) for rank, (score, there, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def shards_of(docs, size):
    kinds = pa.schema([("n_documents", pa.int64()), ("n_terms", pa.int64()), *[(c, pa.binary()) for c in ("terms", *lexical.PARTS)]])
    for i in range(0, len(docs), size):
        ids, texts = zip(*docs[i : i + size])
        yield pa.RecordBatch.from_pylist([lexical.shard(pa.array(ids, pa.int64()), pa.array(texts, pa.string()))], schema=kinds)


def zipf_docs(n, seed=1):
    rng = random.Random(seed)
    words = [f"t{i}" for i in range(3000)]
    odds = [1 / (i + 1) for i in range(3000)]
    return [(i * 7 % n, " ".join(rng.choices(words, odds, k=rng.choice([3, 20, 60, 200])))) for i in range(n)]


@pytest.fixture(scope="module")
def corpus():
    return zipf_docs(3000)


def in_shards(docs, items, size, k):
    """The shards of one task, one after the other; also how many blocks were read of how many."""
    vocabulary = pa.array(sorted({t.encode() for _, text in items for t in terms(text)}), pa.large_binary())
    place = {t: i for i, t in enumerate(vocabulary.to_pylist())}
    batches = list(shards_of(docs, size))
    n, total = (sum(b.column(c)[0].as_py() for b in batches) for c in ("n_documents", "n_terms"))
    df = np.zeros(len(vocabulary))
    opened = [lexical.Shard(b, 0, vocabulary) for b in batches]
    for s in opened:
        there = s.lists >= 0
        df[there] += s.counts[s.lists[there]]
    weights = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)
    out, read, whole = [], 0, 0
    for s in opened:
        s.weigh(n, total)
    for item_id, text in items:
        own = np.array(sorted({place[t.encode()] for t in terms(text)}), np.int64)
        heap = lexical.Heap(k, np.empty((0, 3), np.int64))
        for s in opened:
            s.opened = 0
            lexical.rank_in_shard(s, own, weights[own], heap)
            lists = s.lists[own][s.lists[own] >= 0]
            read, whole = read + s.opened, whole + int((s.first_block[lists + 1] - s.first_block[lists]).sum())
        out += [(item_id, rank, int(i) if there else None, int(score)) for rank, (score, there, i) in enumerate(heap.rows, 1)]
    return sorted(out, key=str), read, whole


@pytest.mark.parametrize("size,k", [(3000, 10), (170, 10), (700, 50), (64, 3)])
def test_shards_equal_the_definition_and_skip_blocks(corpus, size, k):
    rng = random.Random(size)
    items = [(i, " ".join(f"t{rng.choice([0, 1, 2, 5, 40, 300, rng.randrange(3000)])}" for _ in range(8))) for i in range(12)]
    found, read, whole = in_shards(corpus, items, size, k)
    assert found == plain(corpus, items, k)
    if size < 3000:
        assert read < whole


def test_impacts_bound_every_posting(corpus):
    batch = next(shards_of(corpus, 3000))
    s = lexical.Shard(batch, 0, pa.array([b"t0", b"t1", b"absent"], pa.large_binary()))
    s.weigh(3000, batch.column("n_terms")[0].as_py())
    assert s.lists[2] == -1
    for term in s.lists[:2].tolist():
        found, adds = s.whole(term)
        at, most = s.block_of(term, found)
        assert (adds <= most).all() and {int(m) for m in most} == {int(adds[at == b].max()) for b in set(at.tolist())}
        assert (s.look_up(term, at, found) == adds).all()
        assert found.tolist() == [i for i, (_, t) in enumerate(corpus) if f"t{s.lists.tolist().index(term)}" in t.split()]


def test_widths():
    values = np.array([1, 255, 256, 3, 70_000, 1])
    packed = lexical.packed_lists(values, np.array([0, 0, 1, 1, 2, 2]), np.array([2, 2, 2]), "gap")
    assert packed["gap_kind"].tolist() == [0, 1, 2] and [packed[f"gaps_{k}"].tolist() for k in (1, 2, 4)] == [[1, 255], [256, 3], [70000, 1]]


def rows_of(frame):
    return sorted((tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_search_equals_the_definition(spark, monkeypatch):
    rng = random.Random(9)
    docs = AWKWARD + zipf_docs(500, 4) + [(2000 + i, "same words t1 t2") for i in range(80)] + [(None, "same words t1 t2")] * 2 + [(3000, "tie t9")] * 60
    items = [(1, "same words"), (1, "same words"), (1, "Tie T9 t1"), (2, "nowhere to befound"), (3, ""), (4, None), (None, "t1 t2 same"),
             (5, "Größe слово 漢字 repeated ROW a"), (6, prose(6, 300))]
    items += [(10 + i, " ".join(f"t{rng.randrange(50)}" for _ in range(6))) for i in range(6)]
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, score int")
    expected = plain(docs, items)
    assert rows_of(lexical.ranked(documents(spark, docs).repartition(9), asked)) == expected
    monkeypatch.setattr(lexical, "ITEM_TERMS", 20)  # several blocks of items over one index
    monkeypatch.setattr(lexical, "MERGED", 2)
    assert rows_of(lexical.ranked(documents(spark, docs).repartition(9), asked)) == expected


def test_empty_tables(spark):
    asked = spark.createDataFrame([(1, "one")], "item_id bigint, text string")
    assert lexical.ranked(documents(spark, []), asked).count() == 0
    assert lexical.ranked(documents(spark, [(1, None), (2, "...")]), asked).count() == 0
    assert lexical.ranked(documents(spark, [(1, "one")]), asked.limit(0)).count() == 0
