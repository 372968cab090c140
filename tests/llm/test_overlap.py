"""Near duplicates, substrings and benchmark overlaps against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random

import numpy as np
import pytest

from pricetide.llm import arrays, decontaminate, minhash, substrings
from pricetide.llm import components as component_steps
from pricetide.llm.components import components
from tests.llm.common import ALNUM, ASCII_LOWER, AWKWARD, SPACE, by_id, documents, prose


def edited(text: str, edits: int, seed: int) -> str:
    rng, words = random.Random(seed), text.split()
    for i in rng.sample(range(len(words)), edits):
        words[i] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def test_word_hashes_depend_on_the_word_alone():
    import pyarrow as pa

    texts = ["Straße a b", None, "", "b", "b a" * 200_000, "\x0bb\x1ea"]
    w = arrays.words(pa.array(texts))
    words = [x for t in texts for x in SPACE.findall(t or "")]
    assert w.of.tolist() == [0, *itertools.accumulate(len(SPACE.findall(t or "")) for t in texts)]
    of = {}
    for word, h in zip(words, w.hashes.tolist()):
        assert of.setdefault(word, h) == h
    assert len(set(of.values())) == len(of)


def near_rows():
    rows = [(i, prose(1000 + i, 40 + 13 * (i % 9))) for i in range(60)]
    base = prose(77, 160)
    rows += [(200 + i, edited(base, i % 12, i)) for i in range(60)]  # from equal to too different, around one text
    rows += [(300 + i, base) for i in range(25)]
    chain = base
    for i in range(12):  # neighbours are alike, the ends are not
        chain = edited(chain, 2, 500 + i)
        rows.append((400 + i, chain))
    return rows + [(500, "only three words"), (501, "ONLY three  words"), (502, "only three")] + AWKWARD


def expected_groups(rows, least=85):
    sets = []
    for _, text, *_ in rows:
        words = SPACE.findall((text or "").translate(ASCII_LOWER))
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    parent = {d: d for d, *_ in rows if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2):
        if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= least * len(a | b):
            x, y = find(rows[i][0]), find(rows[j][0])
            parent[max(x, y)] = min(x, y)
    return [(d, len(s), None if d is None else find(d)) for (d, *_), s in zip(rows, sets)]


def test_near_duplicates(spark):
    rows = near_rows()
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(documents(spark, rows)).collect()), key=str)
    assert got == sorted(expected_groups(rows), key=str)
    kept = {r["doc_id"] for r in minhash.near_duplicates(documents(spark, rows)).filter("kept").collect()}
    assert kept == {d for d, _, c in expected_groups(rows) if d == c}


def test_near_duplicates_by_prefixes(spark, monkeypatch):
    """Buckets that count as large, and small tasks, give the same groups."""
    monkeypatch.setattr(minhash, "SMALL", 2)
    monkeypatch.setattr(minhash, "TASK_PARTNERS", 3)
    rows = near_rows()[60:160]
    got = sorted((r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(documents(spark, rows)).collect())
    assert got == sorted((d, c) for d, _, c in expected_groups(rows))


def loose_sets(n, size, rng):
    """Sets around one base, from equal to half of it replaced, some by members that a few of them share."""
    base, spare = rng.integers(1 << 40, size=size), rng.integers(1 << 40, size=40)
    out = []
    for _ in range(n):
        edits = rng.integers(size // 2)
        new = np.r_[spare[rng.integers(40, size=edits // 4)], rng.integers(1 << 40, size=edits - edits // 4)]
        out.append(set(np.r_[rng.permutation(base)[: size - edits + rng.integers(3)], new].tolist()))
    return out


@pytest.mark.parametrize("least", [85, 80])
def test_prefix_join_finds_every_similar_pair(spark, least):
    rng = np.random.default_rng(least)
    sets = loose_sets(150, 60, rng) + loose_sets(60, 12, rng) + [set(range(k)) for k in range(1, 30)]
    group = [int(g) for g in rng.integers(len(sets) // 2, size=len(sets))]
    rows = spark.createDataFrame([(r, group[r], len(s), x) for r, s in enumerate(sets) for x in s], "rep bigint, group bigint, n bigint, shingle bigint")
    found = {(r["a"], r["b"]) for r in minhash.prefix_pairs(rows, least).distinct().collect()}
    pairs = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if group[i] != group[j]]
    similar = {(i, j) for i, j in pairs if 100 * len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])}
    assert len(similar) > 50 and similar <= found


def test_prefix_join_grows_with_the_members(spark):
    """Loose copies of one text, each a group: pairs met, and pairs kept, stay far under the square."""
    met = []
    for n in (200, 800):
        rng = np.random.default_rng(1)
        base = rng.integers(1 << 40, size=146)
        sets = [set(np.r_[rng.permutation(base)[: 146 - 14 - k % 40], rng.integers(1 << 40, size=14 + k % 40)].tolist()) for k in range(n)]
        rows = spark.createDataFrame([(r, r, len(s), x) for r, s in enumerate(sets) for x in s], "rep bigint, group bigint, n bigint, shingle bigint")
        met.append(minhash.prefix_pairs(rows, 85).count())
    assert met[1] <= 800


def test_no_near_duplicates(spark):
    assert minhash.near_duplicates(documents(spark, [])).count() == 0
    got = by_id(minhash.near_duplicates(documents(spark, [(1, None), (2, "")])))
    assert got[1][0]["component_id"] == 1 and got[2][0]["component_id"] == 2 and got[1][0]["kept"]


def test_sketch_bound_keeps_similar_sets(spark):
    """Sets at exactly the least similarity stay well under the bound, and clearly different ones lie over it."""
    rng = np.random.default_rng(3)
    for n in (20, 150, 1500, 8000):
        bound = spark.range(1).select(minhash.most_bits(minhash.F.lit(n), minhash.F.lit(n))).first()[0]
        for similar, j in ((True, 0.85), (False, 0.5)):
            seen = []
            for _ in range(20):
                d = int(n * (1 - j) / (1 + j))
                pool = rng.integers(0, 1 << 63, n + d, np.uint64) * np.uint64(2)
                a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[: n - d], pool[n:]]))
                seen.append(int(np.bitwise_count((minhash.odd_sketch(a) ^ minhash.odd_sketch(b)).view(np.uint64)).sum()))
            assert max(seen) < bound if similar else n < 100 or min(seen) > bound


def test_pipeline_stage_links_pairs_from_080_on(spark):
    """Copies of similarity 0.80 to 0.85, which the op3 contract leaves apart, are reduced by the stage as brute force does."""
    import corpus_pipeline

    rows = [(i, prose(5000 + i, 60 + 7 * i, 4000)) for i in range(40)]
    for i in range(40):
        words = rows[i][1].split()
        n = len(words)
        rows.append((100 + i, " ".join(words[: n - round(n * (0.14 + 0.002 * i))])))  # a copy shortened
        rows.append((200 + i, " ".join([*words[:20], "changed", *words[21:40], *["changed"] * (i % 2), *words[40 + i % 2 :]])))
    exact = [f"x{i}" for i in range(94)]  # 90 shingles; 80 of them in the copy of 80 + 4 words, 72 in that of 76
    rows += [(300, " ".join(exact)), (301, " ".join(exact[:76])), (302, " ".join([f"y{i}" for i in range(94)])), (303, " ".join([f"y{i}" for i in range(75)]))]
    want = {d for d, _, c in expected_groups(rows, 80) if d == c}
    at_85 = {d for d, _, c in expected_groups(rows, 85) if d == c}
    kept = corpus_pipeline.drop_near_duplicates(spark, documents(spark, rows), "")
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == want
    assert len(at_85 - want) > 20 and 301 not in want and 301 in at_85 and 303 in want


@pytest.mark.parametrize("j", [0.80, 0.82])
def test_sketch_bound_at_lower_similarity(spark, j):
    rng = np.random.default_rng(5)
    for n in (20, 150, 1500, 8000):
        bound = spark.range(1).select(minhash.most_bits(minhash.F.lit(n), minhash.F.lit(n), 80)).first()[0]
        d = int(n * (1 - j) / (1 + j))
        for _ in range(40):
            pool = rng.integers(0, 1 << 63, n + d, np.uint64) * np.uint64(2)
            a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[: n - d], pool[n:]]))
            assert int(np.bitwise_count((minhash.odd_sketch(a) ^ minhash.odd_sketch(b)).view(np.uint64)).sum()) < bound


def test_components(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(100, 140)]
    links = chain + [(500, 500 + i) for i in range(1, 60)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)] + [(7, 7), (8, 9), (9, 8)]
    parent = {x: x for link in links for x in link}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()}
    want = {x: find(x) for link in links for x in link if link[0] != link[1]}
    assert got == {x: c for x, c in want.items() if x != c}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_few_links_are_worked_off_in_one_partition(spark, monkeypatch):
    rows = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    links = spark.createDataFrame(rows, "a bigint, b bigint").repartition(4)
    parts, cut = [], component_steps.cut
    monkeypatch.setattr(component_steps, "cut", lambda frame: parts.append(cut(frame)) or parts[-1])
    few = sorted(map(tuple, components(links, "a", "b").collect()))
    assert len(parts) > 1 and all(p.rdd.getNumPartitions() == 1 for p in parts[-1:])
    monkeypatch.setattr(component_steps, "FEW", 0)
    assert sorted(map(tuple, components(links, "a", "b").collect())) == few == sorted(
        [(i, 0) for i in range(1, 41)] + [(100 + i, 100) for i in range(1, 30)])


def expected_removal(rows, window=13):
    first = {}
    texts = [(d, SPACE.findall(t or "")) for d, t, *_ in rows]
    for d, words in texts:
        if d is not None:
            for i in range(len(words) - window + 1):
                key = tuple(words[i : i + window])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, words in texts:
        gone = set()
        for i in range(len(words) - window + 1):
            if d is not None and first[tuple(words[i : i + window])] < d:
                gone |= set(range(i, i + window))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((d, len(words), len(words) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("task_documents", [512, 2])
def test_substrings(spark, monkeypatch, task_documents):
    monkeypatch.setattr(substrings, "TASK_DOCUMENTS", task_documents)
    passage, other = prose(5, 40), prose(6, 13)
    rows = [(i, f"{prose(2000 + i, 30)} {passage if i % 2 else other} {prose(3000 + i, 25)}") for i in range(30)]
    rows += [(100 + i, edited(prose(2000, 120), i, i)) for i in range(20)]
    rows += [(200, passage), (201, "W1 " + passage + "\n" + passage), (202, " ".join(passage.split()[:12])), (203, " ".join(passage.split()[3:16]))]
    rows += [(300 + i, "ab " * (11 + i)) for i in range(6)] + [(400 + i, prose(40 + i, 60, vocabulary=3)) for i in range(12)]
    rows += [(310, passage), (310, other + " tail")] + AWKWARD
    cleaned = substrings.removed_words(documents(spark, rows))
    got = [(r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"]).hexdigest()) for r in cleaned.collect()]
    assert sorted(got, key=str) == sorted(expected_removal(rows), key=str)
    assert substrings.removed_words(documents(spark, [])).count() == 0


def test_suffix_automaton():
    rng = random.Random(9)
    for _ in range(60):
        passages = [[rng.choice("abc") for _ in range(rng.randrange(1, 15))] for _ in range(3)]
        words = [rng.choice("abcd") for _ in range(20)]
        automaton = substrings.SuffixAutomaton()
        for p in passages:
            automaton.add(p)
        runs = {tuple(p[i:j]) for p in passages for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
        want = [max([0, *(n for n in range(1, e + 1) if tuple(words[e - n : e]) in runs)]) for e in range(1, len(words) + 1)]
        assert automaton.statistics(words) == want


def test_masks_hit_every_run_with_three_differences():
    for differing in itertools.combinations(range(decontaminate.OVERLAP), decontaminate.OVERLAP - decontaminate.AGREE):
        assert any(not set(differing) & {at + i for i in mask} for mask in decontaminate.MASKS
                   for at in range(decontaminate.OVERLAP - decontaminate.SPAN + 1))


def test_items_of_eight_words_with_one_difference(spark):
    """Any one of the words may differ, the first and the last too."""
    items = [(n, prose(600 + n, n)) for n in (7, 8, 9, 13)]
    rows = []
    for n, item in items:
        for i in range(n):
            words = item.split()
            words[i] = "differs"
            rows.append((100 * n + i, f"{prose(n, 20)} {' '.join(words)} {prose(n + 50, 20)}"))
    rows += [(9000, " ".join(items[1][1].split()[1:])), (9001, " ".join(items[1][1].split()[:-1])), (9002, " ".join(items[1][1].split()[1:-1]))]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(documents(spark, rows), benchmark).collect()}
    assert got == expected_overlaps(rows, items)
    assert {(800 + i, 8) for i in range(8)} | {(9000, 8), (9001, 8)} <= got and (9002, 8) not in got


def expected_overlaps(rows, items):
    out = set()
    for (d, text, *_), (i, item) in itertools.product(rows, items):
        a, b = (ALNUM.findall((t or "").translate(ASCII_LOWER)) for t in (text, item))
        if d is None or i is None or len(b) < decontaminate.LEAST_WORDS:
            continue
        n = min(decontaminate.OVERLAP, len(b))
        need = decontaminate.AGREE if n == decontaminate.OVERLAP else n - (n - 5) // 3
        if len(b) < decontaminate.SPAN:
            need = n
        for s in range(len(b) - n + 1):
            for k in range(-n, len(a)):  # words beyond the document differ
                if sum(0 <= k + j < len(a) and a[k + j] == b[s + j] for j in range(n)) >= need:
                    out.add((d, i))
    return out


def test_overlaps(spark):
    items = [(1, prose(1, 30)), (2, prose(2, 45).upper()), (3, "five short words stand here"), (4, "too short"), (5, None), (None, prose(3, 20)), (2, prose(2, 45).upper()),
             (6, prose(8, 14))]
    body = lambda s: prose(9000 + s, 25)
    rows = [(1, f"{body(1)} {items[0][1]} {body(2)}"), (2, f"{body(3)} {edited(items[0][1], 3, 1)}"), (3, " ".join(items[1][1].lower().split()[10:23])),
            (4, body(4) + " Five, short: WORDS stand here! " + body(5)), (5, body(6)), (6, " ".join(items[0][1].split()[:11])), (7, "too short"),
            (8, edited(" ".join(items[1][1].split()[:13]), 3, 2)), (9, edited(" ".join(items[1][1].split()[:13]), 4, 2)), (10, items[5][1]),
            (11, edited(items[7][1], 2, 4)), *AWKWARD]
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(documents(spark, rows), benchmark).collect()}
    assert got == expected_overlaps(rows, items)
    assert {(1, 1), (2, 1), (3, 2), (4, 3), (8, 2)} <= got and (9, 2) not in got and (6, 1) in got
    assert decontaminate.overlaps(documents(spark, []), benchmark).count() == 0
    assert decontaminate.overlaps(documents(spark, rows), benchmark.limit(0)).count() == 0
