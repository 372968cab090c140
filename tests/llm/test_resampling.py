"""Importance resampling against a plain reading of its definition."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pricetide.llm import resampling
from pricetide.operators.ordering import numbered
from tests.llm.common import ALNUM, ASCII_LOWER, AWKWARD, by_id, documents, prose


def features(text):
    words = ALNUM.findall((text or "").translate(ASCII_LOWER))
    return words, [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


def plain(rows, target):
    s, t = (Counter(bucket(f) for text in texts for f in features(text)[1]) for texts in ([r[1] for r in rows], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    out = []
    for n, (doc_id, text) in enumerate(rows):
        words, found = features(text)
        weight = sum(gain[bucket(f)] for f in found)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(words), len(found), weight, score, None])
    fit = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for rank, r in enumerate(fit[: 5 * len(fit) // 100], 1):
        r[5] = rank
    return out


def test_crcs_of_runs():
    texts = ["one Two  three", None, "", "é漢 x" + "y" * 200 + " z", "a", "b c"]
    w = resampling._words(pa.array(texts))
    found = [[], [], []]
    for k, (crc, there) in enumerate(resampling.run_crcs(w)):
        found[k] = crc[there].tolist()
    expected = [[zlib.crc32(" ".join(words[i : i + k]).encode()) for text in texts for words in [features(text)[0]] for i in range(len(words) - k + 1)]
                for k in (1, 2, 3)]
    assert found == expected
    assert [resampling.CRC[i] for i in (0, 1, 255)] == [0, 0x77073096, 0x2D02EF8D]


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_equals_the_definition(spark, accuracy):
    rng = random.Random(5)
    rows = [(i, prose(i, rng.randrange(5, 60), 300)) for i in range(600)] + AWKWARD
    rows += [(1000, prose(7, 30, 300))] * 45 + [(None, prose(8, 40, 300))] * 3  # repeated rows at one score
    target = [prose(10_000 + i, 40, 80) for i in range(20)] + [None, ""]
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in enumerate(target)], "item_id bigint, text string, score int")
    found = resampling.resampled(documents(spark, rows).repartition(5), benchmark, accuracy=accuracy).collect()
    expected = plain(rows, target)
    key = lambda r: [(x is not None, x or 0) for x in r]
    assert sorted((list(r) for r in found), key=key) == sorted(expected, key=key)


def test_cutoff_inside_a_group_of_equal_rows(spark):
    rows = [(1, prose(1, 30))] * 300 + [(i, prose(i, 5)) for i in range(2, 40)]
    found = by_id(resampling.resampled(documents(spark, rows), spark.createDataFrame([], "text string")))
    assert sorted(r["rank"] for r in found[1] if r["rank"]) == list(range(1, 16)) and len(found[1]) == 300


def test_bracket_holds_the_cutoff(spark):
    rng = random.Random(3)
    for values in ([rng.randrange(1000) for _ in range(3000)], [7] * 500, [1] * 400 + [9] * 30, list(range(50))):
        scores = spark.createDataFrame([(v,) for v in values], "score bigint")
        for wanted in {1, len(values) // 20 or 1, len(values)}:
            low, high, above = resampling.bracket(scores, wanted, len(values), accuracy=50)
            cutoff = sorted(values, reverse=True)[wanted - 1]
            assert low <= cutoff <= high and above == sum(v > high for v in values)


def test_few_or_no_documents(spark):
    nothing = spark.createDataFrame([], "text string")
    assert resampling.resampled(documents(spark, []), nothing).count() == 0
    assert {r["rank"] for r in resampling.resampled(documents(spark, AWKWARD), nothing).collect()} == {None}


def test_places(spark):
    frame = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v")).repartition(7)
    placed = numbered(frame, [F.col("v").desc()], "place").union(spark.createDataFrame([], "v bigint, place bigint")).collect()
    assert sorted((r["place"], r["v"]) for r in placed) == list(enumerate(sorted((r["v"] for r in placed), reverse=True), 1))
    assert numbered(frame.filter("v < 0"), [F.col("v")], "place").count() == 0


def test_gains_are_whole_numbers():
    assert resampling.gains(np.zeros(10000, np.int64), np.zeros(10000, np.int64)).tolist() == [0] * 10000
