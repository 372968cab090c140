"""The registered merge queries do the whole merge, and what it takes at size."""

from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import NOW
from pricetide import schemas
from pricetide.operators import ingest
from test_ingest import snaps
from workload import adapter, job_queries  # noqa: F401
from workload.registry import QUERIES

#: parts whose titles differ by two digits
ALIKE = [1, 37, 73]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """One retailer's snapshots of three processors, in the order of their keys, and a case."""
    row = lambda n, part: (n, part, 4, 1, 2.0, 100.0 + n, 0.0, 0.1, "N", "O", datetime(1998, 1, n))
    made = tmp_path_factory.mktemp("lines")
    kinds = adapter.TEST_TABLES["lineitem"].replace("l_shipdate timestamp_ntz", "l_shipdate timestamp")
    rows = [row(n, part) for n, part in enumerate([*ALIKE, 6], 1)]
    spark.createDataFrame(rows, kinds).withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz")).write.parquet(f"{made}/lineitem.parquet")
    return str(made)


def test_merge_queries_compare_the_new_products_of_a_batch(spark, folder):
    made = {r.canonical_name for r in QUERIES["ingest_products"](spark, folder).collect()}
    # the third processor is close enough to an earlier one
    assert made == {f"AMD Ryzen 5 {n}X3D AM5 8-Core Processor" for n in (7001, 7037)} | {"Samsung Dynamic EVO Mid Tower Case"}


def test_nearest_products_equal_all_links(spark):
    rng = random.Random(5)
    nodes = [(f"n{i:03d}", i * 10, (i, f"u{i}"), f"p{i}", rng.choice("abc")) for i in range(40)]
    links = [(a[0], b[0], rng.choice([96.0, 97.5, 99.0]), b[1]) for a in nodes for b in nodes if rng.random() < 0.3]
    frame = spark.createDataFrame(nodes, "node string, place long, at struct<seq:long,url:string>, identity string, name string")
    near = ingest._nearest(spark.createDataFrame(links, "node string, earlier string, score double, product_place long"), frame)
    found = {r.node: [(e.score, tuple(e.made_at), e.made_id) for e in r.near] for r in near.collect()}
    of = {n[0]: n for n in nodes}
    for node, place, *_ in nodes:
        for at in range(place // 10, 41):  # this listing and later ones of its text
            able = [(s, of[b][4], -p, of[b][3]) for a, b, s, p in links if a == node and p < at * 10]
            first = next(((s, m) for s, made_at, m in found.get(node, []) if made_at < (at, f"u{at}")), None)
            assert first == ((max(able)[0], max(able)[3]) if able else None), (node, at)
    assert max(map(len, found.values())) < 12  # not all links


def test_only_snapshots_that_share_a_key_are_dealt_by_it(spark, monkeypatch):
    start, asked, ranked = schemas.empty_catalog(spark), [], ingest._without_repeats
    monkeypatch.setattr(ingest, "_without_repeats", lambda rows: asked.append(rows.count()) or ranked(rows))
    rows = [dict(url=f"https://r1/{i}", seq=i) for i in range(20)]
    assert ingest.ingest_batch(start, snaps(spark, *rows), as_of=NOW).results.count() == 20 and not asked
    again = [*rows, dict(url="https://r1/3", seq=3, name="  z  "), dict(url="https://r1/4", seq=4, price=0.0), dict(url=None, seq=None), dict(url=None, seq=None)]
    batch = snaps(spark, *again)
    found = ingest._checked_once(batch)
    assert asked == [4]
    assert sorted(map(repr, found.collect())) == sorted(map(repr, ingest._checked(batch).collect()))
    assert sorted(r.problem for r in found.collect() if r.problem) == ["repeated_sequence", "repeated_sequence", "suspicious_price"]
