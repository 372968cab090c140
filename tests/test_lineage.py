"""Checkpoints and their removal."""

from __future__ import annotations

import os
from datetime import datetime
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from pricetide import schemas
from pricetide.operators import ingest
from pricetide.operators.ordering import numbered
from pricetide.plans import review
from pricetide.sources import lineage


def folder(frame):
    return urlparse(frame._jdf.queryExecution().logical().rdd().getCheckpointFile().get()).path


def test_spent_frames_are_deleted_and_settled_ones_stay(spark):
    outside = lineage.cut(spark.range(10))
    with lineage.scratch():
        inner = lineage.cut(spark.range(20))
        with lineage.scratch():
            deeper = lineage.cut(inner.select("id"))
            handed = lineage.settled(deeper.filter("id > 5"))
        assert not os.path.exists(folder(deeper)) and os.path.exists(folder(handed))
        result = lineage.settled(handed.agg(F.count("*").alias("n")))
    assert not os.path.exists(folder(inner)) and not os.path.exists(folder(handed))
    assert result.first()["n"] == 14 and outside.count() == 10
    lineage.release(outside)
    assert not os.path.exists(folder(outside))


def test_spent_frames_are_deleted_after_a_failure(spark):
    with pytest.raises(ValueError), lineage.scratch():
        made = lineage.cut(spark.range(3))
        raise ValueError
    assert not os.path.exists(folder(made))


def test_places_follow_the_order(spark):
    frame = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v")).repartition(7)
    placed = numbered(frame, [F.col("v").desc()], "place").union(spark.createDataFrame([], "v bigint, place bigint")).collect()
    assert sorted((r["place"], r["v"]) for r in placed) == list(enumerate(sorted((r["v"] for r in placed), reverse=True), 1))


def kept(spark):
    return set(os.listdir(urlparse(spark.sparkContext.getCheckpointDir()).path))


def test_stored_frames_keep_rows_and_are_deleted(spark):
    frame = spark.range(50).select("id", F.create_map(F.lit("k"), F.col("id").cast("string")).alias("m"), F.lit(None).cast("string").alias("none"))
    before = kept(spark)
    made = lineage.stored(frame)
    assert sorted(made.collect(), key=lambda r: r["id"]) == frame.collect() and made.columns == frame.columns
    assert lineage.stored(frame.filter("id < 0")).count() == 0
    (at,) = [n for n in kept(spark) - before if os.path.basename(made._stored_at) == n]
    lineage.release(made)
    assert at not in kept(spark)
    with lineage.scratch():
        result = lineage.settled(lineage.stored(frame).select("id"), lineage.stored)
    assert result.count() == 50


def test_a_merge_keeps_its_snapshots_plan_and_history_only(spark):
    row = dict(name="ASUS GeForce RTX 5070 Ti OC 16GB", price=9.0, status="available", retailer_id=1, category_id=1, category_name="Graphics Cards", run_id="r")
    full = [{**row, "url": f"https://r/{i % 3}", "seq": i} for i in range(6)] + [{**row, "url": "https://r/0", "seq": 3, "price": 7.0}]
    batch = spark.createDataFrame([[r.get(f.name) for f in schemas.SNAPSHOTS] for r in full], schemas.SNAPSHOTS)
    before = kept(spark)
    done = ingest.ingest_batch(schemas.empty_catalog(spark), batch, as_of=datetime(2026, 1, 1), compare_new=False)
    left = kept(spark) - before
    assert len(left) == 3 and all(n.startswith("stored-") for n in left), left
    assert done.catalog.offers.count() == 3 and done.results.count() == 6
    # of the two snapshots with one sequence number the greater row, by its text, stays
    assert [(r["price"], r["problem"]) for r in done.rejected.collect()] == [(7.0, "repeated_sequence")]


def test_a_stored_frame_that_outgrows_a_join_is_dealt_by_its_key(spark, monkeypatch):
    kept = lineage.stored(spark.range(100).select("id", F.lit("x").alias("text")))
    plan = lambda: spark.range(10).join(lineage.grown(kept), "id")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan()
    monkeypatch.setattr(lineage, "CARRIED_ROWS", 99)
    assert "SortMergeJoin" in plan() and "Broadcast" not in plan()


def test_review_candidates_carry_no_table_through_the_driver(spark, seed, monkeypatch):
    want = sorted(map(repr, review.decision_candidates(seed).collect()))
    monkeypatch.setattr(lineage, "CARRIED_ROWS", 0)
    out = review.decision_candidates(seed)
    assert sorted(map(repr, out.collect())) == want and want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") >= 4, plan
