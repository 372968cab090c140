"""Streaming jobs give what the batch operators give."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from conftest import NOW, table
from pricetide import schemas
from pricetide.operators import changes, ingest
from pricetide.sources import catalog_store
from pricetide.streaming import jobs


def batch(spark, number, rows):
    full = [
        dict(name=f"MSI GeForce RTX {50 + i}70 12GB", url=f"https://r/{i}", price=p, status=s, retailer_id=1, category_id=1,
             category_name="Graphics Cards", seq=number * 100 + n, run_id=f"run{number}")
        for n, (i, p, s) in enumerate(rows)
    ]
    return spark.createDataFrame([[r.get(f.name) for f in schemas.SNAPSHOTS] for r in full], schemas.SNAPSHOTS)


BATCHES = [
    [(0, 10.0, "available"), (1, 20.0, "available"), (0, None, "unavailable"), (0, 10.0, "available")],
    [(0, 10.0, "available"), (1, 21.0, "available"), (2, 5.0, "available")],
]


def land(spark, path):
    for number, rows in enumerate(BATCHES):
        batch(spark, number, rows).coalesce(1).write.mode("append").parquet(path)


def test_change_stream_equals_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for number, rows in enumerate(BATCHES):
        batch(spark, number, rows).coalesce(1).write.mode("append").parquet(src)
        jobs.change_stream(jobs.snapshot_stream(spark, src), out, str(tmp_path / "cp"), slices=4).awaitTermination()
    got = {(r.seq, r.price, r.previous_price) for r in jobs.changed(spark, out).collect()}
    whole = batch(spark, 0, BATCHES[0]).unionByName(batch(spark, 1, BATCHES[1])).withColumn("key", F.col("url"))
    want = changes.follow(whole, spark.createDataFrame([], jobs.STATE), slices=1).filter(changes.is_change())
    assert got == {(r.seq, r.price, r.before.price if r.before else None) for r in want.collect()}
    assert len(got) == 5


def test_ingest_stream_equals_batches(spark, tmp_path):
    start = schemas.empty_catalog(spark).with_tables(categories=table(spark, "categories", [dict(id=1, name="Graphics Cards")]))
    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    catalog_store.publish_first(start, store)
    clock = jobs.fixed_clock(NOW, timedelta(hours=6))
    for number, rows in enumerate(BATCHES):
        batch(spark, number, rows).coalesce(1).write.mode("append").parquet(src)
        jobs.ingest_stream(jobs.snapshot_stream(spark, src), store, str(tmp_path / "cp"), clock=clock, slices=1).awaitTermination()
    streamed = catalog_store.load(spark, store)
    assert catalog_store.current_version(spark, store) == 3
    base = str(tmp_path / "by-hand")
    catalog_store.publish_first(start, base)
    for number, rows in enumerate(BATCHES):
        done = ingest.ingest_batch(catalog_store.load(spark, base), batch(spark, number, rows), as_of=clock(number), slices=1)
        catalog_store.publish(done.catalog, base, number + 2, new_observations=done.new_observations)
    by_hand = catalog_store.load(spark, base)
    for name, df in by_hand.items():
        assert sorted(map(str, df.collect())) == sorted(map(str, getattr(streamed, name).collect())), name
