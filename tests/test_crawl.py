"""A crawl from pages to the next catalog."""

from __future__ import annotations

from datetime import datetime

from conftest import NOW
from pricetide import schemas
from pricetide.operators import crawl, extract
from test_extract import SITE_URL, shop_page


def test_a_crawl_reads_its_pages_once(spark, monkeypatch):
    calls, read = [], extract.cards
    monkeypatch.setattr(extract, "cards", lambda *args: calls.append(1) or read(*args))
    cat = schemas.empty_catalog(spark).with_tables(categories=spark.createDataFrame([(1, "Cooling")], schemas.TABLE_SCHEMAS["categories"]))
    pages = spark.createDataFrame([(f"{SITE_URL['jw']}/list/1?n=1", "jw", shop_page("jw"), "run-jw", 1), (f"{SITE_URL['jw']}/list/1?n=2", "jw", "<p>none</p>", "run-jw", 2)],
                                  "url string, site string, html string, run_id string, page_seq long")
    sites = spark.createDataFrame([("jw", 1)], "site string, retailer_id long")
    tasks = spark.createDataFrame([(f"{SITE_URL['jw']}/list/1", "Cooling")], "task_url string, category string")
    done = crawl.crawl_batch(cat, pages, sites, tasks, completed=sites.select("retailer_id"), run_id="crawl", as_of=NOW, compare_new=False)
    assert len(calls) == 1
    assert sorted((r["listing_name"], r["current_price"], r["status"]) for r in done.catalog.offers.collect()) == [
        ("Drive 4 TB", 2048.0, "available"), ("Frame R2 & Glass", None, "unavailable"), ("Quiet Fan 140", 37.5, "available")]
    assert [(r["id"], r["status"], r["listings_seen"], r["listings_created"]) for r in done.catalog.runs.collect()] == [("run-jw", "partial", 3, 3)]


def test_pages_meet_their_tasks_as_they_lie(spark):
    rows = [("https://a.example/x/1", 1), ("https://a.example/x/1", 2), ("https://a.example/y", 3), ("https://b.example/", 4), ("nowhere", 5), (None, 6)]
    pages = spark.createDataFrame(rows, "url string, page_id int")
    tasks = spark.createDataFrame([("https://a.example", "all"), ("https://a.example/x", "x"), ("https://a.example/x", "w"), ("https://a.example/x", None), (None, "none"), ("nowhere", "bare")],
                                  "task_url string, category string")
    out = extract.category_of(pages, tasks)
    assert sorted((r.page_id, r.category_name) for r in out.collect()) == [(1, "x"), (2, "x"), (3, "all"), (4, None), (5, "bare"), (6, None)]
    assert out.columns == ["url", "page_id", "category_name"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and plan.count("Join") == 1, plan  # the tasks of a host; pages are not dealt by address


def test_card_pages_are_spread_over_the_tasks(spark, tmp_path):
    from pyspark.sql import functions as F
    from workload import adapter, job_queries

    rows = [(n, n, 4, 1, 2.0, 100.0, 0.0, 0.1, "N", "O", datetime(1998, 1, 1)) for n in range(200)]
    kinds = adapter.TEST_TABLES["lineitem"].replace("timestamp_ntz", "timestamp")
    spark.createDataFrame(rows, kinds).withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    made = job_queries._card_pages(spark, str(tmp_path))
    assert made.rdd.getNumPartitions() == 4 and made.count() == 200
