"""Read queries on the small seed, and the shape of their plans."""

from __future__ import annotations

import pytest

from conftest import NOW
from pricetide import schemas
from pricetide.functions import predicates as P
from pricetide.operators import stats as S
from pricetide.plans import client, health, products, review, trends


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_product_page(seed):
    rows = {r.id: r for r in products.product_page(seed).collect()}
    assert set(rows) == {"gpu", "cpu"}
    g = rows["gpu"]
    assert (g.offer_count, g.available_offer_count, g.best_price, g.best_price_retailer, g.retailers) == (2, 2, 950.0, "B", ["A", "B"])
    assert [r.best_price for r in products.product_page(seed, sort_by="price", sort_order="desc").collect()] == [950.0, 600.0]
    assert [r.id for r in products.product_page(seed, page=1, page_size=1).collect()] == ["cpu"]
    assert products.product_page_total(seed, search="Ryzen").first().total == 1
    shown = products.product_page(seed, category_id=1, hide_unavailable=False).collect()
    assert [r.id for r in shown] == ["gpu", "legacy"]


def test_detail_history_offers_filters(spark, seed):
    ids = spark.createDataFrame([("gpu",)], "id string")
    assert products.product_detail(seed, ids).count() == 1
    assert [r.current_price for r in products.product_listings(seed, ids).collect()] == [950.0, 1000.0]
    assert {r.retailer_name for r in products.price_history(seed, ids).collect()} == {"A", "B"}
    silent = [r for r in products.price_history(seed).collect() if r.observed_at is None]
    assert [(r.product_id, r.retailer_name) for r in silent] == [("legacy", "A"), ("cpu", "B")] or len(silent) == 2
    assert [r.current_price for r in products.offers(seed, limit=1, offset=1).collect()] == [950.0]
    price = products.facet_prices(seed).first()
    assert (price.min_price, price.max_price) == (600.0, 950.0)
    assert [r.name for r in products.facet_categories(seed).collect()] == ["CPUs", "Graphics Cards"]


def test_trends(seed):
    rows = trends.price_drops(seed, as_of=NOW, days=30, limit=5).collect()
    drops = [r.price_drop_percentage for r in rows]
    assert len(rows) == 2 and drops == sorted(drops, reverse=True)


def test_health(seed):
    rows = {r.retailer_name: r for r in health.retailer_health(seed, as_of=NOW).collect()}
    assert (rows["A"].status, rows["A"].is_stale, rows["A"].active_offer_count, rows["A"].success_age_hours) == ("failed", False, 2, 1)
    assert (rows["B"].status, rows["B"].is_stale, rows["B"].active_offer_count) == ("never_run", True, 2)
    h = health.health(seed, as_of=NOW).first()
    assert (h.status, h.catalog_ready, h.product_count, h.active_offer_count, h.review_queue_count) == ("degraded", True, 3, 4, 1)


def test_quality(spark, seed):
    c = health.quality_counts(seed, as_of=NOW).first().asDict()
    assert c == {
        "review_queue_count": 1, "high_confidence_review_count": 0, "medium_confidence_review_count": 0,
        "low_confidence_review_count": 1, "stale_offer_count": 1, "unpriced_active_offer_count": 1,
        "uncategorized_listing_count": 1, "products_without_active_offers_count": 1, "stale_retailer_count": 2,
    }
    issues = {r.key: r.severity for r in health.quality_issues(health.quality_counts(seed, as_of=NOW)).collect()}
    assert (issues["review_queue"], issues["stale_offers"]) == ("warning", "critical")
    q = {r.name: r for r in health.category_queue(seed).collect()}
    assert (q["Graphics Cards"].pending_review_count, q["Graphics Cards"].active_offer_count, q["Graphics Cards"].product_count) == (1, 2, 2)
    assert (q["CPUs"].pending_review_count, q["CPUs"].active_offer_count, q["CPUs"].product_count) == (0, 2, 1)
    empty = health.health(schemas.empty_catalog(spark), as_of=NOW).first()
    assert (empty.status, empty.catalog_ready) == ("degraded", False)


def test_decision_pages(seed):
    assert review.decisions_total(seed, decision="needs_review", category_id=1, search="4070").first().total == 1
    assert review.decisions(seed, search="4070", offset=1).count() == 0


def test_alerts(spark, seed):
    sums = S.product_summary(seed.products, seed.offers, seed.retailers, seed.categories)
    alerts = spark.createDataFrame([("gpu", 960.0), ("gpu", 960.0), ("cpu", 1.0), ("none", 5.0)], "product_id string, target_price double")
    rows = {r.product_id: r for r in client.price_alerts(alerts, sums).collect()}
    assert set(rows) == {"gpu", "cpu"} and rows["gpu"].triggered and rows["gpu"].gap == -10.0 and not rows["cpu"].triggered


@pytest.mark.parametrize("build", [
    lambda c: products.product_page(c, sort_by="price"), lambda c: trends.price_drops(c, as_of=NOW),
    lambda c: health.quality_counts(c, as_of=NOW), lambda c: products.price_history(c),
])
def test_plans_stay_native(seed, build):
    text = plan(build(seed))
    assert "Python" not in text and "ArrowEval" not in text and "CartesianProduct" not in text


def test_first_last_price_reduces_before_joining(spark, seed, tmp_path):
    for name in ("observations", "offers"):
        getattr(seed, name).write.parquet(str(tmp_path / name))
    obs = spark.read.parquet(str(tmp_path / "observations"))
    off = spark.read.parquet(str(tmp_path / "offers"))
    text = plan(S.first_last_price(obs, off, as_of=NOW, days=30))
    assert "PushedFilters: [IsNotNull(observed_at), GreaterThanOrEqual(observed_at" in text
    below_join = text[text.index("Join"):]
    assert below_join.count("Aggregate") >= 2
    assert "in_stock" not in text


def test_latest_per_key_has_one_exchange(seed):
    assert plan(S.latest_observation(seed.observations)).count("Exchange hashpartitioning") == 1
    assert "Window" not in plan(S.latest_decision(seed.decisions))


def test_status_ladder(spark):
    from datetime import timedelta

    from pyspark.sql import functions as F

    ago = NOW - timedelta(hours=36, minutes=59)
    cases = [("succeeded", ago, "ok"), ("succeeded", NOW - timedelta(hours=37), "stale"), ("partial", ago, "partial"),
             ("partial", None, "stale"), ("started", None, "running"), ("failed", None, "failed"), (None, None, "never_run")]
    df = spark.createDataFrame([(s, t) for s, t, _ in cases], "s string, t timestamp_ntz")
    age = P.age_hours(F.col("t"), NOW)
    assert [r.x for r in df.select(P.health_status(F.col("s"), age, 36).alias("x")).collect()] == [c[2] for c in cases]
