"""Retailer health, service health, run list and the data-quality report."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.functions import predicates as P
from pricetide.operators import stats as S
from pricetide.schemas import Catalog

_RUN_COLUMNS = [
    "status", "scraper_name", "started_at", "finished_at", "error_summary", "listings_seen", "listings_created",
    "listings_updated",
]


def retailer_health(
    cat: Catalog, *, as_of: datetime, stale_after_hours: int = P.STALE_RETAILER_HOURS
) -> DataFrame:
    last = S.latest_run(cat.runs).select("retailer_id", *[F.col(c).alias(f"latest_run_{c}") for c in _RUN_COLUMNS])
    per_retailer = (
        last.join(S.latest_success(cat.runs), "retailer_id", "full")
        .join(S.active_offers_by(cat.offers, "retailer_id"), "retailer_id", "full")
        .withColumnRenamed("retailer_id", "id")
    )
    age = P.age_hours(F.col("last_success_at"), as_of)
    status = F.col("latest_run_status")
    return (
        cat.retailers.select("id", "name")
        .join(per_retailer, "id", "left")
        .withColumn("success_age_hours", age)
        .select(
            F.col("id").alias("retailer_id"),
            F.col("name").alias("retailer_name"),
            P.health_status(status, F.col("success_age_hours"), stale_after_hours).alias("status"),
            P.health_is_stale(status, F.col("success_age_hours"), stale_after_hours).alias("is_stale"),
            F.lit(stale_after_hours).cast("long").alias("stale_after_hours"),
            F.coalesce("active_offer_count", F.lit(0)).cast("long").alias("active_offer_count"),
            *[f"latest_run_{c}" for c in _RUN_COLUMNS],
            "last_success_at",
            "success_age_hours",
        )
        .orderBy("retailer_name", "retailer_id")
    )


def runs(cat: Catalog, *, retailer_id=None, status: str | None = None, limit: int = 20) -> DataFrame:
    """Latest runs first. The limit applies before the retailer name is looked up."""
    kept = cat.runs.filter(
        P.all_of(P.equals(F.col("retailer_id"), retailer_id), P.equals(F.col("status"), status))
    )
    order = [F.col("started_at").desc(), F.col("id").desc()]
    named = cat.retailers.select(F.col("id").alias("retailer_id"), F.col("name").alias("retailer_name"))
    return kept.orderBy(*order).limit(limit).join(named, "retailer_id", "left").orderBy(*order)


def health(cat: Catalog, *, as_of: datetime) -> DataFrame:
    """One row: sizes, readiness and the latest run. Per-retailer rows come from ``retailer_health``."""
    newest = (
        cat.runs.orderBy(F.col("started_at").desc(), F.col("id").desc())
        .limit(1)
        .join(
            cat.retailers.select(F.col("id").alias("retailer_id"), F.col("name").alias("retailer_name")),
            "retailer_id", "left",
        )
        .select(*[F.col(c).alias(f"latest_run_{c}") for c in [*_RUN_COLUMNS, "retailer_name"]])
    )
    row = S.one_row(
        cat.retailers.agg(F.count("*").alias("retailer_count")),
        cat.categories.agg(F.count("*").alias("category_count")),
        cat.products.filter("is_active").agg(F.count("*").alias("product_count")),
        cat.offers.filter(P.active_available()).agg(F.count("*").alias("active_offer_count")),
        cat.decisions.filter(F.col("decision") == "needs_review").agg(F.count("*").alias("review_queue_count")),
        cat.runs.filter(F.col("status") == "succeeded").agg(F.max("finished_at").alias("latest_success_at")),
        newest,
    )
    ready = (F.col("product_count") > 0) & (F.col("active_offer_count") > 0)
    degraded = ~ready | F.coalesce(F.col("latest_run_status") == "failed", F.lit(False))
    return row.select(
        F.when(degraded, "degraded").otherwise("ok").alias("status"), ready.alias("catalog_ready"), "*"
    )


def quality_counts(
    cat: Catalog, *, as_of: datetime, runs_as_of: datetime | None = None,
    stale_days: int = P.STALE_OFFER_DAYS, stale_hours: int = P.STALE_RETAILER_HOURS,
    high: float = P.HIGH_CONFIDENCE, medium: float = P.MEDIUM_CONFIDENCE,
) -> DataFrame:
    """One row with every counter of the data-quality report."""
    live = cat.offers.filter(P.active_available())
    attention = retailer_health(cat, as_of=runs_as_of or as_of, stale_after_hours=stale_hours)
    return S.one_row(
        S.review_buckets(cat.decisions, high=high, medium=medium),
        live.agg(
            F.count_if(P.before_cutoff(F.col("last_seen_at"), as_of, stale_days)).alias("stale_offer_count"),
            F.count_if(F.col("current_price").isNull()).alias("unpriced_active_offer_count"),
        ),
        cat.listings.filter((F.col("status") == "available") & F.col("category_id").isNull()).agg(
            F.count("*").alias("uncategorized_listing_count")
        ),
        S.products_without_live_offers(cat.products, cat.offers).agg(
            F.count("*").alias("products_without_active_offers_count")
        ),
        attention.agg(
            F.count_if(F.col("status").isin("failed", "stale", "never_run")).alias("stale_retailer_count")
        ),
    )


# Issue key, counter, label, detail, critical flag; in report order.
QUALITY_ISSUES = [
    ("review_queue", "review_queue_count", "Pending review queue",
     "Ambiguous retailer listings still waiting for a match or rejection.", False),
    ("high_confidence_review_queue", "high_confidence_review_count", "High-confidence review items",
     "Queue items with matcher confidence of at least 90% that are good candidates for bulk resolution.", False),
    ("stale_offers", "stale_offer_count", "Stale active offers",
     "Active offers that have not been seen for at least {stale_days} days.", True),
    ("unpriced_active_offers", "unpriced_active_offer_count", "Unpriced active offers",
     "Available offers missing a current price, which weakens comparisons and best-price signals.", False),
    ("uncategorized_listings", "uncategorized_listing_count", "Uncategorised listings",
     "Retailer listings still missing a category assignment.", False),
    ("products_without_active_offers", "products_without_active_offers_count",
     "Canonical products without live offers",
     "Active canonical products that no longer have any live available offers attached.", False),
    ("stale_retailers", "stale_retailer_count", "Retailers needing scrape attention",
     "Retailers whose latest state is failed, stale, or never run.", True),
]


def quality_issues(counts: DataFrame, *, stale_days: int = P.STALE_OFFER_DAYS) -> DataFrame:
    """The counters as issue rows with severity, in report order."""
    rows = F.array(
        *[
            F.struct(
                F.lit(i).cast("long").alias("position"),
                F.lit(key).alias("key"),
                F.lit(label).alias("label"),
                F.col(counter).alias("count"),
                P.severity(F.col(counter), F.lit(critical)).alias("severity"),
                F.lit(detail.format(stale_days=stale_days)).alias("detail"),
            )
            for i, (key, counter, label, detail, critical) in enumerate(QUALITY_ISSUES)
        ]
    )
    return counts.select(F.inline(rows)).orderBy("position")


def _queue(dim: DataFrame, signals: list[DataFrame], key: str, columns: list[str]) -> DataFrame:
    joined = dim.select("id", "name")
    for s in signals:
        joined = joined.join(s.withColumnRenamed(key, "id"), "id", "left")
    present = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in columns]
    rows = joined.select("id", "name", *present)
    any_signal = F.greatest(*columns) > 0
    return rows.filter(any_signal).orderBy(
        F.col("pending_review_count").desc(), F.col("high_confidence_review_count").desc(),
        F.lower("name").asc(), F.col("id").asc(),
    )


def retailer_queue(cat: Catalog, *, high: float = P.HIGH_CONFIDENCE, medium: float = P.MEDIUM_CONFIDENCE):
    pending = S.review_queue_by(cat.decisions, cat.listings, "retailer_id", high=high, medium=medium)
    live = S.active_offers_by(cat.offers, "retailer_id")
    columns = [
        "pending_review_count", "high_confidence_review_count", "low_confidence_review_count", "active_offer_count",
    ]
    return _queue(cat.retailers, [pending, live], "retailer_id", columns)


def category_queue(cat: Catalog, *, high: float = P.HIGH_CONFIDENCE, medium: float = P.MEDIUM_CONFIDENCE):
    pending = S.review_queue_by(cat.decisions, cat.listings, "category_id", high=high, medium=medium)
    live = S.active_offers_by(cat.offers, "category_id")
    products = S.active_products_by_category(cat.products)
    columns = ["pending_review_count", "high_confidence_review_count", "active_offer_count", "product_count"]
    return _queue(cat.categories, [pending.drop("low_confidence_review_count"), live, products], "category_id", columns)


def catalog_ready(cat: Catalog) -> DataFrame:
    """One row: whether the catalog holds products and whether it holds offers, read from one row of each."""
    has = lambda df: df.select(F.lit(1)).limit(1).agg((F.count("*") > 0).alias("has"))
    products, offers = has(cat.products), has(cat.offers)
    return products.select(
        F.col("has").alias("has_products"), offers.scalar().alias("has_offers"),
        F.when(F.col("has"), F.lit("ready")).otherwise("empty_catalog").alias("state"),
    )


def missing_entities(ids: DataFrame, table: DataFrame) -> DataFrame:
    """The asked ``id`` values that the table lacks."""
    return ids.select("id").distinct().join(table.select("id"), "id", "left_anti")
