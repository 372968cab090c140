"""Aggregates and latest-per-key operators.

Every group here is reduced with aggregates that combine map-side (count, min, max, min_by, max_by,
collect_set of a dimension key), so a single hot key never lands whole in one task.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.functions import predicates as P


def one_row(*parts: DataFrame) -> DataFrame:
    """Put several one-row aggregates side by side without a cross join."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return merged.agg(*[F.max(c).alias(c) for c in merged.columns])


def offer_stats(offers: DataFrame) -> DataFrame:
    """Per product: offer counts and lowest prices."""
    live = P.available_with_price()
    return offers.groupBy("product_id").agg(
        F.count("*").alias("offer_count"),
        F.count("current_price").alias("priced_offer_count"),
        F.count_if(live).alias("available_offer_count"),
        F.min("current_price").alias("min_any_price"),
        F.min(F.when(live, F.col("current_price"))).alias("min_available_price"),
    )


def with_offer_stats(products: DataFrame, stats: DataFrame) -> DataFrame:
    """Left join of the per-product stats; products without offers get zero counts."""
    counts = ["offer_count", "priced_offer_count", "available_offer_count"]
    joined = products.join(stats.withColumnRenamed("product_id", "id"), "id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in counts})


def active_offers_by(offers: DataFrame, key: str) -> DataFrame:
    return (
        offers.filter(P.active_available() & F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count("*").alias("active_offer_count"))
    )


def active_products_by_category(products: DataFrame) -> DataFrame:
    return products.filter("is_active").groupBy("category_id").agg(F.count("*").alias("product_count"))


def products_without_live_offers(products: DataFrame, offers: DataFrame) -> DataFrame:
    """Active products none of whose offers is live."""
    live = offers.filter(P.active_available()).select(F.col("product_id").alias("id"))
    return products.filter("is_active").join(live, "id", "left_anti")


def latest_success(runs: DataFrame) -> DataFrame:
    return (
        runs.filter((F.col("status") == "succeeded") & F.col("retailer_id").isNotNull())
        .groupBy("retailer_id")
        .agg(F.max(F.coalesce("finished_at", "started_at")).alias("last_success_at"))
    )


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` per key, as an aggregate instead of a sorted window."""
    payload = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*payload), F.struct(*order)).alias("latest")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"latest.{c}").alias(c) for c in payload])


def latest_run(runs: DataFrame) -> DataFrame:
    return latest_per_key(runs.filter(F.col("retailer_id").isNotNull()), ["retailer_id"], ["started_at", "id"])


def latest_decision(decisions: DataFrame) -> DataFrame:
    return latest_per_key(decisions, ["listing_id"], ["created_at", "id"])


def latest_observation(observations: DataFrame) -> DataFrame:
    return latest_per_key(observations, ["offer_id"], ["observed_at", "id"])


def first_last_price(
    observations: DataFrame, offers: DataFrame, *, as_of: datetime, days: int
) -> DataFrame:
    """First and last observed price per product in the lookback window.

    Observations are reduced per offer before they meet the offer table, so the join and the second
    shuffle see at most one row per offer and a hot product or offer is already collapsed.
    """
    point = F.struct("observed_at", F.col("id").alias("obs_id"))
    per_offer = (
        observations.filter(P.since(F.col("observed_at"), as_of, days))
        .select("offer_id", "price", point.alias("at"))
        .groupBy("offer_id")
        .agg(
            F.min(F.struct("at", "price")).alias("first"),
            F.max(F.struct("at", "price")).alias("last"),
        )
    )
    owner = offers.select(F.col("id").alias("offer_id"), "product_id")
    return (
        per_offer.join(owner, "offer_id")
        .groupBy("product_id")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"))
        .select(
            "product_id",
            F.col("first.price").alias("initial_price"),
            F.col("last.price").alias("latest_price"),
        )
    )


def review_buckets(decisions: DataFrame, *, high: float = P.HIGH_CONFIDENCE, medium: float = P.MEDIUM_CONFIDENCE):
    """One row: queue size and its confidence bands; a missing confidence is low."""
    c = F.col("confidence")
    return (
        decisions.filter(F.col("decision") == "needs_review")
        .agg(
            F.count("*").alias("review_queue_count"),
            F.count_if(c >= high).alias("high_confidence_review_count"),
            F.count_if((c >= medium) & (c < high)).alias("medium_confidence_review_count"),
        )
        .withColumn(
            "low_confidence_review_count",
            F.col("review_queue_count") - F.col("high_confidence_review_count")
            - F.col("medium_confidence_review_count"),
        )
    )


def review_queue_by(
    decisions: DataFrame, listings: DataFrame, key: str,
    *, high: float = P.HIGH_CONFIDENCE, medium: float = P.MEDIUM_CONFIDENCE,
) -> DataFrame:
    """Pending decisions per listing attribute ``key``; counted per listing before the join."""
    c = F.col("confidence")
    counts = ["pending_review_count", "high_confidence_review_count", "low_confidence_review_count"]
    per_listing = (
        decisions.filter(F.col("decision") == "needs_review")
        .groupBy("listing_id")
        .agg(
            F.count("*").alias(counts[0]),
            F.count_if(c >= high).alias(counts[1]),
            F.count_if(c.isNull() | (c < medium)).alias(counts[2]),
        )
    )
    return (
        per_listing.join(listings.select(F.col("id").alias("listing_id"), key), "listing_id")
        .filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(*[F.sum(n).alias(n) for n in counts])
    )


def candidate_rollup(offers: DataFrame) -> DataFrame:
    """Per product: lowest price over all priced offers and the number of retailers.

    The distinct count goes through (product, retailer) groups, so a hot product spreads by retailer.
    """
    return (
        offers.groupBy("product_id", "retailer_id")
        .agg(F.min("current_price").alias("p"), F.count("*").alias("n"))
        .groupBy("product_id")
        .agg(
            F.min("p").alias("best_price"),
            F.count("retailer_id").alias("retailer_count"),
            F.sum("n").alias("offer_count"),
        )
    )


def filter_products(
    products: DataFrame, stats: DataFrame, *, search: str | None = None, category_id=None,
    hide_unavailable: bool = True,
) -> DataFrame:
    """Active products with their stats that pass the catalog filters."""
    kept = products.filter(
        P.all_of(
            F.col("is_active"),
            P.name_matches(F.col("canonical_name"), search),
            P.equals(F.col("category_id"), category_id),
        )
    )
    out = with_offer_stats(kept, stats)
    return out.filter(F.col("available_offer_count") > 0) if hide_unavailable else out


def by_ids(df: DataFrame, wanted: DataFrame, *, order: str = "ord") -> DataFrame:
    """Rows for the requested ``(id, ord)``, in request order; unknown ids drop out."""
    return df.join(wanted.select("id", order), "id").orderBy(order)


def summaries(
    products: DataFrame, offers: DataFrame, retailers: DataFrame, *, hide_unavailable: bool = True,
    restrict: bool = True,
) -> DataFrame:
    """Per product: counts, best offer, price range and retailer names.

    ``products`` may be any subset; with ``restrict`` offers are reduced to it first, so a page of products
    reads the offer table once and shuffles only the offers of that page.
    """
    usable = F.col("current_price").isNotNull()
    if hide_unavailable:
        usable = P.available_with_price()
    used = offers.select("id", "product_id", "retailer_id", "current_price", "status", "is_active")
    if restrict:
        used = used.join(products.select(F.col("id").alias("product_id")), "product_id", "left_semi")
    named = (
        used.join(retailers.select(F.col("id").alias("retailer_id"), F.col("name").alias("retailer")), "retailer_id")
    )
    best = F.min(F.when(usable, F.struct("current_price", "id", "retailer"))).alias("best")
    per_product = named.groupBy("product_id").agg(
        F.count("*").alias("offer_count"),
        F.count_if(usable).alias("available_offer_count"),
        best,
        F.min("current_price").alias("price_range_min"),
        F.max("current_price").alias("price_range_max"),
        F.array_sort(F.collect_set("retailer")).alias("retailers"),
    )
    joined = products.join(per_product.withColumnRenamed("product_id", "id"), "id", "left")
    return joined.withColumns(
        {
            "offer_count": F.coalesce("offer_count", F.lit(0)).cast("long"),
            "available_offer_count": F.coalesce("available_offer_count", F.lit(0)).cast("long"),
            "best_price": F.col("best.current_price"),
            "best_price_retailer": F.col("best.retailer"),
            "retailers": F.coalesce("retailers", F.array().cast("array<string>")),
            "attributes": F.coalesce("attributes", F.create_map().cast("map<string,string>")),
        }
    ).drop("best")


SUMMARY_COLUMNS = [
    "id", "canonical_name", "category_id", "category_name", "brand", "fingerprint", "attributes", "offer_count",
    "available_offer_count", "best_price", "best_price_retailer", "price_range_min", "price_range_max", "retailers",
]


def product_summary(
    products: DataFrame, offers: DataFrame, retailers: DataFrame, categories: DataFrame,
    *, hide_unavailable: bool = True, restrict: bool = True, keep: list[str] | None = None,
) -> DataFrame:
    named = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    out = summaries(products, offers, retailers, hide_unavailable=hide_unavailable, restrict=restrict)
    return out.join(named, "category_id", "left").select(*SUMMARY_COLUMNS, *(keep or []))


def nulls_last(column: Column, descending: bool) -> Column:
    return column.desc_nulls_last() if descending else column.asc_nulls_last()
