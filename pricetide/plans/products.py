"""Product page, detail, facets, offers and history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.functions import predicates as P
from pricetide.operators import stats as S
from pricetide.schemas import Catalog


def _page_order(sort_by: str, sort_order: str, hide_unavailable: bool) -> list:
    descending = sort_order == "desc"
    by_name = F.col("canonical_name").asc()
    if sort_by == "price":
        column = "min_available_price" if hide_unavailable else "min_any_price"
        return [S.nulls_last(F.col(column), descending), by_name, F.col("id").asc()]
    if sort_by == "offers":
        # A product without any offer has no count at all and goes last in both directions.
        column = "available_offer_count" if hide_unavailable else "priced_offer_count"
        count = F.when(F.col("offer_count") > 0, F.col(column))
        return [S.nulls_last(count, descending), by_name, F.col("id").asc()]
    return [F.col("canonical_name").desc() if descending else by_name, F.col("id").asc()]


def product_page(
    cat: Catalog, *, page: int = 1, page_size: int = 24, search: str | None = None, category_id=None,
    sort_by: str = "name", sort_order: str = "asc", hide_unavailable: bool = True,
) -> DataFrame:
    """One page of product summaries.

    Sorting and limiting run on narrow per-product stats; only the page's products are then joined back
    to their offers for the wide summary.
    """
    hits = S.filter_products(
        cat.products, S.offer_stats(cat.offers), search=search, category_id=category_id,
        hide_unavailable=hide_unavailable,
    )
    order = _page_order(sort_by, sort_order, hide_unavailable)
    keys = ["min_available_price", "min_any_price"]
    counts = ["offer_count", "priced_offer_count", "available_offer_count"]
    narrow = hits.select("id", "canonical_name", *keys, *counts)
    page_ids = narrow.orderBy(*order).offset(max(page - 1, 0) * page_size).limit(page_size)
    rank = page_ids.select(
        "id", F.struct(*[c for c in narrow.columns if c != "id"]).alias("sort")
    )
    page_products = cat.products.join(rank, "id")
    out = S.product_summary(
        page_products, cat.offers, cat.retailers, cat.categories,
        hide_unavailable=hide_unavailable, keep=["sort"],
    )
    public = out.columns[:-1]
    flat = out.select(
        F.struct(*public).alias("row"), F.col("id"), F.col("canonical_name"),
        *[F.col(f"sort.{c}").alias(c) for c in (*keys, *counts)],
    )
    return flat.orderBy(*order).select("row.*")


def product_page_total(cat: Catalog, *, search=None, category_id=None, hide_unavailable: bool = True) -> DataFrame:
    hits = S.filter_products(
        cat.products, S.offer_stats(cat.offers), search=search, category_id=category_id,
        hide_unavailable=hide_unavailable,
    )
    return hits.agg(F.count("*").alias("total"))


def product_detail(cat: Catalog, product_ids: DataFrame | None = None) -> DataFrame:
    """Summaries over all offers, whatever their status; one row per product."""
    products = cat.products
    if product_ids is not None:
        products = products.join(product_ids.select("id"), "id", "left_semi")
    return S.product_summary(
        products, cat.offers, cat.retailers, cat.categories, hide_unavailable=False,
        restrict=product_ids is not None,
    )


def _offer_rows(offers: DataFrame, retailers: DataFrame) -> DataFrame:
    named = retailers.select(F.col("id").alias("retailer_id"), F.col("name").alias("retailer_name"))
    return offers.join(named, "retailer_id").select(
        F.col("id").alias("offer_id"), "product_id", F.col("listing_name").alias("name"),
        F.col("listing_url").alias("url"), "image_url", "current_price", "previous_price", "status",
        P.on_sale(F.col("current_price"), F.col("previous_price")).alias("on_sale"),
        "retailer_id", "retailer_name",
    )


def product_listings(cat: Catalog, product_ids: DataFrame | None = None) -> DataFrame:
    """Offers of each product as rows: unpriced last, then price, retailer name, offer id.

    Rows, not a nested array: one product may own a large share of all offers, and a global sort splits it.
    """
    offers = cat.offers
    if product_ids is not None:
        offers = offers.join(product_ids.select(F.col("id").alias("product_id")), "product_id", "left_semi")
    return _offer_rows(offers, cat.retailers).orderBy(
        "product_id", F.col("current_price").asc_nulls_last(), "retailer_name", "offer_id"
    )


def offers(
    cat: Catalog, *, product_id=None, hide_unavailable: bool = True, limit: int | None = None, offset: int = 0,
) -> DataFrame:
    """Offer list. For one product there is no paging; otherwise cheapest first."""
    rows = cat.offers
    if hide_unavailable:
        rows = rows.filter(F.col("status") == "available")
    if product_id is not None:
        return _offer_rows(rows.filter(F.col("product_id") == F.lit(product_id)), cat.retailers)
    order = [F.col("current_price").asc_nulls_last(), F.col("listing_name").asc(), F.col("id").asc()]
    if limit is not None:
        rows = rows.orderBy(*order).offset(offset).limit(limit)
    elif offset:
        # Without a limit all rows go on, so they stay spread out; only the few skipped ones are gathered.
        skipped = rows.select("id", "current_price", "listing_name").orderBy(*order).limit(offset).select("id")
        rows = rows.join(skipped, "id", "left_anti")
    return _offer_rows(rows, cat.retailers).orderBy(
        F.col("current_price").asc_nulls_last(), F.col("name").asc(), F.col("offer_id").asc()
    )


def history_points(cat: Catalog, product_ids: DataFrame | None = None) -> DataFrame:
    """Observed prices per product and retailer as rows in no order; a retailer without observations keeps one row with no point."""
    owned = cat.offers.select(F.col("id").alias("offer_id"), "product_id", "retailer_id")
    if product_ids is not None:
        owned = owned.join(product_ids.select(F.col("id").alias("product_id")), "product_id", "left_semi")
    named = cat.retailers.select(F.col("id").alias("retailer_id"), F.col("name").alias("retailer_name"))
    points = cat.observations.select("offer_id", "observed_at", "price", F.col("id").alias("obs_id"))
    heard = owned.join(points.filter(F.col("observed_at").isNotNull()), "offer_id")
    keys = ["product_id", "retailer_id"]
    silent = owned.select(*keys).distinct().join(heard.select(*keys).distinct(), keys, "left_anti")
    return heard.select(
        *keys, F.col("offer_id").alias("listing_id"), "observed_at", "price", "obs_id",
    ).unionByName(silent, allowMissingColumns=True).join(named, "retailer_id").select(
        *keys, "retailer_name", "listing_id", "observed_at", "price", "obs_id")


def price_history(cat: Catalog, product_ids: DataFrame | None = None) -> DataFrame:
    """The history points, by time within each offer."""
    return history_points(cat, product_ids).orderBy("product_id", "retailer_id", "listing_id", "observed_at", "obs_id")


def facet_categories(cat: Catalog) -> DataFrame:
    """All categories by name, whatever the filter."""
    return cat.categories.select("id", "name").orderBy("name", "id")


def facet_brands(cat: Catalog, *, category_id=None) -> DataFrame:
    hits = S.filter_products(cat.products, S.offer_stats(cat.offers), category_id=category_id)
    return hits.filter(F.col("brand").isNotNull()).select("brand").distinct().orderBy("brand")


def facet_prices(cat: Catalog, *, category_id=None) -> DataFrame:
    """Range of the per-product lowest available price."""
    hits = S.filter_products(cat.products, S.offer_stats(cat.offers), category_id=category_id)
    return hits.agg(
        F.min("min_available_price").alias("min_price"), F.max("min_available_price").alias("max_price")
    )
