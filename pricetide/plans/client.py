"""Operators behind the client screens: alerts, watchlist, comparison, history pivot, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How many products the comparison keeps, and the bulk-eligible score.
COMPARE_SLOTS = 4
BULK_ELIGIBLE_SCORE = 95.0


def price_alerts(alerts: DataFrame, summaries: DataFrame) -> DataFrame:
    """Alerts ``(product_id, target_price)`` with their state; repeats and unknown products drop out."""
    known = summaries.select(F.col("id").alias("product_id"), "canonical_name", "best_price")
    hit = F.coalesce(F.col("best_price") <= F.col("target_price"), F.lit(False))
    return (
        alerts.select("product_id", "target_price").distinct()
        .join(known, "product_id")
        .select(
            "product_id", "canonical_name", "target_price", "best_price", hit.alias("triggered"),
            (F.col("best_price") - F.col("target_price")).alias("gap"),
        )
    )


def alert_counts(alert_rows: DataFrame) -> DataFrame:
    return alert_rows.agg(
        F.count_if(~F.col("triggered")).alias("active_count"), F.count_if("triggered").alias("triggered_count")
    )


def watchlist(
    summaries: DataFrame, watched: DataFrame, *, category_id=None, search: str | None = None
) -> DataFrame:
    rows = summaries.join(watched.select("id"), "id", "left_semi")
    if category_id is not None:
        rows = rows.filter(F.col("category_id") == F.lit(category_id))
    if search:
        text = F.concat_ws(
            " ", "canonical_name", "fingerprint", F.coalesce("best_price_retailer", F.lit(""))
        )
        rows = rows.filter(F.lower(text).contains(search.lower()))
    return rows


def compare_slots(picked: DataFrame, *, slots: int = COMPARE_SLOTS) -> DataFrame:
    """The most recently picked products of ``(id, picked_at)``."""
    return picked.orderBy(F.col("picked_at").desc(), F.col("id").desc()).limit(slots)


def compare_matrix(summaries: DataFrame, picked: DataFrame, *, slots: int = COMPARE_SLOTS) -> DataFrame:
    """One row per attribute key and compared product; keys missing on a product give null."""
    chosen = summaries.join(compare_slots(picked, slots=slots).select("id"), "id", "left_semi")
    pairs = chosen.select("id", F.explode("attributes").alias("attribute", "value"))
    keys = pairs.select("attribute").distinct().withColumn("slot", F.lit(1))
    members = chosen.select("id", F.lit(1).alias("slot"))
    # Both sides are bounded: at most `slots` products and their attribute keys.
    return (
        keys.join(members, "slot").drop("slot")
        .join(pairs, ["id", "attribute"], "left")
        .orderBy("attribute", "id")
    )


def compare_pivot(summaries: DataFrame, picked: DataFrame, *, slots: int = COMPARE_SLOTS) -> DataFrame:
    """Attribute keys as rows, the compared products as columns ``slot_1`` .. by pick order."""
    order = compare_slots(picked, slots=slots).select("id", "picked_at").withColumn("one", F.lit(1))
    lined_up = order.groupBy("one").agg(F.array_sort(F.collect_list(F.struct("picked_at", "id"))).alias("line"))
    place = lined_up.select(F.posexplode("line").alias("pos", "pick")).select(
        F.col("pick.id").alias("id"), (F.col("pos") + 1).alias("place")
    )
    pairs = summaries.join(place, "id").select("place", F.explode("attributes").alias("attribute", "value"))
    columns = [F.max(F.when(F.col("place") == n, F.col("value"))).alias(f"slot_{n}") for n in range(1, slots + 1)]
    return pairs.groupBy("attribute").agg(*columns).orderBy("attribute")


def history_pivot(history: DataFrame) -> DataFrame:
    """One row per product and time, with the price of every retailer heard then; a later point overwrites.

    A map holds the retailers, so their number is not fixed in the columns.
    """
    heard = history.filter(F.col("observed_at").isNotNull())
    last = heard.groupBy("product_id", "observed_at", "retailer_name").agg(
        F.max_by("price", F.struct("listing_id", "obs_id")).alias("price"))
    return last.groupBy("product_id", "observed_at").agg(
        F.map_from_entries(F.collect_list(F.struct("retailer_name", "price"))).alias("prices"))


def coverage_counts(summaries: DataFrame) -> DataFrame:
    live = F.col("available_offer_count") > 0
    return summaries.agg(
        F.count_if(live).alias("live_count"),
        F.count_if(~live).alias("gap_count"),
        F.count_if(F.size("retailers") <= 1).alias("single_retailer_count"),
    )


def coverage_filter(summaries: DataFrame, which: str | None = None) -> DataFrame:
    if which == "live":
        return summaries.filter(F.col("available_offer_count") > 0)
    if which == "gaps":
        return summaries.filter(F.col("available_offer_count") <= 0)
    return summaries


def health_classes(health: DataFrame) -> DataFrame:
    status = F.col("status")
    return health.agg(
        F.count_if(status == "ok").alias("healthy_count"),
        F.count_if(status.isin("failed", "stale")).alias("attention_count"),
        F.count_if(status == "running").alias("running_count"),
        F.count_if(status == "never_run").alias("never_run_count"),
    )


def bulk_eligible(decisions_with_candidate: DataFrame, *, min_score: float = BULK_ELIGIBLE_SCORE) -> DataFrame:
    return decisions_with_candidate.filter(F.coalesce("top_score", F.lit(0.0)) >= min_score)
