"""Price-drop trends."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.operators import stats as S
from pricetide.schemas import Catalog

_MEASURES = ["initial_price", "latest_price", "price_drop_amount", "price_drop_percentage"]


def price_drops(cat: Catalog, *, as_of: datetime, days: int = 30, limit: int = 20) -> DataFrame:
    """Products whose price fell over the window, largest relative fall first."""
    moves = S.first_last_price(cat.observations, cat.offers, as_of=as_of, days=days).filter(
        F.col("initial_price") > F.col("latest_price")
    )
    amount = F.col("initial_price") - F.col("latest_price")
    percent = F.try_divide(amount * 100.0, F.col("initial_price"))
    active = cat.products.filter("is_active")
    order = [F.col("price_drop_percentage").desc(), F.col("canonical_name").asc(), F.col("id").asc()]
    top = (
        moves.withColumnRenamed("product_id", "id")
        .join(active.select("id", "canonical_name"), "id")
        .withColumns({"price_drop_amount": amount, "price_drop_percentage": percent})
        .orderBy(*order)
        .limit(limit)
        .select("id", *_MEASURES)
    )
    out = S.product_summary(
        active.join(top, "id"), cat.offers, cat.retailers, cat.categories, keep=_MEASURES
    )
    return out.orderBy(*order)
