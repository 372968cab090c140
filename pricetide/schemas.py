"""Table schemas, allowed values and the bundle of catalog tables."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Stored enum strings.
PRODUCT_STATUSES = ("available", "unavailable", "end_of_life")
RUN_STATUSES = ("started", "succeeded", "failed", "partial")
DECISIONS = ("auto_matched", "auto_rejected", "manual_matched", "manual_rejected", "needs_review")
# The member name whose stored value is spelled differently.
STATUS_NAME_ALIASES = {"eol": "end_of_life"}

_long, _str, _dbl, _bool = T.LongType(), T.StringType(), T.DoubleType(), T.BooleanType()
_ts, _map = T.TimestampNTZType(), T.MapType(T.StringType(), T.StringType())


def _schema(*cols: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


RETAILERS = _schema(("id", _long), ("name", _str), ("url", _str), ("logo_url", _str))
CATEGORIES = _schema(("id", _long), ("name", _str))
PRODUCTS = _schema(
    ("id", _str), ("canonical_name", _str), ("category_id", _long), ("brand", _str), ("model_key", _str),
    ("fingerprint", _str), ("attributes", _map), ("match_bucket", _str), ("is_active", _bool),
    ("created_at", _ts), ("updated_at", _ts),
)
LISTINGS = _schema(
    ("id", _str), ("retailer_id", _long), ("category_id", _long), ("retailer_sku", _str), ("source_url", _str),
    ("source_hash", _str), ("title", _str), ("brand", _str), ("model", _str), ("normalized_model", _str),
    ("loose_normalized_model", _str), ("image_url", _str), ("raw_payload", _str), ("status", _str),
    ("first_seen_at", _ts), ("last_seen_at", _ts),
)
OFFERS = _schema(
    ("id", _str), ("product_id", _str), ("listing_id", _str), ("retailer_id", _long), ("category_id", _long),
    ("listing_name", _str), ("listing_url", _str), ("image_url", _str), ("currency", _str),
    ("current_price", _dbl), ("previous_price", _dbl), ("status", _str), ("is_active", _bool),
    ("first_seen_at", _ts), ("last_seen_at", _ts),
)
OBSERVATIONS = _schema(
    ("id", _str), ("offer_id", _str), ("observed_at", _ts), ("price", _dbl), ("previous_price", _dbl),
    ("in_stock", _bool), ("run_id", _str), ("raw_payload", _str),
)
RUNS = _schema(
    ("id", _str), ("retailer_id", _long), ("started_at", _ts), ("finished_at", _ts), ("status", _str),
    ("trigger_source", _str), ("scraper_name", _str), ("listings_seen", _long), ("listings_created", _long),
    ("listings_updated", _long), ("error_summary", _str), ("meta", _str),
)
DECISION_LOG = _schema(
    ("id", _str), ("listing_id", _str), ("product_id", _str), ("run_id", _str), ("decision", _str),
    ("confidence", _dbl), ("matcher", _str), ("rationale", _str), ("fingerprint", _str), ("created_at", _ts),
)
SNAPSHOTS = _schema(
    ("name", _str), ("url", _str), ("price", _dbl), ("status", _str), ("image_url", _str),
    ("previous_price", _dbl), ("retailer_sku", _str), ("raw_payload", _str),
    ("retailer_id", _long), ("category_id", _long), ("category_name", _str), ("seq", _long), ("run_id", _str),
)

TABLE_SCHEMAS = {
    "retailers": RETAILERS,
    "categories": CATEGORIES,
    "products": PRODUCTS,
    "listings": LISTINGS,
    "offers": OFFERS,
    "observations": OBSERVATIONS,
    "runs": RUNS,
    "decisions": DECISION_LOG,
}


@dataclass(frozen=True)
class Catalog:
    """The eight catalog tables. Ids may be long or string as long as keys agree."""

    retailers: DataFrame
    categories: DataFrame
    products: DataFrame
    listings: DataFrame
    offers: DataFrame
    observations: DataFrame
    runs: DataFrame
    decisions: DataFrame

    def with_tables(self, **tables: DataFrame) -> "Catalog":
        return replace(self, **tables)

    def listings_of(self, ids: DataFrame) -> DataFrame:
        """The listings whose ``id`` occurs in ``ids``. A catalog that derives listing texts derives only these."""
        return self.listings.join(ids.select("id"), "id", "left_semi")

    def items(self):
        return [(f.name, getattr(self, f.name)) for f in fields(self)]


def empty_catalog(spark: SparkSession) -> Catalog:
    return Catalog(**{name: spark.createDataFrame([], schema) for name, schema in TABLE_SCHEMAS.items()})


def stored_value(name: Column) -> Column:
    """Map stored enum member names (any case) to the lower-case values used by every query."""
    low = F.lower(F.trim(name))
    out = low
    for alias, value in STATUS_NAME_ALIASES.items():
        out = F.when(low == alias, F.lit(value)).otherwise(out)
    return out


def has_allowed_value(value: Column, allowed: tuple[str, ...]) -> Column:
    return value.isNull() | value.isin(*allowed)
