"""Filters, flags and small scalar rules shared by the catalog queries."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Validation and reporting thresholds.
MAX_VALID_PRICE = 50_000.0
STALE_OFFER_DAYS = 7
STALE_RETAILER_HOURS = 36
HIGH_CONFIDENCE = 0.9
MEDIUM_CONFIDENCE = 0.6


def timestamp(as_of: datetime) -> Column:
    return F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def active_available(status="status", is_active="is_active") -> Column:
    return F.col(is_active) & (F.col(status) == "available")


def available_with_price(status="status", is_active="is_active", price="current_price") -> Column:
    return active_available(status, is_active) & F.col(price).isNotNull()


def name_matches(column: Column, search: str | None) -> Column | None:
    """Case-insensitive LIKE on the raw pattern; empty text means no filter."""
    return column.ilike(f"%{search}%") if search else None


def all_of(*conditions: Column | None) -> Column:
    given = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a & b, given, F.lit(True))


def equals(column: Column, value) -> Column | None:
    return None if value is None else column == F.lit(value)


def since(observed_at: Column, as_of: datetime, days: int) -> Column:
    return observed_at >= timestamp(as_of) - F.expr(f"INTERVAL '{int(days)}' DAY")


def before_cutoff(seen_at: Column, as_of: datetime, days: int) -> Column:
    return seen_at < timestamp(as_of) - F.expr(f"INTERVAL '{int(days)}' DAY")


def on_sale(current: Column, previous: Column) -> Column:
    return F.coalesce(current < previous, F.lit(False))


def age_hours(last_ok: Column, as_of: datetime) -> Column:
    """Whole hours since ``last_ok``, never negative, null when there was none."""
    micros = F.expr("0L") + F.timestamp_diff("MICROSECOND", last_ok, timestamp(as_of))
    hours = F.floor(micros / F.lit(3_600_000_000))
    return F.when(last_ok.isNotNull(), F.greatest(F.lit(0), hours)).cast("long")


def health_is_stale(last_status: Column, age: Column, stale_after_hours: int) -> Column:
    old = age.isNull() | (age > stale_after_hours)
    return (
        F.when(last_status == "started", F.lit(False))
        .when(last_status.isNull(), F.lit(True))
        .otherwise(old)
    )


def health_status(last_status: Column, age: Column, stale_after_hours: int) -> Column:
    old = age.isNull() | (age > stale_after_hours)
    return (
        F.when(last_status.isNull(), "never_run")
        .when(last_status == "started", "running")
        .when(last_status == "failed", "failed")
        .when(old, "stale")
        .when(last_status == "partial", "partial")
        .otherwise("ok")
    )


def severity(count: Column, critical: Column) -> Column:
    return F.when(count <= 0, "ok").when(critical, "critical").otherwise("warning")


def snapshot_problem(name: Column, price: Column) -> Column:
    """Reason a snapshot is rejected, or null. NaN sorts above every number, so it is rejected too."""
    blank = name.isNull() | (F.trim(F.regexp_replace(name, r"(?U)^\s+|\s+$", "")) == "")
    return F.when(blank, "blank_name").when((price <= 0) | (price > MAX_VALID_PRICE), "suspicious_price")
