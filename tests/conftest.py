from __future__ import annotations

import os
import sys
from datetime import datetime, timedelta

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pricetide import schemas  # noqa: E402

NOW = datetime(2026, 3, 1, 12, 0, 0)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


def table(spark, name: str, rows: list[dict]):
    schema = schemas.TABLE_SCHEMAS[name]
    return spark.createDataFrame([[r.get(f.name) for f in schema] for r in rows], schema)


@pytest.fixture(scope="session")
def seed(spark):
    """Small catalog: two retailers, three products, five offers, one pending decision."""
    ago = lambda **kw: NOW - timedelta(**kw)
    offer = lambda id, product, retailer, category, price, previous, status="available", active=True, seen=None: dict(
        id=id, product_id=product, listing_id="l" + id[1:], retailer_id=retailer, category_id=category,
        listing_name=f"listing {id}", listing_url=f"https://shop/{id}", currency="AUD", current_price=price,
        previous_price=previous, status=status, is_active=active, first_seen_at=NOW, last_seen_at=seen or NOW,
    )
    listing = lambda id, retailer, category, title, brand, model, strict, loose, status="available": dict(
        id=id, retailer_id=retailer, category_id=category, source_url=f"https://shop/{id}", title=title, brand=brand,
        model=model, normalized_model=strict, loose_normalized_model=loose, status=status,
        first_seen_at=NOW, last_seen_at=NOW,
    )
    product = lambda id, name, category, brand, key, attrs: dict(
        id=id, canonical_name=name, category_id=category, brand=brand, model_key=key, fingerprint=f"fp-{id}",
        attributes=attrs, is_active=True, created_at=NOW, updated_at=NOW,
    )
    run = lambda id, retailer, start, end, status: dict(
        id=id, retailer_id=retailer, started_at=start, finished_at=end, status=status, trigger_source="scraper",
        scraper_name="a", listings_seen=3, listings_created=2, listings_updated=1,
    )
    obs = lambda id, offer, at, price: dict(id=id, offer_id=offer, observed_at=at, price=price, in_stock=True)
    rows = {
        "retailers": [dict(id=1, name="A", url="https://a"), dict(id=2, name="B", url="https://b")],
        "categories": [dict(id=1, name="Graphics Cards"), dict(id=2, name="CPUs")],
        "products": [
            product("gpu", "ASUS RTX 4070 SUPER 12GB", 1, "ASUS", "rtx 4070 super 12gb", {"series": "RTX", "vram_gb": "12"}),
            product("cpu", "AMD Ryzen 7 7800X3D", 2, "AMD", "ryzen 7 7800x3d", {"socket": "AM5", "amd_series": "Ryzen 7"}),
            product("legacy", "Legacy GPU", 1, None, "legacy gpu", {}),
        ],
        "listings": [
            listing("l1", 1, 1, "ASUS RTX 4070 SUPER 12GB", "ASUS", "RTX 4070 SUPER 12GB", "rtx 4070 super 12", "rtx 4070 super 12gb"),
            listing("l2", 2, 1, "ASUS RTX 4070 SUPER 12GB", "ASUS", "RTX 4070 SUPER 12GB", "rtx 4070 super 12", "rtx 4070 super 12gb"),
            listing("l3", 1, 2, "AMD Ryzen 7 7800X3D", "AMD", "Ryzen 7 7800X3D", "ryzen 7 7800x3d", "ryzen 7 7800x3d"),
            listing("l4", 1, 1, "Legacy GPU", None, "Legacy GPU", "legacy gpu", "legacy gpu", "unavailable"),
            listing("l5", 2, None, "AMD Ryzen 7 7800X3D tray", "AMD", "Ryzen 7 7800X3D tray", "ryzen 7 7800x3d tray", "ryzen 7 7800x3d tray"),
        ],
        "offers": [
            offer("o1", "gpu", 1, 1, 1000.0, 1100.0), offer("o2", "gpu", 2, 1, 950.0, 1050.0),
            offer("o3", "cpu", 1, 2, 600.0, 650.0), offer("o4", "legacy", 1, 1, 300.0, 300.0, "unavailable", False),
            offer("o5", "cpu", 2, 2, None, None, seen=ago(days=10)),
        ],
        "runs": [
            run("r1", 1, ago(hours=2), ago(hours=1), "succeeded"), run("r2", 1, ago(minutes=30), None, "failed"),
        ],
        "observations": [
            obs("b1", "o1", ago(days=7), 1100.0), obs("b2", "o1", ago(days=1), 1000.0),
            obs("b3", "o2", ago(days=7), 1050.0), obs("b4", "o2", ago(hours=12), 950.0),
            obs("b5", "o3", ago(days=3), 650.0), obs("b6", "o3", ago(hours=4), 600.0),
        ],
        "decisions": [
            dict(id="d1", listing_id="l1", decision="needs_review", confidence=0.42, matcher="candidate_rank",
                 fingerprint="test-fingerprint-review", created_at=NOW),
        ],
    }
    return schemas.Catalog(**{name: table(spark, name, r) for name, r in rows.items()})
