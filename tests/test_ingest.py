"""Merge scenarios, change capture, missing marking, run log and storage."""

from __future__ import annotations

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import NOW, table
from pricetide import schemas
from pricetide.operators import changes, ingest, runs
from pricetide.plans import review
from pricetide.sources.lineage import cut
from pricetide.sources import catalog_store

NAME = "ASUS GeForce RTX 5070 Ti OC 16GB"


def snaps(spark, *rows):
    base = dict(name=NAME, url="https://r1/p", price=1299.0, status="available", retailer_id=1, category_id=1,
                category_name="Graphics Cards", seq=1, run_id="run1")
    full = [{**base, **r} for r in rows]
    return spark.createDataFrame([[r.get(f.name) for f in schemas.SNAPSHOTS] for r in full], schemas.SNAPSHOTS)


@pytest.fixture(scope="module")
def start(spark):
    empty = schemas.empty_catalog(spark)
    return empty.with_tables(
        retailers=table(spark, "retailers", [dict(id=1, name="R", url="https://r1")]),
        categories=table(spark, "categories", [dict(id=1, name="Graphics Cards"), dict(id=2, name="CPUs")]),
    )


def only(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]


def settle(spark, cat, path):
    """Write and reload, so later steps start from files."""
    catalog_store.publish_first(cat, str(path))
    return catalog_store.load(spark, str(path))


@pytest.fixture(scope="module")
def once(spark, start, tmp_path_factory):
    done = ingest.ingest_batch(start, snaps(spark, dict(previous_price=1399.0)), as_of=NOW)
    flags = only(done.results)
    assert flags.listing_created and flags.offer_created and flags.observation_created and flags.product_created
    return settle(spark, done.catalog, tmp_path_factory.mktemp("once"))


def test_first_snapshot(once):
    p, o, d = only(once.products), only(once.offers), only(once.decisions)
    assert (p.canonical_name, p.brand, p.attributes) == (NAME, "ASUS", {"series": "RTX", "vram_gb": "16"})
    assert p.match_bucket == "graphics_cards" and p.model_key == "geforce rtx 5070 ti 16gb"
    assert (o.current_price, o.previous_price, o.is_active, o.category_id) == (1299.0, 1399.0, True, 1)
    assert (d.decision, d.confidence, d.matcher, d.product_id) == ("auto_matched", 1.0, "fingerprint", p.id)
    assert only(once.observations).price == 1299.0


def test_second_price_and_missing(spark, once, tmp_path):
    done = ingest.ingest_batch(once, snaps(spark, dict(price=1249.0, seq=2, run_id="run2")), as_of=NOW + timedelta(hours=6))
    flags = only(done.results)
    assert not flags.listing_created and not flags.product_created and flags.observation_created
    cat = settle(spark, done.catalog, tmp_path / "a")
    assert only(cat.listings) and only(cat.products) and only(cat.decisions).run_id == "run2"
    assert (only(cat.offers).current_price, only(cat.offers).previous_price) == (1249.0, 1299.0)
    assert cat.observations.count() == 2
    nothing = spark.createDataFrame([], "retailer_id long, url string")
    crawled = spark.createDataFrame([(1,)], "retailer_id long")
    gone, marked, fresh = ingest.mark_missing(cat, nothing, crawled, run_id="run3", as_of=NOW + timedelta(hours=7))
    assert marked.count() == 1
    assert (only(gone.offers).status, only(gone.offers).is_active) == ("unavailable", False)
    assert (only(fresh).in_stock, only(fresh).price) == (False, 1249.0)
    seen = spark.createDataFrame([(1, "https://r1/p")], "retailer_id long, url string")
    assert ingest.mark_missing(cat, seen, crawled, run_id="run3", as_of=NOW)[1].count() == 0


def test_unchanged_snapshot_adds_nothing(spark, once):
    done = ingest.ingest_batch(once, snaps(spark, dict(seq=2, run_id="run2")), as_of=NOW + timedelta(hours=6))
    assert not only(done.results).observation_created
    assert only(done.catalog.offers).previous_price == 1299.0


def test_rejections(spark, start):
    bad = snaps(spark, dict(name="  "), dict(price=0.0), dict(price=50001.0), dict(price=float("nan")))
    valid, rejected = ingest.validate(bad)
    assert valid.count() == 0
    assert sorted(r.problem for r in rejected.collect()) == ["blank_name"] + ["suspicious_price"] * 3
    assert ingest.validate(snaps(spark, dict(price=None, status="unavailable")))[0].count() == 1


@pytest.fixture(scope="module")
def ambiguous(spark, start, tmp_path_factory):
    target = dict(id="t", canonical_name="ASUS GeForce RTX 5070 Ti 16GB", category_id=1, brand="ASUS",
                  model_key="geforce rtx 5070 ti", fingerprint="foreign", attributes={"series": "RTX"}, is_active=True,
                  created_at=NOW, updated_at=NOW)
    cat = start.with_tables(products=table(spark, "products", [target]))
    title = "ASUS Dual GeForce RTX 5070 Ti OC White 16GB 3-Fan"
    return cat, title


def test_ambiguous_goes_to_review_then_manual_match_survives(spark, ambiguous, tmp_path):
    cat, _ = ambiguous
    title = "ASUS GeForce RTX 5070 OC 12GB"
    done = ingest.ingest_batch(cat, snaps(spark, dict(name=title)), as_of=NOW)
    cat = settle(spark, done.catalog, tmp_path / "b")
    d = only(cat.decisions)
    assert (d.decision, d.product_id, d.matcher) == ("needs_review", None, "candidate_rank")
    assert 0.75 <= d.confidence < 0.96 and cat.products.count() == 2
    chosen = spark.createDataFrame([(d.id, "manual_matched", "t", None, 1)],
                                   "decision_id string, decision string, product_id string, rationale string, seq long")
    resolved, refused = review.resolve(cat, chosen)
    assert refused.count() == 0
    cat = settle(spark, resolved, tmp_path / "c")
    again = ingest.ingest_batch(cat, snaps(spark, dict(name=title, price=1249.0, seq=2, run_id="run2")), as_of=NOW + timedelta(hours=1))
    d = only(again.catalog.decisions)
    assert (d.decision, d.product_id, d.run_id) == ("manual_matched", "t", "run2")
    o = only(again.catalog.offers)
    assert (o.product_id, o.current_price, o.is_active) == ("t", 1249.0, True)


def test_rejected_listing_stays_inactive_and_conflict_is_set_aside(spark, once, tmp_path):
    d = only(once.decisions)
    schema = "decision_id string, decision string, product_id string, rationale string, seq long"
    rejected, _ = review.resolve(once, spark.createDataFrame([(d.id, "manual_rejected", None, None, 1)], schema))
    cat = settle(spark, rejected, tmp_path / "d")
    done = ingest.ingest_batch(cat, snaps(spark, dict(price=1200.0, seq=2, run_id="run2")), as_of=NOW + timedelta(hours=1))
    o = only(done.catalog.offers)
    assert (o.is_active, o.status, o.current_price) == (False, "available", 1200.0)
    matched, _ = review.resolve(once, spark.createDataFrame([(d.id, "manual_matched", d.product_id, None, 1)], schema))
    cat = settle(spark, matched, tmp_path / "e")
    other = snaps(spark, dict(category_id=2, category_name="CPUs", seq=2, run_id="run2"))
    done = ingest.ingest_batch(cat, other, as_of=NOW + timedelta(hours=1))
    assert done.conflicts.count() == 1 and only(done.catalog.offers).current_price == 1299.0


def test_shared_fingerprint_in_one_batch(spark, start):
    rows = [dict(url=f"https://r1/{i}", seq=i, name=NAME + (" Black" if i == 3 else "")) for i in range(1, 5)]
    done = ingest.ingest_batch(start, snaps(spark, *rows), as_of=NOW)
    p = only(done.catalog.products)
    assert p.canonical_name == NAME + " Black"
    assert done.catalog.offers.filter(F.col("product_id") == p.id).count() == 4
    made = {r.url: r.product_created for r in done.results.collect()}
    assert made == {"https://r1/1": True, "https://r1/2": False, "https://r1/3": False, "https://r1/4": False}


@pytest.mark.parametrize("slices", [1, 4])
def test_change_capture_equals_replay(spark, slices):
    rng = random.Random(slices)
    rows, stored = [], {}
    for key in "abcdef":
        if key in "bd":
            stored[key] = ("available", 5.0, 5.0)
        for i in range(rng.randint(1, 60 if key == "a" else 8)):
            rows.append((key, rng.randint(0, 10**6) * 10 + len(rows) % 10, rng.choice([None, 5.0, 6.0]), rng.choice(["available", "unavailable"])))
    rows = list({(r[0], r[1]): r for r in rows}.values())
    want = {}
    for key in "abcdef":
        status, current, observed = stored.get(key, (None, None, None))
        for _, seq, price, now in sorted(r for r in rows if r[0] == key):
            change = price is not None and (observed is None or observed != price or status != now)
            want[key, seq] = (change, current if status is not None else None)
            if change:
                observed = price
            status, current = now, price
    prior = spark.createDataFrame([(k, *v) for k, v in stored.items()], "key string, prior_status string, prior_price double, prior_observed double")
    df = spark.createDataFrame(rows, "key string, seq long, price double, status string")
    out = changes.follow(df, prior, slices=slices).select("key", "seq", changes.is_change().alias("c"), F.col("before.price").alias("p"))
    assert {(r.key, r.seq): (r.c, r.p) for r in out.collect()} == want


def test_run_summary(spark):
    res = spark.createDataFrame([("r", True), ("r", False), ("q", False)], "run_id string, listing_created boolean")
    rej = spark.createDataFrame([("r",), ("r",)], "run_id string")
    pages = spark.createDataFrame([("r", True), ("r", False), ("q", False)], "run_id string, failed boolean")
    gates = spark.createDataFrame(
        [("q", "waits", "cloudflare_challenge")] * 2 + [("q", "clears", "cloudflare_challenge"), ("q", "failures", "http_403")],
        "run_id string, kind string, gate string")
    out = {r.run_id: r for r in runs.run_summary(res, rej, pages, gates).collect()}
    assert (out["r"].listings_seen, out["r"].listings_created, out["r"].listings_updated, out["r"].status) == (4, 1, 1, "partial")
    assert out["r"].error_summary == "1 category/page failures; 2 item failures"
    assert out["q"].status == "succeeded"
    assert out["q"].error_summary == ("2 gate waits (cloudflare_challenge:2); 1 gates auto-cleared (cloudflare_challenge:1); "
                                      "1 gates failed to clear (http_403:1)")
    opened = runs.open_runs(spark.createDataFrame([("r", 1, "s"), ("q", 1, "s")], "id string, retailer_id long, scraper_name string"), as_of=NOW)
    failed = spark.createDataFrame([("r", "top-level failure")], "run_id string, detail string")
    marked = spark.createDataFrame([("q", 3)], "run_id string, n long")
    closed = {r.id: r for r in runs.close_runs(opened, runs.run_summary(res, rej, pages, gates), as_of=NOW, marked=marked, failed=failed).collect()}
    assert closed["r"].status == "failed"
    assert closed["r"].error_summary == "top-level failure; 1 category/page failures; 2 item failures"
    assert closed["q"].listings_updated == 4 and closed["q"].finished_at == NOW


def test_clear_and_seed(spark, seed):
    cleared = catalog_store.clear_catalog(seed)
    assert all(getattr(cleared, n).count() == 0 for n in catalog_store.CLEARED)
    assert cleared.runs.count() == 2 and cleared.retailers.count() == 2
    known = spark.createDataFrame([(77, "Umart", "https://kept", None)], schemas.RETAILERS)
    merged = {r.name: r for r in catalog_store.upsert_retailers(known, catalog_store.seed_retailers(spark)).collect()}
    assert len(merged) == 8 and merged["Umart"].id == 77 and merged["Umart"].url == "https://kept"
    assert merged["Umart"].logo_url == "assets/logos/umart.png"
    cats = catalog_store.upsert_categories(spark.createDataFrame([(5, "CPUs")], schemas.CATEGORIES), catalog_store.seed_categories(spark))
    assert cats.count() == 10 and cats.filter("name = 'CPUs'").first().id == 5


def test_publish_reads_only_committed_versions(spark, seed, tmp_path):
    base = str(tmp_path / "store")
    catalog_store.publish_first(seed, base)
    extra = seed.observations.limit(1).withColumn("id", F.lit("new"))
    extra.withColumn("day", F.to_date("observed_at")).write.partitionBy("day").parquet(f"{base}/observations/version=2")
    assert catalog_store.load(spark, base).observations.count() == 6
    catalog_store.publish(seed, base, 2, new_observations=extra)
    assert catalog_store.load(spark, base).observations.count() == 7
    assert catalog_store.load(spark, base, version=1).observations.count() == 6


def test_enum_names_are_normalized(spark):
    raw = spark.createDataFrame([("EOL",), ("AVAILABLE",), ("odd",)], "status string")
    out = catalog_store.normalize_enums("offers", raw)
    assert [r.status for r in out.collect()] == ["end_of_life", "available", "odd"]
    assert [r.status for r in catalog_store.bad_enum_rows("offers", out).collect()] == ["odd"]


def test_store_keeps_one_history(spark, seed, tmp_path):
    """Publishing again, without new rows, after a clear, and reading older versions."""
    base, none = str(tmp_path / "store"), seed.observations.limit(0)
    catalog_store.publish_first(seed, base)
    catalog_store.publish(catalog_store.load(spark, base), base, 2, new_observations=none)
    assert catalog_store.load(spark, base).observations.count() == 6
    catalog_store.publish_cleared(catalog_store.load(spark, base), base, 3)
    cleared = catalog_store.load(spark, base)
    assert all(getattr(cleared, n).count() == 0 for n in catalog_store.CLEARED) and cleared.runs.count() == 2
    extra = seed.observations.limit(2)
    catalog_store.publish(seed, base, 4, new_observations=extra)
    assert catalog_store.load(spark, base).observations.count() == 2
    assert catalog_store.load(spark, base, version=2).observations.count() == 6


def test_relational_rows_take_catalog_types(spark):
    raw = spark.createDataFrame([(7, "P", 1, '{"vram_gb": "12"}', 1)], "ID bigint, canonical_name string, category_id int, attributes string, is_active int")
    row = catalog_store.typed("products", raw).first()
    assert row.attributes == {"vram_gb": "12"} and row.id == "7" and row.is_active is True and row.brand is None


def test_duplicate_identities_match_once(spark, start):
    once = ingest.ingest_batch(start, snaps(spark, dict()), as_of=NOW).catalog
    twin = once.products.withColumn("id", F.concat(F.lit("z"), "id"))
    doubled = once.with_tables(products=cut(once.products.unionByName(twin)))
    assert only(ingest.duplicate_identities(doubled.products)).products == 2
    done = ingest.ingest_batch(doubled, snaps(spark, dict(price=1111.0, seq=2, run_id="run2")), as_of=NOW + timedelta(hours=1))
    assert (done.catalog.listings.count(), done.catalog.offers.count(), done.results.count(), done.new_observations.count()) == (1, 1, 1, 1)


def test_no_category_and_repeated_sequence_are_rejected(spark, start):
    rows = [dict(url="https://r1/1", category_id=None), dict(url="https://r1/2", seq=5, price=10.0), dict(url="https://r1/2", seq=5, price=20.0)]
    done = ingest.ingest_batch(start, snaps(spark, *rows), as_of=NOW)
    assert sorted(r.problem for r in done.rejected.collect()) == ["no_category", "repeated_sequence"]
    row = only(done.results)
    assert row.listing_created and row.offer_created and row.product_created
    assert done.catalog.products.count() == done.catalog.offers.count() == 1


def test_no_shuffle_by_key_alone_over_all_snapshots(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("key"), F.col("id").alias("seq"),
                                    (F.col("id") % 7).cast("double").alias("price"), F.lit("available").alias("status"))
    prior = spark.createDataFrame([], "key long, prior_status string, prior_price double, prior_observed double")
    out = changes.follow(rows, prior, slices=8)
    plan = out._jdf.queryExecution().executedPlan().toString()
    wide = [line for line in plan.splitlines() if "Exchange hashpartitioning(key" in line and "_slice" not in line.split("]")[0]]
    assert out.count() == 4000 and len(wide) <= 2, plan  # one row per stretch, and the stored state


def _snapshots_with_hot_key(spark):
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 != 1, F.concat(F.lit("k"), (F.col("id") % 400).cast("string"))).alias("key"),
        F.col("id").alias("seq"), F.when(F.col("id") % 5 != 0, (F.col("id") % 7).cast("double")).alias("price"),
        F.when(F.col("id") % 11 < 6, "available").otherwise("unavailable").alias("status"))


def _followed(frame):
    rows = frame.select("key", "seq", "price", "status", "before.price", "before.status", "last_price", "is_first").collect()
    return sorted(map(repr, rows))


STATE = "key string, prior_status string, prior_price double, prior_observed double, mark int"


@pytest.mark.parametrize("carry", [None, ["mark"]])
def test_hot_keys_alone_are_cut(spark, monkeypatch, carry):
    rows = _snapshots_with_hot_key(spark)
    prior = spark.createDataFrame([("hot", "available", 3.0, 4.0, 1), ("k7", None, None, 2.0, 2)], STATE)
    want = _followed(changes.follow(rows, prior, slices=1, carry=carry))
    assert len(want) == (1000 + rows.filter("key = 'k7'").count() if carry else rows.filter("key IS NOT NULL").count())
    assert _followed(changes.follow(rows, prior, carry=carry)) == want
    monkeypatch.setattr(changes, "STRETCH_ROWS", 200)
    assert changes._hot_keys(rows, "key") == ["hot"]
    out = changes.follow(rows, prior, carry=carry)
    assert "_slice" in out._jdf.queryExecution().analyzed().toString()
    assert _followed(out) == want


def test_snapshots_are_dealt_once_without_hot_keys(spark):
    prior = spark.createDataFrame([], STATE)
    plan = changes.follow(_snapshots_with_hot_key(spark), prior)._jdf.queryExecution().sparkPlan().toString()
    # one window, one reading of the snapshots
    assert plan.count("Window [") == 1 and plan.count("Range (") == 1, plan
