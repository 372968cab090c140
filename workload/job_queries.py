"""Extraction, matching, merge and change-capture jobs over the driver tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from pricetide.functions import text as X
from pricetide.operators import changes, crawl, extract, ingest, runs
from pricetide.plans import client, review
from pricetide.schemas import empty_catalog
from pricetide.sources import catalog_store
from pricetide.sources.lineage import stored
from pricetide.sources.site_specs import CARD_SPECS, LinkSpec, PreviewSpec
from workload import adapter
from workload.adapter import LINE_AS_OF, catalog, lines, read
from workload.adapter_sql import listing_title, with_ctes
from workload.registry import query
from workload.match_sql import BULK_ELIGIBLE, BULK_OUTCOMES, MATCH_CTES, REVIEW_CANDIDATES, REVIEW_QUEUE
from workload.text_queries import IDENTITY_CTES, printed

# Change capture.

def _snap_status():
    return F.when(F.col("l_linestatus") == "O", "available").otherwise("unavailable")


def _snapshot_rows(spark, d):
    return lines(spark, d).select(
        F.col("offer_id").alias("key"), F.struct(*adapter.ORD).alias("seq"), "l_shipdate", F.when(F.col("l_tax") != 0, F.col("u")).alias("price"),
        _snap_status().alias("status"),
    )


@query("price_changes", with_ctes("""
SELECT offer_id, l_shipdate, l_orderkey, l_linenumber, price, status, previous_price FROM (
SELECT *, lag(price) OVER w AS previous_price, lag(status) OVER w AS previous_status, row_number() OVER w AS n,
  last_value(price IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_price
FROM (SELECT *, CASE WHEN l_tax <> 0 THEN u END AS price,
        CASE WHEN l_linestatus = 'O' THEN 'available' ELSE 'unavailable' END AS status FROM li)
WINDOW w AS (PARTITION BY offer_id ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice))
WHERE price IS NOT NULL AND (last_price IS NULL OR last_price <> price OR n = 1 OR previous_status <> status)"""))
def _(spark, d):
    rows = _snapshot_rows(spark, d)
    prior = spark.createDataFrame([], "key long, prior_status string, prior_price double, prior_observed double")
    out = changes.follow(rows, prior, by=F.unix_date(F.col("l_shipdate").cast("date")))
    return out.filter(changes.is_change()).select(
        F.col("key").alias("offer_id"), "l_shipdate", F.col("seq.l_orderkey").alias("l_orderkey"),
        F.col("seq.l_linenumber").alias("l_linenumber"), "price", "status", F.col("before.price").alias("previous_price"),
    )


# Missing marking, category mirror, seeding.

CRAWLED = "SELECT s_suppkey AS retailer_id FROM supplier WHERE s_acctbal > 0"
SEEN = "SELECT DISTINCT l_suppkey AS retailer_id, 'https://r' || l_suppkey || '.example/p/' || l_partkey AS url FROM li WHERE l_shipdate >= TIMESTAMP '1998-01-01'"
GONE = f"""SELECT l.id FROM listings l WHERE status <> 'unavailable' AND retailer_id IN ({CRAWLED})
  AND (retailer_id, source_url) NOT IN (SELECT retailer_id, url FROM ({SEEN}))"""


def _crawl(spark, d):
    seen = lines(spark, d).filter(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).select(
        F.col("l_suppkey").alias("retailer_id"), adapter._source_url().alias("url")
    ).distinct()
    crawled = read(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("retailer_id"))
    return seen, crawled


class _Tables:
    """The tables missing marking touches, with the columns it writes."""

    def __init__(self, cat):
        self.listings, self.offers = cat.listings, cat.offers
        self.observations = cat.observations.select(
            F.col("id.l_orderkey").cast("string").alias("id"), "offer_id", "observed_at", "price",
            F.lit(None).cast("double").alias("previous_price"), "in_stock", F.lit(None).cast("string").alias("run_id"),
            F.lit(None).cast("string").alias("raw_payload"),
        )

    def with_tables(self, **tables):
        self.__dict__.update(tables)
        return self


@query("missing_listings", with_ctes(GONE))
def _(spark, d):
    return ingest.missing_listings(catalog(spark, d), *_crawl(spark, d)).select("id")


@query("missing_offers", with_ctes(f"""
SELECT o.id, CASE WHEN hit THEN 'unavailable' ELSE status END AS status, CASE WHEN hit THEN false ELSE is_active END AS is_active,
  CASE WHEN hit THEN TIMESTAMP '{LINE_AS_OF}' ELSE last_seen_at END AS last_seen_at
FROM (SELECT *, listing_id IN (SELECT id FROM gone) AND NOT (status = 'unavailable' AND NOT is_active) AS hit FROM offers) o""", gone=GONE))
def _(spark, d):
    out, _, _ = ingest.mark_missing(_Tables(catalog(spark, d)), *_crawl(spark, d), run_id="r", as_of=LINE_AS_OF)
    return out.offers.select("id", "status", "is_active", "last_seen_at")


@query("missing_observations", with_ctes(f"""
SELECT id AS offer_id, current_price AS price, previous_price, false AS in_stock FROM offers
WHERE listing_id IN (SELECT id FROM gone) AND NOT (status = 'unavailable' AND NOT is_active) AND current_price IS NOT NULL""", gone=GONE))
def _(spark, d):
    _, _, fresh = ingest.mark_missing(_Tables(catalog(spark, d)), *_crawl(spark, d), run_id="r", as_of=LINE_AS_OF)
    return fresh.select("offer_id", "price", "previous_price", "in_stock")


@query("category_conflicts", with_ctes("""
SELECT o.id, o.product_id, o.category_id, p.category_id AS product_category_id FROM offers o JOIN products p ON p.id = o.product_id
WHERE o.category_id IS DISTINCT FROM p.category_id"""))
def _(spark, d):
    c = catalog(spark, d)
    return ingest.category_conflicts(c.offers, c.products)


@query("seed_retailers_upsert", with_ctes("""
SELECT coalesce(r.id, n.id) AS id, coalesce(r.name, n.name) AS name, coalesce(r.url, n.url) AS url,
  CASE WHEN n.name IS NOT NULL THEN n.logo_url ELSE r.logo_url END AS logo_url
FROM retailers r FULL JOIN (
  SELECT s_suppkey AS id, s_name AS name, 'u' AS url, 'logo/' || s_name AS logo_url FROM supplier WHERE s_acctbal > 0
  UNION ALL SELECT -n_nationkey - 1, n_name, 'u', NULL FROM nation) n ON n.name = r.name"""))
def _(spark, d):
    known = read(spark, d, "supplier").filter("s_acctbal > 0").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("u").alias("url"),
        F.concat(F.lit("logo/"), "s_name").alias("logo_url"),
    )
    new = read(spark, d, "nation").select(
        (-F.col("n_nationkey") - 1).cast("long").alias("id"), F.col("n_name").alias("name"), F.lit("u").alias("url"),
        F.lit(None).cast("string").alias("logo_url"),
    )
    return catalog_store.upsert_retailers(catalog(spark, d).retailers, known.unionByName(new))


@query("exact_identity", with_ctes("""
SELECT offer_id, product_id FROM printed JOIN (
  SELECT category_id, fingerprint, min(offer_id) AS product_id FROM printed GROUP BY 1, 2) USING (category_id, fingerprint)""", **IDENTITY_CTES))
def _(spark, d):
    rows = stored(printed(spark, d).select("offer_id", "category_id", "fingerprint"))
    products = rows.select(F.col("offer_id").alias("id"), "category_id", "fingerprint")
    return ingest.exact_matches(rows, products).select("offer_id", F.col("exact_id").alias("product_id"))



# Matching over hardware titles.


class _TitleCatalog(adapter.LazyCatalog):
    """Adapter tables whose listings carry hardware titles; their texts are worked out for the listings asked for."""

    def listings_of(self, ids):
        return self.titled(ids)


def _title_catalog(spark, d):
    """Adapter tables with hardware titles: products from parts, listings from (part, supplier) pairs."""
    k = F.col("p_partkey")
    # A few megabytes of keys are minutes of text work, so tasks are fixed by count, not by the size of the files.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = read(spark, d, "part").select("p_partkey").repartition(tasks, "p_partkey").select(
        k.alias("id"), adapter.title_category_id(k).alias("category_id"), adapter.title_category(k).alias("category_name"),
        adapter.product_title(k).alias("name"), (k % 20 != 0).alias("is_active"),
    )
    products = ingest.identify(parts).select(
        "id", F.col("name").alias("canonical_name"), "category_id", "brand",
        X.first_text(F.col("loose_normalized_model"), F.col("normalized_model"), F.col("model")).alias("model_key"),
        "fingerprint", "attributes", "is_active",
    )

    def texts(wanted=None):
        named = adapter.titles(spark, d, wanted).withColumnRenamed("title", "name")
        return ingest.identify(named if wanted is None else named.repartition(tasks, "offer_id")).select(
            F.col("offer_id").alias("id"), F.col("name").alias("title"), "brand", "model", "normalized_model", "loose_normalized_model",
            F.col("l_suppkey").alias("retailer_id"), F.when(F.col("l_suppkey") % 10 != 7, F.col("category_id")).alias("category_id"),
        )

    base = _TitleCatalog(spark, d)
    base.__dict__.update(products=products, listings=texts(), titled=texts, categories=adapter.title_categories(spark, d))
    return base


@query("review_candidates", with_ctes(REVIEW_CANDIDATES, **MATCH_CTES))
def _(spark, d):
    out = review.decision_candidates(_title_catalog(spark, d))
    return out.withColumn("reasons", F.array_join("reasons", "; "))


@query("review_queue_top_candidate", with_ctes(REVIEW_QUEUE, **MATCH_CTES))
def _(spark, d):
    c = _title_catalog(spark, d)
    c.listings = c.listings.withColumns({"source_url": F.lit(""), "status": F.lit("available")})
    return review.pending_with_top_candidate(c, limit=500).withColumn("top_reasons", F.array_join("top_reasons", "; "))


@query("bulk_eligible_decisions", with_ctes(BULK_ELIGIBLE.format(least=client.BULK_ELIGIBLE_SCORE), **MATCH_CTES))
def _(spark, d):
    rows = review.decision_candidates(_title_catalog(spark, d), k=1)
    return client.bulk_eligible(rows.select("decision_id", "product_id", F.col("score").alias("top_score")))


@query("bulk_accept_outcomes", with_ctes(BULK_OUTCOMES, **MATCH_CTES))
def _(spark, d):
    c = _title_catalog(spark, d)
    return review.bulk_outcomes(c, c.decisions.select("id"))


# Manual resolution of every order's decision, some of it refused, and some resolved again later.

LATER = 1_000_000_000
RESOLVE_CTES = {
    "asked": f"""SELECT CASE WHEN o_orderkey % 11 = 0 THEN -o_orderkey ELSE o_orderkey END AS decision_id,
        CASE WHEN o_orderkey % 7 = 0 THEN 'auto_matched' WHEN o_orderkey % 2 = 0 THEN 'manual_matched' ELSE 'manual_rejected' END AS decision,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN -1 ELSE o_custkey % 200 + 1 END AS product_id,
        CASE WHEN o_orderkey % 3 <> 0 THEN 'by ' || o_custkey END AS rationale, o_orderkey AS seq FROM orders
      UNION ALL SELECT o_orderkey, 'manual_rejected', NULL, NULL, o_orderkey + {LATER} FROM orders WHERE o_orderkey % 4 = 1""",
    "checked": """SELECT a.*, d.listing_id, p.category_id AS product_category, CASE WHEN a.decision NOT IN ('manual_matched', 'manual_rejected') THEN 'unsupported_decision'
        WHEN d.listing_id IS NULL THEN 'decision_not_found' WHEN a.decision = 'manual_matched' AND a.product_id IS NULL THEN 'product_required'
        WHEN a.decision = 'manual_matched' AND p.category_id IS NULL THEN 'product_not_found'
        WHEN a.decision = 'manual_matched' AND l.category_id <> p.category_id THEN 'category_mismatch' END AS problem
      FROM asked a LEFT JOIN decisions d ON d.id = a.decision_id LEFT JOIN listings l ON l.id = d.listing_id LEFT JOIN products p ON p.id = a.product_id""",
    "settled": """SELECT decision_id, arg_max({'d': decision, 'p': product_id}, seq) AS r, arg_max(rationale, seq) FILTER (rationale IS NOT NULL) AS why
      FROM checked WHERE problem IS NULL GROUP BY 1""",
    "held": """SELECT listing_id, arg_max(decision = 'manual_matched', seq) AS keep,
        arg_max({'p': product_id, 'c': product_category}, seq) FILTER (decision = 'manual_matched') AS moved
      FROM checked WHERE problem IS NULL GROUP BY 1""",
}


def _resolved(spark, d):
    cat = catalog(spark, d)
    orders, key, customer = read(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    asked = orders.select(
        F.when(key % 11 == 0, -key).otherwise(key).alias("decision_id"),
        F.when(key % 7 == 0, "auto_matched").when(key % 2 == 0, "manual_matched").otherwise("manual_rejected").alias("decision"),
        F.when(key % 5 == 0, None).when(key % 13 == 0, -1).otherwise(customer % 200 + 1).cast("long").alias("product_id"),
        F.when(key % 3 != 0, F.concat(F.lit("by "), customer.cast("string"))).alias("rationale"), key.alias("seq"))
    again = orders.filter(key % 4 == 1).select(
        key.alias("decision_id"), F.lit("manual_rejected").alias("decision"), F.lit(None).cast("long").alias("product_id"),
        F.lit(None).cast("string").alias("rationale"), (key + LATER).alias("seq"))
    return review.resolve(cat.with_tables(decisions=cat.decisions.withColumn("rationale", F.lit("open"))), asked.unionByName(again))


@query("resolved_decisions", with_ctes("""
SELECT d.id, coalesce(r.d, decision) AS decision, CASE WHEN r IS NULL THEN product_id WHEN r.d = 'manual_matched' THEN r.p END AS product_id,
  CASE WHEN r IS NULL THEN matcher ELSE 'manual_review' END AS matcher, CASE WHEN r IS NULL THEN confidence ELSE 1.0::DOUBLE END AS confidence,
  coalesce(why, 'open') AS rationale FROM decisions d LEFT JOIN settled ON decision_id = d.id""", **RESOLVE_CTES))
def _(spark, d):
    return _resolved(spark, d)[0].decisions.select("id", "decision", "product_id", "matcher", "confidence", "rationale")


@query("resolved_offers", with_ctes("""
SELECT o.id, coalesce(moved.p, product_id) AS product_id, CASE WHEN moved IS NULL THEN category_id ELSE moved.c END AS category_id,
  CASE WHEN keep IS NULL THEN is_active ELSE keep AND status = 'available' END AS is_active FROM offers o LEFT JOIN held ON held.listing_id = o.listing_id""", **RESOLVE_CTES))
def _(spark, d):
    return _resolved(spark, d)[0].offers.select("id", "product_id", "category_id", "is_active")


@query("refused_resolutions", with_ctes("SELECT decision_id, seq, problem FROM checked WHERE problem IS NOT NULL", **RESOLVE_CTES))
def _(spark, d):
    return _resolved(spark, d)[1].select("decision_id", "seq", "problem")


# Merge of all snapshots, in two batches split by date.


def _batches(spark, d):
    day = F.unix_date(F.col("l_shipdate").cast("date")).cast("long")
    seq = day * 10_000_000_000_000 + F.col("l_orderkey") * 10 + F.col("l_linenumber")
    k = F.col("l_partkey")
    rows = lines(spark, d).select(
        adapter.listing_title(k, F.col("l_suppkey")).alias("name"), adapter._source_url().alias("url"),
        F.when(F.col("l_tax") != 0, F.col("l_extendedprice")).alias("price"), _snap_status().alias("status"),
        F.lit(None).cast("string").alias("image_url"), F.lit(None).cast("double").alias("previous_price"),
        F.lit(None).cast("string").alias("retailer_sku"), F.lit(None).cast("string").alias("raw_payload"),
        F.col("l_suppkey").alias("retailer_id"), adapter.title_category_id(k).alias("category_id"),
        adapter.title_category(k).alias("category_name"), seq.alias("seq"), "l_shipdate",
    )
    split = F.lit("1998-07-01").cast("timestamp_ntz")
    first = rows.filter(F.col("l_shipdate") < split).withColumn("run_id", F.lit("first"))
    second = rows.filter(F.col("l_shipdate") >= split).withColumn("run_id", F.lit("second"))
    return first.drop("l_shipdate"), second.drop("l_shipdate")


def _merged(spark, d):
    first, second = _batches(spark, d)
    one = ingest.ingest_batch(empty_catalog(spark), first, as_of=datetime(1998, 7, 1))
    done = one.catalog.with_tables(**{n: stored(t) for n, t in one.catalog.items() if n in ("products", "listings", "offers", "observations", "decisions")})
    return ingest.ingest_batch(done, second, as_of=LINE_AS_OF)


@query("ingest_offers", with_ctes("""
SELECT listing_url, current_price, previous_price, status, status = 'available' AS is_active FROM (
  SELECT *, price AS current_price, lag(price) OVER w AS previous_price,
    row_number() OVER (PARTITION BY listing_url ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS rn
  FROM (SELECT *, 'https://r' || l_suppkey || '.example/p/' || l_partkey AS listing_url,
          CASE WHEN l_tax <> 0 THEN l_extendedprice END AS price,
          CASE WHEN l_linestatus = 'O' THEN 'available' ELSE 'unavailable' END AS status FROM li)
  WHERE price IS NULL OR (price > 0 AND price <= 50000)
  WINDOW w AS (PARTITION BY listing_url ORDER BY l_shipdate, l_orderkey, l_linenumber)) WHERE rn = 1"""))
def _(spark, d):
    return _merged(spark, d).catalog.offers.select("listing_url", "current_price", "previous_price", "status", "is_active")


@query("ingest_decisions")
def _(spark, d):
    return _merged(spark, d).catalog.decisions.select("listing_id", "product_id", "decision", "confidence", "matcher", "rationale", "fingerprint")


@query("ingest_products")
def _(spark, d):
    return _merged(spark, d).catalog.products.select("id", "canonical_name", "category_id", "brand", "model_key", "fingerprint", "match_bucket")


SNAPS = """SELECT *, lag(price) OVER w AS before_price, row_number() OVER w AS n, row_number() OVER (w2) AS rn,
    last_value(price IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_price, lag(status) OVER w AS before_status
  FROM (SELECT *, 'https://r' || l_suppkey || '.example/p/' || l_partkey AS url,
          CASE WHEN l_tax <> 0 THEN l_extendedprice END AS price,
          CASE WHEN l_linestatus = 'O' THEN 'available' ELSE 'unavailable' END AS status FROM li)
  WHERE price IS NULL OR (price > 0 AND price <= 50000)
  WINDOW w AS (PARTITION BY url ORDER BY l_shipdate, l_orderkey, l_linenumber), w2 AS (PARTITION BY url ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC)"""


@query("ingest_listings", with_ctes(f"""
SELECT url AS source_url, name AS title, status, retailer_id FROM (
  SELECT *, {listing_title('l_partkey', 'l_suppkey')} AS name, l_suppkey AS retailer_id FROM ({SNAPS})) WHERE rn = 1"""))
def _(spark, d):
    return _merged(spark, d).catalog.listings.select("source_url", "title", "status", "retailer_id")


@query("ingest_results", with_ctes(f"""
SELECT url, retailer_id, n = 1 AS listing_created, n = 1 AS offer_created,
  price IS NOT NULL AND (last_price IS NULL OR last_price <> price OR n = 1 OR before_status <> status) AS observation_created
FROM (SELECT *, l_suppkey AS retailer_id FROM ({SNAPS})) WHERE l_shipdate >= TIMESTAMP '1998-07-01'"""))
def _(spark, d):
    return _merged(spark, d).results.select("url", "retailer_id", "listing_created", "offer_created", "observation_created")


# Run log over the driver tables: results and refusals from line items, page outcomes from orders, gates from events.

GATE_KINDS = {"click": "waits", "view": "clears", "purchase": "failures"}
RUN_PARTS = {
    "run_results": "SELECT CAST(l_suppkey AS VARCHAR) AS run_id, l_linenumber = 1 AS listing_created FROM li WHERE l_extendedprice <= 50000",
    "run_refused": "SELECT CAST(l_suppkey AS VARCHAR) AS run_id, count(*) AS item_errors FROM li WHERE l_extendedprice > 50000 GROUP BY 1",
    "run_pages": "SELECT CAST(o_custkey % 150 AS VARCHAR) AS run_id, count(*) FILTER (WHERE o_orderstatus = 'P') AS category_errors FROM orders GROUP BY 1",
    "run_merged": "SELECT run_id, count(*) AS merged, count(*) FILTER (WHERE listing_created) AS listings_created FROM run_results GROUP BY 1",
    "run_gates": "SELECT CAST(user_id % 150 AS VARCHAR) AS run_id, CASE event_type " + " ".join(
        f"WHEN '{e}' THEN '{k}'" for e, k in GATE_KINDS.items()) + " END AS kind, 'g' || CAST(event_id % 3 AS VARCHAR) AS gate FROM events",
    "run_gate_text": "SELECT run_id, kind, sum(n) AS total, string_agg(gate || ':' || n, ', ' ORDER BY gate) AS listed FROM ("
                     "SELECT run_id, kind, gate, count(*) AS n FROM run_gates WHERE kind IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2",
    "run_ids": "SELECT run_id FROM run_merged UNION SELECT run_id FROM run_refused UNION SELECT run_id FROM run_pages UNION SELECT run_id FROM run_gate_text",
    "run_text": """SELECT run_id, max(CASE WHEN kind = 'waits' THEN total || ' gate waits (' || listed || ')' END) AS waits,
      max(CASE WHEN kind = 'clears' THEN total || ' gates auto-cleared (' || listed || ')' END) AS clears,
      max(CASE WHEN kind = 'failures' THEN total || ' gates failed to clear (' || listed || ')' END) AS failures FROM run_gate_text GROUP BY 1""",
    "summarized": """SELECT run_id, coalesce(merged, 0) + coalesce(item_errors, 0) AS listings_seen, coalesce(listings_created, 0) AS listings_created,
      coalesce(merged - listings_created, 0) AS listings_updated,
      CASE WHEN coalesce(item_errors, 0) + coalesce(category_errors, 0) > 0 THEN 'partial' ELSE 'succeeded' END AS status,
      nullif(concat_ws('; ', CASE WHEN category_errors > 0 THEN category_errors || ' category/page failures' END,
        CASE WHEN item_errors > 0 THEN item_errors || ' item failures' END, waits, clears, failures), '') AS error_summary
    FROM run_ids LEFT JOIN run_merged USING (run_id) LEFT JOIN run_refused USING (run_id) LEFT JOIN run_pages USING (run_id) LEFT JOIN run_text USING (run_id)""",
}


def _run_summary(spark, d):
    rows = lines(spark, d).select(F.col("l_suppkey").cast("string").alias("run_id"), "l_linenumber", "l_extendedprice")
    fine = F.col("l_extendedprice") <= 50000
    pages = read(spark, d, "orders").select((F.col("o_custkey") % 150).cast("string").alias("run_id"), (F.col("o_orderstatus") == "P").alias("failed"))
    kind = F.coalesce(*[F.when(F.col("event_type") == e, F.lit(k)) for e, k in GATE_KINDS.items()])
    gates = read(spark, d, "events").select((F.col("user_id") % 150).cast("string").alias("run_id"), kind.alias("kind"),
                                            F.concat(F.lit("g"), (F.col("event_id") % 3).cast("string")).alias("gate"))
    return runs.run_summary(rows.filter(fine).select("run_id", (F.col("l_linenumber") == 1).alias("listing_created")),
                            rows.filter(~fine).select("run_id"), pages, gates.filter("kind is not null"))


@query("run_summary", with_ctes("SELECT * FROM summarized", **RUN_PARTS))
def _(spark, d):
    return _run_summary(spark, d)


@query("closed_runs", with_ctes(f"""
SELECT CAST(s_suppkey AS VARCHAR) AS id, CASE WHEN s_acctbal < 0 THEN 'failed' WHEN run_id IS NULL THEN 'started' ELSE r.status END AS status,
  CASE WHEN s_acctbal < 0 OR run_id IS NOT NULL THEN TIMESTAMP '{LINE_AS_OF}' END AS finished_at, coalesce(listings_seen, 0) AS listings_seen,
  coalesce(listings_updated, 0) + CASE WHEN s_acctbal < 0 OR run_id IS NOT NULL THEN s_nationkey ELSE 0 END AS listings_updated,
  nullif(concat_ws('; ', CASE WHEN s_acctbal < 0 THEN 'stopped by ' || s_name END, error_summary), '') AS error_summary
FROM supplier LEFT JOIN summarized r ON r.run_id = CAST(s_suppkey AS VARCHAR)""", **RUN_PARTS))
def _(spark, d):
    suppliers = read(spark, d, "supplier").withColumn("run_id", F.col("s_suppkey").cast("string"))
    opened = runs.open_runs(suppliers.select(F.col("run_id").alias("id"), F.col("s_suppkey").alias("retailer_id"), F.col("s_name").alias("scraper_name")), as_of=datetime(1998, 7, 1))
    marked = suppliers.select("run_id", F.col("s_nationkey").cast("long").alias("n"))
    failed = suppliers.filter("s_acctbal < 0").select("run_id", F.concat(F.lit("stopped by "), "s_name").alias("detail"))
    return runs.close_runs(opened, _run_summary(spark, d), as_of=LINE_AS_OF, marked=marked, failed=failed).select(
        "id", "status", "finished_at", "listings_seen", "listings_updated", "error_summary")


# Page jobs.


def _pages(spark, d):
    return read(spark, d, "pages")


@query("page_gates", r"""
SELECT page_id, CASE WHEN contains(b, 'cloudflare') AND (t = 'just a moment...' OR contains(b, 'performing security verification')
    OR contains(b, 'cf-turnstile-response')) THEN 'cloudflare_challenge'
  WHEN t = '403 forbidden' OR contains(b, '<h1>403 forbidden</h1>') OR contains(b, 'error code: 403') THEN 'http_403'
  WHEN contains(t, 'access denied') OR contains(b, 'access denied') THEN 'access_denied' END AS gate
FROM (SELECT page_id, lower(html) AS b, lower(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))) AS t FROM pages)""")
def _(spark, d):
    html = F.col("html")
    return _pages(spark, d).select("page_id", extract.gate(extract.page_title(html), html).alias("gate"))


@query("page_links", r"""
SELECT DISTINCT url AS page_url, 'nav' AS kind, regexp_extract(url, '^(https?://[^/?#]+)', 1) || href AS target_url
FROM (SELECT url, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">', 1)) AS href FROM pages)""")
def _(spark, d):
    spec = LinkSpec("any", "nav", "", "nav li a", every=True)
    return extract.links(_pages(spark, d).withColumn("site", F.lit("any")), [spec])


#: visible text of marked-up text: without comments, scripts and styles, each tag a blank, entities read
VISIBLE = r"regexp_replace(regexp_replace({html}, '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<!doctype[^>]*>', ' ', 'g'), '<[^>]*>', ' ', 'g')"
for _entity, _sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    VISIBLE = f"replace({VISIBLE}, '{_entity}', '{_sign}')"


@query("page_previews", rf"""
SELECT url AS page_url, 'any' AS site, CAST(1 AS INTEGER) AS position, trim(regexp_replace({VISIBLE.format(html="regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")}, '\s+', ' ', 'g')) AS name,
  CAST(NULL AS VARCHAR) AS href FROM pages WHERE regexp_matches(html, '(?i)<article')""")
def _(spark, d):
    spec = PreviewSpec("any", "article", "h1", "nav li a")
    return extract.previews(_pages(spark, d).withColumn("site", F.lit("any")), [spec])


@query("page_snippets", f"SELECT url, left(trim(regexp_replace({VISIBLE.format(html='html')}, '\\s+', ' ', 'g')), {extract.SNIPPET_LIMIT}) AS snippet FROM pages")
def _(spark, d):
    return extract.page_texts(_pages(spark, d)).select("url", extract.snippet(F.col("body_text")).alias("snippet"))


TASKS = r"""SELECT DISTINCT regexp_extract(url, '^(https?://[^/?#]+)', 1) AS task_url, 'site' AS category FROM pages
  UNION SELECT DISTINCT regexp_extract(url, '^(https?://[^/?#]+/[a-z]+)', 1), regexp_extract(url, '^https?://[^/?#]+/([a-z]+)', 1) FROM pages"""


@query("page_categories", f"""
SELECT p.page_id, arg_max(t.category, (length(t.task_url), t.category)) AS category_name
FROM pages p LEFT JOIN (SELECT * FROM ({TASKS}) WHERE task_url <> '') t ON starts_with(p.url, t.task_url) GROUP BY 1""")
def _(spark, d):
    host, path = r"^(https?://[^/?#]+)", r"^(https?://[^/?#]+/[a-z]+)"
    urls = _pages(spark, d).select("url")
    tasks = (
        urls.select(F.regexp_extract("url", host, 1).alias("task_url"), F.lit("site").alias("category"))
        .unionByName(urls.select(F.regexp_extract("url", path, 1).alias("task_url"),
                                 F.regexp_extract("url", r"^https?://[^/?#]+/([a-z]+)", 1).alias("category")))
        .filter("task_url <> ''").distinct()
    )
    return extract.category_of(_pages(spark, d).select("page_id", "url"), tasks).select("page_id", "category_name")


@query("page_capture_status", r"""
SELECT page_id, CASE WHEN contains(b, 'access denied') THEN 'blocked' WHEN length(html) > 20000 THEN 'timeout'
  WHEN length(html) < 1000 THEN 'error' ELSE 'ok' END AS status FROM (SELECT *, lower(html) AS b FROM pages)""")
def _(spark, d):
    size = F.length("html")
    outcome = F.when(size > 20000, "timeout").when(size < 1000, "failed to load")
    blocked = F.when(F.lower("html").contains("access denied"), "access_denied")
    return _pages(spark, d).select("page_id", extract.capture_status(outcome, blocked).alias("status"))


SITES = ["computeralliance", "centrecom", "jw", "msy", "umart", "pccg", "scorptec", "shoppingexpress"]
BASES = {s.site: s.base_url for s in CARD_SPECS}


def _card_pages(spark, d, page=None, more=()):
    """One captured page per lineitem row, in the markup of one of the eight sites."""
    k, site_no = F.col("l_partkey"), (F.col("l_suppkey") % 8).cast("int")
    shown = F.replace(F.replace(F.col("title"), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    # A few megabytes of keys are minutes of markup to read, so tasks are fixed by count, not by the size of the files.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = lines(spark, d).repartition(tasks, "l_orderkey", "l_linenumber", "offer_id").withColumns(
        {"title": adapter.listing_title(k, F.col("l_suppkey")), "price_text": adapter.price_text(),
         "href": F.concat(F.lit("/p/"), k.cast("string"), F.lit("?s="), F.col("l_suppkey").cast("string"))}
    ).withColumn("shown", shown)

    def fill(template: str):
        parts = []
        for piece in template.split("@"):
            parts.append(F.col({"T": "shown", "P": "price_text", "H": "href"}[piece]) if piece in ("T", "P", "H") else F.lit(piece))
        return F.concat(*parts)

    shelf = lambda row: f'<ul id="goods_sty"><li class="ad">ad</li>{row}</ul>'
    markup = [
        '<article class="item product"><a class="go" data-pjax="1" href="@H@"><i></i><div><h2 class="t equalize">@T@</h2></div><div class="from price">@P@</div></a></article>',
        '<div class="wide product-grid"><hr><div class="prbox_box sale"><div class="saleprice">@P@</div><a class="big prbox_link" href="@H@">see</a><div class="prbox_name">@T@</div></div></div>',
        '<div class="ais-InfiniteHits-item"><div class="row"><a class="result" href="@H@"><div><div class="result-title">@T@</div></div></a></div><div class="after_special">@P@</div></div>',
        shelf('<li class="goods_info new"><div class="goods_name"><em>hot</em><a title="@T@" href="@H@">short</a></div><div class="goods-price">@P@</div></li>'),
        shelf('<li class="goods_info"><div class="goods-price">@P@</div><div class="goods_name"><a title="" href="@H@">@T@</a></div></li>'),
        '<div data-product-card-container="9"><div data-product-price-current="">@P@</div><div data-product-card-title=""><a href="@H@">@T@</a></div></div>'
        '<section class="tall product-container list-view"><a class="product-title" href="/other">not this layout</a><b class="price">$1</b></section>',
        '<div class="product-list-detail odd"><div class="detail-product-price">@P@</div><div class="detail-product-title"><a href="@H@">@T@</a></div></div>',
        '<div class="wrapper-thumbnail"><div class="caption"><p>deal</p><a title="@T@" href="@H@">more</a></div><p class="price"><span>@P@</span></p></div>',
    ]
    # one site shows two layouts: the first is missing on every other page
    second = '<section class="tall product-container list-view"><b class="price">@P@</b><div><a class="product-title" href="@H@">@T@</a></div></section>'
    html = F.coalesce(F.when((site_no == 5) & (F.col("l_quantity") % 2 == 0), fill(second)), *[F.when(site_no == i, fill(m)) for i, m in enumerate(markup)])
    site = F.element_at(F.array(*[F.lit(s) for s in SITES]), site_no + 1)
    if page is None:
        page = F.concat_ws("-", F.lit("page"), "l_orderkey", "l_linenumber", "offer_id", F.col("l_extendedprice").cast("string"))
    return rows.select(page.alias("url"), site.alias("site"), F.concat(F.lit("<html><body>"), html, F.lit("</body></html>")).alias("html"), *more)


def _crawl_pages(spark, d):
    """The card pages as one crawl: listing pages per category, in the order of the line items."""
    k = F.col("l_partkey")
    base = F.element_at(F.array(*[F.lit(BASES[s]) for s in SITES]), (F.col("l_suppkey") % 8).cast("int") + 1)
    number = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    address = F.concat(base, F.lit("/list/"), adapter.title_category_id(k).cast("string"), F.lit("?n="), F.concat_ws("-", number, "offer_id", F.col("l_extendedprice").cast("string")))
    pages = _card_pages(spark, d, page=address, more=[number.cast("long").alias("page_seq")])
    return pages.withColumn("run_id", F.concat(F.lit("run-"), "site"))


CRAWL = f"""SELECT *, row_number() OVER (PARTITION BY url, fine ORDER BY page_seq DESC) AS rn FROM (SELECT *, coalesce(price > 0 AND price <= 50000, true) AS fine FROM (
  SELECT list_extract({SITES!r}, CAST(l_suppkey % 8 AS INTEGER) + 1) AS site, CAST(l_suppkey % 8 AS INTEGER) + 1 AS retailer_id,
    list_extract({[BASES[s] for s in SITES]!r}, CAST(l_suppkey % 8 AS INTEGER) + 1) || '/p/' || l_partkey || '?s=' || l_suppkey AS url,
    CASE WHEN l_tax <> 0 THEN floor(u) END AS price, l_orderkey * 10 + l_linenumber AS page_seq FROM li))"""


def _crawled(spark, d):
    empty = empty_catalog(spark).with_tables(categories=adapter.title_categories(spark, d).select("id", "name"))
    sites = spark.createDataFrame(list(zip(SITES, range(1, 9))), "site string, retailer_id long")
    tasks = empty.categories.select(F.explode(F.array(*[F.lit(BASES[s]) for s in SITES])).alias("base"), "id", "name").select(
        F.concat("base", F.lit("/list/"), F.col("id").cast("string")).alias("task_url"), F.col("name").alias("category"))
    return crawl.crawl_batch(empty, _crawl_pages(spark, d), sites, tasks, completed=sites.select("retailer_id"), run_id="crawl", as_of=LINE_AS_OF)


@query("crawl_offers", with_ctes(f"""
SELECT url AS listing_url, retailer_id, price AS current_price, CASE WHEN price IS NULL THEN 'unavailable' ELSE 'available' END AS status
FROM ({CRAWL}) WHERE rn = 1 AND fine"""))
def _(spark, d):
    return _crawled(spark, d).catalog.offers.select("listing_url", "retailer_id", "current_price", "status")


@query("crawl_runs", with_ctes(f"""
SELECT 'run-' || site AS id, CASE WHEN bool_and(fine) THEN 'succeeded' ELSE 'partial' END AS status, count(*) AS listings_seen,
  count(DISTINCT url) FILTER (WHERE fine) AS listings_created, count(*) FILTER (WHERE fine) - count(DISTINCT url) FILTER (WHERE fine) AS listings_updated,
  nullif(concat_ws('; ', CASE WHEN NOT bool_and(fine) THEN count(*) FILTER (WHERE NOT fine) || ' item failures' END), '') AS error_summary
FROM ({CRAWL}) GROUP BY site"""))
def _(spark, d):
    return _crawled(spark, d).catalog.runs.select("id", "status", "listings_seen", "listings_created", "listings_updated", "error_summary")


@query("listing_cards", with_ctes(f"""
SELECT site, name, url, price, CASE WHEN price IS NULL THEN 'unavailable' ELSE 'available' END AS status FROM (
SELECT list_extract({SITES!r}, CAST(l_suppkey % 8 AS INTEGER) + 1) AS site, {listing_title('l_partkey', 'l_suppkey')} AS name,
  list_extract({[BASES[s] for s in SITES]!r}, CAST(l_suppkey % 8 AS INTEGER) + 1) || '/p/' || l_partkey || '?s=' || l_suppkey AS url,
  CASE WHEN l_tax <> 0 THEN floor(u) END AS price FROM li)"""))
def _(spark, d):
    found = extract.cards(_card_pages(spark, d))
    return extract.snapshots(found).select("site", "name", "url", "price", "status")
