"""Read surface over the adapter tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricetide.functions import predicates as P
from pricetide.operators import stats as S
from pricetide.plans import client, health, products, review, trends
from workload.adapter import LINE_AS_OF, RUN_AS_OF, catalog, read
from workload.adapter_sql import with_ctes
from workload.registry import query

LINE_TS = f"TIMESTAMP '{LINE_AS_OF}'"
RUN_TS = f"TIMESTAMP '{RUN_AS_OF}'"
LIVE = "status = 'available' AND is_active"
SUMMARY = """id, canonical_name, category_id, category_name, brand, fingerprint, attr_size, attr_type, offer_count,
    available_offer_count, best_price, best_price_retailer, price_range_min, price_range_max, retailers"""


def flat(df):
    """Nested columns as text, so both engines hash the same scalars."""
    return df.withColumns(
        {
            "attr_size": F.try_element_at("attributes", F.lit("size")),
            "attr_type": F.try_element_at("attributes", F.lit("type")),
            "retailers": F.array_join("retailers", "|"),
        }
    ).drop("attributes")


# Scans.


@query("scan_retailers", with_ctes("SELECT id, name, url FROM retailers"))
def _(spark, d):
    return catalog(spark, d).retailers.select("id", "name", "url")


@query("scan_categories", with_ctes("SELECT id, name FROM categories"))
def _(spark, d):
    return catalog(spark, d).categories


@query("scan_products", with_ctes("SELECT * FROM products"))
def _(spark, d):
    return (
        catalog(spark, d).products.withColumns(
            {"attr_size": F.col("attributes")["size"], "attr_type": F.col("attributes")["type"]}
        ).drop("attributes")
    )


@query("scan_listings", with_ctes("SELECT * FROM listings"))
def _(spark, d):
    return catalog(spark, d).listings


@query("scan_offers", with_ctes("SELECT * FROM offers"))
def _(spark, d):
    return catalog(spark, d).offers.drop("image_url")


@query("scan_observations", with_ctes("SELECT * FROM observations"))
def _(spark, d):
    o = catalog(spark, d).observations
    return o.select(
        F.col("id.l_orderkey").alias("k1"), F.col("id.l_linenumber").alias("k2"), F.col("id.l_suppkey").alias("k3"),
        F.col("id.l_extendedprice").alias("k4"), "offer_id", "observed_at", "price", "in_stock",
    )


@query("scan_runs", with_ctes("SELECT * FROM runs"))
def _(spark, d):
    return catalog(spark, d).runs


@query("scan_decisions", with_ctes("SELECT * FROM decisions"))
def _(spark, d):
    return catalog(spark, d).decisions


# Aggregates and latest-per-key.


@query("offer_stats", with_ctes("SELECT * FROM offer_stats"))
def _(spark, d):
    return S.offer_stats(catalog(spark, d).offers)


@query("products_with_stats", with_ctes("""
SELECT p.id, coalesce(offer_count, 0) AS offer_count, coalesce(priced_offer_count, 0) AS priced_offer_count,
  coalesce(available_offer_count, 0) AS available_offer_count, min_any_price, min_available_price
FROM products p LEFT JOIN offer_stats s ON s.product_id = p.id"""))
def _(spark, d):
    c = catalog(spark, d)
    return S.with_offer_stats(c.products.select("id"), S.offer_stats(c.offers))


@query("active_offers_by_retailer", with_ctes(
    f"SELECT retailer_id, count(*) AS active_offer_count FROM offers WHERE {LIVE} GROUP BY 1"))
def _(spark, d):
    return S.active_offers_by(catalog(spark, d).offers, "retailer_id")


@query("active_offers_by_category", with_ctes(
    f"SELECT category_id, count(*) AS active_offer_count FROM offers WHERE {LIVE} AND category_id IS NOT NULL GROUP BY 1"))
def _(spark, d):
    return S.active_offers_by(catalog(spark, d).offers, "category_id")


@query("active_products_by_category", with_ctes(
    "SELECT category_id, count(*) AS product_count FROM products WHERE is_active GROUP BY 1"))
def _(spark, d):
    return S.active_products_by_category(catalog(spark, d).products)


@query("latest_success_per_retailer", with_ctes("""
SELECT retailer_id, max(coalesce(finished_at, started_at)) AS last_success_at FROM runs
WHERE status = 'succeeded' AND retailer_id IS NOT NULL GROUP BY 1"""))
def _(spark, d):
    return S.latest_success(catalog(spark, d).runs)


@query("latest_success_overall", with_ctes(
    "SELECT max(finished_at) AS latest_success_at FROM runs WHERE status = 'succeeded'"))
def _(spark, d):
    return catalog(spark, d).runs.filter("status = 'succeeded'").agg(F.max("finished_at").alias("latest_success_at"))


@query("latest_run_per_retailer", with_ctes("""
SELECT retailer_id, arg_max(id, (started_at, id)) AS id, arg_max(status, (started_at, id)) AS status
FROM runs WHERE retailer_id IS NOT NULL GROUP BY 1"""))
def _(spark, d):
    return S.latest_run(catalog(spark, d).runs).select("retailer_id", "id", "status")


@query("latest_decision_per_listing", with_ctes("""
SELECT listing_id, id, decision, confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY created_at DESC, id DESC) AS rn FROM decisions)
WHERE rn = 1"""))
def _(spark, d):
    return S.latest_decision(catalog(spark, d).decisions).select("listing_id", "id", "decision", "confidence")


@query("latest_observation_per_offer", with_ctes("""
SELECT offer_id, observed_at, price, in_stock FROM (
  SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY observed_at DESC, k1 DESC, k2 DESC, k3 DESC, k4 DESC)
  AS rn FROM observations) WHERE rn = 1"""))
def _(spark, d):
    return S.latest_observation(catalog(spark, d).observations).drop("id")


@query("first_last_price", with_ctes(f"""
SELECT product_id, arg_min(price, (observed_at, k1, k2, k3, k4)) AS initial_price,
  arg_max(price, (observed_at, k1, k2, k3, k4)) AS latest_price
FROM observations o JOIN offers f ON f.id = o.offer_id
WHERE observed_at >= {LINE_TS} - INTERVAL 365 DAY GROUP BY 1"""))
def _(spark, d):
    c = catalog(spark, d)
    return S.first_last_price(c.observations, c.offers, as_of=LINE_AS_OF, days=365)


@query("catalog_counts", with_ctes(f"""
SELECT (SELECT count(*) FROM retailers) AS retailer_count, (SELECT count(*) FROM categories) AS category_count,
  (SELECT count(*) FROM products WHERE is_active) AS product_count,
  (SELECT count(*) FROM offers WHERE {LIVE}) AS active_offer_count,
  (SELECT count(*) FROM decisions WHERE decision = 'needs_review') AS review_queue_count"""))
def _(spark, d):
    return health.health(catalog(spark, d), as_of=RUN_AS_OF).select(
        "retailer_count", "category_count", "product_count", "active_offer_count", "review_queue_count"
    )


BUCKETS = """SELECT count(*) AS review_queue_count, count(*) FILTER (WHERE confidence >= 0.9) AS high_confidence_review_count,
  count(*) FILTER (WHERE confidence >= 0.6 AND confidence < 0.9) AS medium_confidence_review_count,
  count(*) FILTER (WHERE confidence IS NULL OR confidence < 0.6) AS low_confidence_review_count
  FROM decisions WHERE decision = 'needs_review'"""


@query("review_buckets", with_ctes(BUCKETS))
def _(spark, d):
    return S.review_buckets(catalog(spark, d).decisions)


def _queue_sql(key: str, low: bool = True) -> str:
    lows = ", count(*) FILTER (WHERE confidence IS NULL OR confidence < 0.6) AS low_confidence_review_count" if low else ""
    return f"""SELECT l.{key}, count(*) AS pending_review_count,
      count(*) FILTER (WHERE confidence >= 0.9) AS high_confidence_review_count{lows}
      FROM decisions d JOIN listings l ON l.id = d.listing_id
      WHERE decision = 'needs_review' AND l.{key} IS NOT NULL GROUP BY 1"""


@query("review_queue_by_retailer", with_ctes(_queue_sql("retailer_id")))
def _(spark, d):
    c = catalog(spark, d)
    return S.review_queue_by(c.decisions, c.listings, "retailer_id")


@query("review_queue_by_category", with_ctes(_queue_sql("category_id", low=False)))
def _(spark, d):
    c = catalog(spark, d)
    return S.review_queue_by(c.decisions, c.listings, "category_id").drop("low_confidence_review_count")


@query("products_without_live_offers", with_ctes(f"""
SELECT id FROM products WHERE is_active AND id NOT IN (SELECT product_id FROM offers WHERE {LIVE})"""))
def _(spark, d):
    c = catalog(spark, d)
    return S.products_without_live_offers(c.products, c.offers).select("id")


@query("candidate_rollup", with_ctes("""
SELECT product_id, min(current_price) AS best_price, count(DISTINCT retailer_id) AS retailer_count,
  count(*) AS offer_count FROM offers GROUP BY 1"""))
def _(spark, d):
    return S.candidate_rollup(catalog(spark, d).offers)


# Filters.


@query("stale_offers", with_ctes(f"""
SELECT id, last_seen_at FROM offers WHERE {LIVE} AND last_seen_at < {LINE_TS} - INTERVAL 1000 DAY"""))
def _(spark, d):
    o = catalog(spark, d).offers.filter(P.active_available())
    return o.filter(P.before_cutoff(F.col("last_seen_at"), LINE_AS_OF, 1000)).select("id", "last_seen_at")


@query("unpriced_active_offers", with_ctes(f"SELECT id FROM offers WHERE {LIVE} AND current_price IS NULL"))
def _(spark, d):
    return catalog(spark, d).offers.filter(P.active_available() & F.col("current_price").isNull()).select("id")


@query("uncategorized_listings", with_ctes(
    "SELECT id, title FROM listings WHERE status = 'available' AND category_id IS NULL"))
def _(spark, d):
    return catalog(spark, d).listings.filter("status = 'available' AND category_id IS NULL").select("id", "title")


@query("observations_in_lookback", with_ctes(f"""
SELECT offer_id, observed_at, price FROM observations WHERE observed_at >= {LINE_TS} - INTERVAL 365 DAY"""))
def _(spark, d):
    o = catalog(spark, d).observations
    return o.filter(P.since(F.col("observed_at"), LINE_AS_OF, 365)).select("offer_id", "observed_at", "price")


@query("name_search", with_ctes("SELECT id, canonical_name FROM products WHERE canonical_name ILIKE '%RED%#1%'"))
def _(spark, d):
    p = catalog(spark, d).products
    return p.filter(P.name_matches(F.col("canonical_name"), "RED%#1")).select("id", "canonical_name")


@query("on_sale_flags", with_ctes(
    "SELECT id, coalesce(current_price < previous_price, false) AS on_sale FROM offers"))
def _(spark, d):
    return catalog(spark, d).offers.select("id", P.on_sale(F.col("current_price"), F.col("previous_price")).alias("on_sale"))


@query("products_in_request_order", with_ctes("""
SELECT p.id, p.canonical_name, max(d.id) AS ord FROM products p JOIN decisions d ON d.product_id = p.id
GROUP BY 1, 2"""))
def _(spark, d):
    c = catalog(spark, d)
    wanted = (
        c.decisions.filter(F.col("product_id").isNotNull())
        .groupBy(F.col("product_id").alias("id")).agg(F.max("id").alias("ord"))
    )
    return S.by_ids(c.products.select("id", "canonical_name"), wanted)


# Product page, detail, offers, history, facets.

PAGE_BASE = """SELECT s.*, t.min_available_price, t.min_any_price, t.priced_offer_count, t.available_offer_count AS stat_available
  FROM {summary} s LEFT JOIN offer_stats t ON t.product_id = s.id WHERE s.is_active"""


def _page_sql(order: str, *, where: str = "", hide: bool = True, size: int = 24, page: int = 1) -> str:
    live = " AND coalesce(t.available_offer_count, 0) > 0" if hide else ""
    base = PAGE_BASE.format(summary="summary" if hide else "summary_all") + live + where
    return with_ctes(f"SELECT {SUMMARY} FROM ({base}) ORDER BY {order} LIMIT {size} OFFSET {(page - 1) * size}")


def _page(name: str, order: str, where: str = "", **kw):
    sql = _page_sql(
        order, where=where, hide=kw.get("hide_unavailable", True), size=kw.get("page_size", 24), page=kw.get("page", 1)
    )

    @query(name, sql)
    def _(spark, d):
        return flat(products.product_page(catalog(spark, d), **kw))


_page("product_page_name", "canonical_name, id")
_page("product_page_name_desc", "canonical_name DESC, id", sort_order="desc", page=3, page_size=50)
_page("product_page_price", "min_available_price NULLS LAST, canonical_name, id", sort_by="price")
_page("product_page_price_desc", "min_available_price DESC NULLS LAST, canonical_name, id", sort_by="price", sort_order="desc")
_page("product_page_offers_desc", "stat_available DESC NULLS LAST, canonical_name, id", sort_by="offers", sort_order="desc")
_page("product_page_search", "canonical_name, id", " AND s.canonical_name ILIKE '%widget%'", search="widget", page_size=100)
_page("product_page_category", "canonical_name, id", " AND s.category_id = 4", category_id=4, page=2)
_page("product_page_all_price", "min_any_price NULLS LAST, canonical_name, id", sort_by="price", hide_unavailable=False, page_size=500)
_page("product_page_all_offers", "priced_offer_count NULLS LAST, canonical_name, id", sort_by="offers", hide_unavailable=False)


@query("product_page_total", with_ctes("""
SELECT count(*) AS total FROM products p LEFT JOIN offer_stats t ON t.product_id = p.id
WHERE p.is_active AND coalesce(t.available_offer_count, 0) > 0"""))
def _(spark, d):
    return products.product_page_total(catalog(spark, d))


@query("product_summary", with_ctes(f"SELECT {SUMMARY} FROM summary"))
def _(spark, d):
    c = catalog(spark, d)
    return flat(S.product_summary(c.products, c.offers, c.retailers, c.categories, restrict=False))


@query("product_detail", with_ctes(f"SELECT {SUMMARY} FROM summary_all"))
def _(spark, d):
    return flat(products.product_detail(catalog(spark, d)))


OFFER_ROWS = """o.id AS offer_id, o.product_id, o.listing_name AS name, o.listing_url AS url, o.current_price,
    o.previous_price, o.status, coalesce(o.current_price < o.previous_price, false) AS on_sale, o.retailer_id,
    r.name AS retailer_name FROM offers o JOIN retailers r ON r.id = o.retailer_id"""


@query("product_listings", with_ctes(f"SELECT {OFFER_ROWS}"))
def _(spark, d):
    return products.product_listings(catalog(spark, d)).drop("image_url")


@query("offer_list", with_ctes(f"""
SELECT {OFFER_ROWS} WHERE o.status = 'available' ORDER BY o.current_price NULLS LAST, o.listing_name, o.id"""))
def _(spark, d):
    return products.offers(catalog(spark, d)).drop("image_url")


@query("offer_list_paged", with_ctes(f"""
SELECT {OFFER_ROWS} ORDER BY o.current_price NULLS LAST, o.listing_name, o.id LIMIT 500 OFFSET 100"""))
def _(spark, d):
    return products.offers(catalog(spark, d), hide_unavailable=False, limit=500, offset=100).drop("image_url")


@query("offers_of_product", with_ctes(f"SELECT {OFFER_ROWS} WHERE o.product_id = 7 AND o.status = 'available'"))
def _(spark, d):
    return products.offers(catalog(spark, d), product_id=7).drop("image_url")


HISTORY = """SELECT o.product_id, o.retailer_id, r.name AS retailer_name, b.offer_id AS listing_id, b.observed_at,
    b.price, b.k1, b.k2, b.k4 FROM offers o JOIN retailers r ON r.id = o.retailer_id
    LEFT JOIN observations b ON b.offer_id = o.id"""


@query("price_history", with_ctes(HISTORY))
def _(spark, d):
    h = products.price_history(catalog(spark, d))
    return h.withColumns(
        {"k1": F.col("obs_id.l_orderkey"), "k2": F.col("obs_id.l_linenumber"), "k4": F.col("obs_id.l_extendedprice")}
    ).drop("obs_id")


@query("facet_brands", with_ctes("""
SELECT DISTINCT brand FROM products p JOIN offer_stats t ON t.product_id = p.id
WHERE is_active AND available_offer_count > 0 AND brand IS NOT NULL"""))
def _(spark, d):
    return products.facet_brands(catalog(spark, d))


@query("facet_prices", with_ctes("""
SELECT min(min_available_price) AS min_price, max(min_available_price) AS max_price
FROM products p JOIN offer_stats t ON t.product_id = p.id
WHERE is_active AND available_offer_count > 0 AND category_id = 2"""))
def _(spark, d):
    return products.facet_prices(catalog(spark, d), category_id=2)


@query("facet_categories", with_ctes("SELECT id, name FROM categories"))
def _(spark, d):
    return products.facet_categories(catalog(spark, d))


TREND = f"""SELECT m.*, s.* EXCLUDE (is_active, retailer_count) FROM (
  SELECT product_id, initial_price, latest_price, initial_price - latest_price AS price_drop_amount,
    ((initial_price - latest_price) * 100.0::DOUBLE) / initial_price AS price_drop_percentage
  FROM (SELECT product_id, arg_min(price, (observed_at, k1, k2, k3, k4)) AS initial_price,
          arg_max(price, (observed_at, k1, k2, k3, k4)) AS latest_price
        FROM observations o JOIN offers f ON f.id = o.offer_id
        WHERE observed_at >= {LINE_TS} - INTERVAL 365 DAY GROUP BY 1)
  WHERE initial_price > latest_price) m JOIN summary s ON s.id = m.product_id AND s.is_active"""


@query("price_drops", with_ctes(f"""
SELECT * EXCLUDE (product_id) FROM ({TREND}) ORDER BY price_drop_percentage DESC, canonical_name, id LIMIT 100"""))
def price_drops(spark, d):
    return flat(trends.price_drops(catalog(spark, d), as_of=LINE_AS_OF, days=365, limit=100))


# Health and data quality.

RUN_FIELDS = ["status", "scraper_name", "started_at", "finished_at", "error_summary", "listings_seen",
              "listings_created", "listings_updated"]
LATEST_RUN = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY retailer_id ORDER BY started_at DESC, id DESC) AS rn FROM runs WHERE retailer_id IS NOT NULL) WHERE rn = 1"
HEALTH = f"""SELECT id AS retailer_id, name AS retailer_name,
  CASE WHEN latest_run_status IS NULL THEN 'never_run' WHEN latest_run_status = 'started' THEN 'running'
       WHEN latest_run_status = 'failed' THEN 'failed' WHEN old THEN 'stale'
       WHEN latest_run_status = 'partial' THEN 'partial' ELSE 'ok' END AS status,
  CASE WHEN latest_run_status IS NULL THEN true WHEN latest_run_status = 'started' THEN false ELSE old END AS is_stale,
  CAST(36 AS BIGINT) AS stale_after_hours, active_offer_count,
  {", ".join(f"latest_run_{c}" for c in RUN_FIELDS)}, last_success_at, success_age_hours
FROM (SELECT *, success_age_hours IS NULL OR success_age_hours > 36 AS old FROM (
  SELECT r.id, r.name, {", ".join(f"l.{c} AS latest_run_{c}" for c in RUN_FIELDS)}, s.last_success_at,
    CASE WHEN s.last_success_at IS NOT NULL THEN greatest(0,
      CAST(floor(date_diff('microsecond', s.last_success_at, {RUN_TS}) / 3600000000.0) AS BIGINT)) END AS success_age_hours,
    coalesce(a.n, 0) AS active_offer_count
  FROM retailers r LEFT JOIN ({LATEST_RUN}) l ON l.retailer_id = r.id
  LEFT JOIN (SELECT retailer_id, max(coalesce(finished_at, started_at)) AS last_success_at FROM runs
             WHERE status = 'succeeded' AND retailer_id IS NOT NULL GROUP BY 1) s ON s.retailer_id = r.id
  LEFT JOIN (SELECT retailer_id, count(*) AS n FROM offers WHERE {LIVE} GROUP BY 1) a ON a.retailer_id = r.id))"""


@query("retailer_health", with_ctes(HEALTH))
def _(spark, d):
    return health.retailer_health(catalog(spark, d), as_of=RUN_AS_OF)


@query("service_health", with_ctes(f"""
SELECT CASE WHEN NOT (product_count > 0 AND active_offer_count > 0) OR latest_run_status = 'failed' THEN 'degraded'
  ELSE 'ok' END AS status, (product_count > 0 AND active_offer_count > 0) AS catalog_ready, * FROM (
SELECT (SELECT count(*) FROM retailers) AS retailer_count, (SELECT count(*) FROM categories) AS category_count,
  (SELECT count(*) FROM products WHERE is_active) AS product_count,
  (SELECT count(*) FROM offers WHERE {LIVE}) AS active_offer_count,
  (SELECT count(*) FROM decisions WHERE decision = 'needs_review') AS review_queue_count,
  (SELECT max(finished_at) FROM runs WHERE status = 'succeeded') AS latest_success_at,
  {", ".join(f"n.{c} AS latest_run_{c}" for c in RUN_FIELDS)}, n.retailer_name AS latest_run_retailer_name
FROM (SELECT r.*, t.name AS retailer_name FROM runs r LEFT JOIN retailers t ON t.id = r.retailer_id
      ORDER BY started_at DESC, r.id DESC LIMIT 1) n)"""))
def _(spark, d):
    return health.health(catalog(spark, d), as_of=RUN_AS_OF)


def _runs_sql(where: str, limit: int) -> str:
    return with_ctes(f"""SELECT r.*, t.name AS retailer_name FROM runs r LEFT JOIN retailers t ON t.id = r.retailer_id
      {where} ORDER BY started_at DESC, r.id DESC LIMIT {limit}""")


@query("run_list", _runs_sql("", 200))
def _(spark, d):
    return health.runs(catalog(spark, d), limit=200)


@query("run_list_filtered", _runs_sql("WHERE r.status = 'failed' AND r.retailer_id = 8", 20))
def _(spark, d):
    return health.runs(catalog(spark, d), retailer_id=8, status="failed")


COUNTS = f"""SELECT b.*, (SELECT count(*) FROM offers WHERE {LIVE} AND last_seen_at < {LINE_TS} - INTERVAL 7 DAY) AS stale_offer_count,
  (SELECT count(*) FROM offers WHERE {LIVE} AND current_price IS NULL) AS unpriced_active_offer_count,
  (SELECT count(*) FROM listings WHERE status = 'available' AND category_id IS NULL) AS uncategorized_listing_count,
  (SELECT count(*) FROM products WHERE is_active AND id NOT IN (SELECT product_id FROM offers WHERE {LIVE}))
    AS products_without_active_offers_count,
  (SELECT count(*) FROM ({HEALTH}) WHERE status IN ('failed', 'stale', 'never_run')) AS stale_retailer_count
  FROM ({BUCKETS}) b"""


@query("quality_counts", with_ctes(COUNTS))
def _(spark, d):
    return health.quality_counts(catalog(spark, d), as_of=LINE_AS_OF, runs_as_of=RUN_AS_OF)


_issue_rows = " UNION ALL ".join(
    f"SELECT {i} AS position, '{key}' AS key, '{label}' AS label, {counter} AS count, "
    f"CASE WHEN {counter} <= 0 THEN 'ok' ELSE '{'critical' if critical else 'warning'}' END AS severity, "
    f"'{detail.format(stale_days=7)}' AS detail FROM counts"
    for i, (key, counter, label, detail, critical) in enumerate(health.QUALITY_ISSUES)
)


@query("quality_issues", with_ctes(
    f"SELECT CAST(position AS BIGINT) AS position, key, label, count, severity, detail FROM ({_issue_rows})", counts=COUNTS))
def _(spark, d):
    return health.quality_issues(health.quality_counts(catalog(spark, d), as_of=LINE_AS_OF, runs_as_of=RUN_AS_OF))


@query("quality_retailer_queue", with_ctes(f"""
SELECT r.id, r.name, coalesce(q.pending_review_count, 0) AS pending_review_count,
  coalesce(q.high_confidence_review_count, 0) AS high_confidence_review_count,
  coalesce(q.low_confidence_review_count, 0) AS low_confidence_review_count, coalesce(a.n, 0) AS active_offer_count
FROM retailers r LEFT JOIN ({_queue_sql("retailer_id")}) q ON q.retailer_id = r.id
LEFT JOIN (SELECT retailer_id, count(*) AS n FROM offers WHERE {LIVE} GROUP BY 1) a ON a.retailer_id = r.id
WHERE q.retailer_id IS NOT NULL OR a.n > 0"""))
def _(spark, d):
    return health.retailer_queue(catalog(spark, d))


@query("quality_category_queue", with_ctes(f"""
SELECT c.id, c.name, coalesce(q.pending_review_count, 0) AS pending_review_count,
  coalesce(q.high_confidence_review_count, 0) AS high_confidence_review_count, coalesce(a.n, 0) AS active_offer_count,
  coalesce(p.n, 0) AS product_count
FROM categories c LEFT JOIN ({_queue_sql("category_id")}) q ON q.category_id = c.id
LEFT JOIN (SELECT category_id, count(*) AS n FROM offers WHERE {LIVE} GROUP BY 1) a ON a.category_id = c.id
LEFT JOIN (SELECT category_id, count(*) AS n FROM products WHERE is_active GROUP BY 1) p ON p.category_id = c.id
WHERE q.category_id IS NOT NULL OR a.n > 0 OR p.n > 0"""))
def _(spark, d):
    return health.category_queue(catalog(spark, d))


# Review list.

DECISION_ROWS = """SELECT d.id, d.decision, d.confidence, d.matcher, d.fingerprint, d.created_at, d.listing_id,
    l.title, l.source_url, l.status AS listing_status, l.retailer_id, r.name AS retailer_name, l.category_id,
    c.name AS category_name, d.product_id, p.canonical_name
  FROM decisions d JOIN listings l ON l.id = d.listing_id JOIN retailers r ON r.id = l.retailer_id
  LEFT JOIN categories c ON c.id = l.category_id LEFT JOIN products p ON p.id = d.product_id"""


@query("decision_list", with_ctes(f"{DECISION_ROWS} ORDER BY d.created_at DESC, d.id DESC LIMIT 50"))
def _(spark, d):
    return review.decisions(catalog(spark, d))


@query("decision_list_confidence", with_ctes(f"""{DECISION_ROWS} WHERE d.decision = 'needs_review' AND l.category_id = 3
  ORDER BY d.confidence DESC NULLS LAST, d.created_at DESC, d.id DESC LIMIT 500 OFFSET 20"""))
def _(spark, d):
    return review.decisions(
        catalog(spark, d), decision="needs_review", category_id=3, sort_by="confidence_desc", limit=500, offset=20
    )


@query("decision_list_search", with_ctes(f"""{DECISION_ROWS}
  WHERE l.retailer_id = 3 AND (d.fingerprint ILIKE '%9%' OR l.title ILIKE '%9%')
  ORDER BY d.created_at DESC, d.id DESC LIMIT 100"""))
def _(spark, d):
    return review.decisions(catalog(spark, d), retailer_id=3, search=" 9 ", limit=100)


@query("decision_list_total", with_ctes("""
SELECT count(*) AS total FROM decisions d JOIN listings l ON l.id = d.listing_id
WHERE d.decision = 'needs_review' AND l.category_id = 3"""))
def _(spark, d):
    return review.decisions_total(catalog(spark, d), decision="needs_review", category_id=3)


# Client-side operators.


def _alerts(spark, d):
    return read(spark, d, "customer").select(
        F.col("c_custkey").alias("product_id"), (F.greatest("c_acctbal", F.lit(1.0)) * 5).alias("target_price")
    )


ALERTS = """SELECT a.product_id, s.canonical_name, a.target_price, s.best_price,
    coalesce(s.best_price <= a.target_price, false) AS triggered, s.best_price - a.target_price AS gap
  FROM (SELECT DISTINCT c_custkey AS product_id, greatest(c_acctbal, 1.0) * 5 AS target_price FROM customer) a
  JOIN summary s ON s.id = a.product_id"""


def _summaries(spark, d):
    c = catalog(spark, d)
    return S.product_summary(c.products, c.offers, c.retailers, c.categories, restrict=False)


@query("price_alerts", with_ctes(ALERTS))
def _(spark, d):
    return client.price_alerts(_alerts(spark, d), _summaries(spark, d))


@query("price_alert_counts", with_ctes(f"""
SELECT count(*) FILTER (WHERE NOT triggered) AS active_count, count(*) FILTER (WHERE triggered) AS triggered_count
FROM ({ALERTS})"""))
def _(spark, d):
    return client.alert_counts(client.price_alerts(_alerts(spark, d), _summaries(spark, d)))


@query("watchlist", with_ctes(f"""
SELECT {SUMMARY} FROM summary WHERE id IN (SELECT c_custkey FROM customer) AND category_id = 2
AND contains(lower(canonical_name || ' ' || fingerprint || ' ' || coalesce(best_price_retailer, '')), 'fp-1')"""))
def _(spark, d):
    watched = read(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return flat(client.watchlist(_summaries(spark, d), watched, category_id=2, search="FP-1"))


PICKED = "SELECT p_partkey AS id, p_retailprice AS picked_at FROM part ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 4"


def _picked(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("picked_at"))


@query("compare_matrix", with_ctes(f"""
SELECT p.id, k.attribute, CASE k.attribute WHEN 'size' THEN attr_size ELSE attr_type END AS value
FROM products p JOIN ({PICKED}) q ON q.id = p.id CROSS JOIN (VALUES ('size'), ('type')) k(attribute)"""))
def _(spark, d):
    return client.compare_matrix(catalog(spark, d).products, _picked(spark, d))


@query("compare_pivot", with_ctes(f"""
SELECT k.attribute, {", ".join(f"max(CASE WHEN n = {i} THEN CASE k.attribute WHEN 'size' THEN attr_size ELSE attr_type END END) AS slot_{i}" for i in range(1, 5))}
FROM products p JOIN (SELECT *, row_number() OVER (ORDER BY picked_at, id) AS n FROM ({PICKED})) q ON q.id = p.id
CROSS JOIN (VALUES ('size'), ('type')) k(attribute) GROUP BY 1"""))
def _(spark, d):
    return client.compare_pivot(catalog(spark, d).products, _picked(spark, d))


@query("history_pivot", with_ctes("""
SELECT product_id, observed_at, retailer_name, arg_max_null(price, (listing_id, k1, k2, k3, k4)) AS price
FROM (SELECT o.product_id, r.name AS retailer_name, b.offer_id AS listing_id, b.* EXCLUDE (offer_id)
      FROM offers o JOIN retailers r ON r.id = o.retailer_id JOIN observations b ON b.offer_id = o.id)
GROUP BY 1, 2, 3"""))
def _(spark, d):
    pivot = client.history_pivot(products.history_points(catalog(spark, d)))
    return pivot.select("product_id", "observed_at", F.explode("prices").alias("retailer_name", "price"))


@query("coverage_counts", with_ctes("""
SELECT count(*) FILTER (WHERE available_offer_count > 0) AS live_count,
  count(*) FILTER (WHERE available_offer_count = 0) AS gap_count,
  count(*) FILTER (WHERE retailer_count <= 1) AS single_retailer_count FROM summary"""))
def _(spark, d):
    return client.coverage_counts(_summaries(spark, d))


@query("coverage_live", with_ctes(f"SELECT {SUMMARY} FROM summary WHERE available_offer_count > 0"))
def _(spark, d):
    return flat(client.coverage_filter(_summaries(spark, d), "live"))


@query("health_classes", with_ctes(f"""
SELECT count(*) FILTER (WHERE status = 'ok') AS healthy_count,
  count(*) FILTER (WHERE status IN ('failed', 'stale')) AS attention_count,
  count(*) FILTER (WHERE status = 'running') AS running_count,
  count(*) FILTER (WHERE status = 'never_run') AS never_run_count FROM ({HEALTH})"""))
def _(spark, d):
    return client.health_classes(health.retailer_health(catalog(spark, d), as_of=RUN_AS_OF))


@query("catalog_ready", with_ctes("""
SELECT (SELECT count(*) > 0 FROM products) AS has_products, (SELECT count(*) > 0 FROM offers) AS has_offers,
  CASE WHEN (SELECT count(*) > 0 FROM products) THEN 'ready' ELSE 'empty_catalog' END AS state"""))
def _(spark, d):
    return health.catalog_ready(catalog(spark, d))


@query("missing_products", with_ctes("""
SELECT DISTINCT o_custkey * 7 AS id FROM orders WHERE o_custkey * 7 NOT IN (SELECT id FROM products)"""))
def _(spark, d):
    asked = read(spark, d, "orders").select((F.col("o_custkey") * 7).alias("id"))
    return health.missing_entities(asked, catalog(spark, d).products)
