"""The catalog tables of ``adapter`` as SQL common table expressions, with their dependencies."""

from __future__ import annotations

import re

from workload.adapter import DECISION_BY_PRIORITY, OFFER_KEY, P_TYPES, TITLE_BRANDS, TITLE_CATEGORIES


def case(column: str, pairs: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in pairs.items()) + " END"


def pick(values: list[str], index: str) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"list_extract([{quoted}], CAST({index} AS INTEGER) + 1)"


_type_id = case("p_type", {t: i for i, t in enumerate(P_TYPES, 1)})
_decision = case("o_orderpriority", {p: f"'{d}'" for p, d in DECISION_BY_PRIORITY.items()})


def product_title(k: str) -> str:
    brand = f"(CASE WHEN {k} % 13 = 0 THEN 'Acme' ELSE {pick(TITLE_BRANDS, f'{k} % 10')} END)"
    ecc = pick(["", " SODIMM", " non-ECC", " ECC"], f"{k} % 4")
    shapes = [
        f"{brand} || ' GeForce RTX ' || (5050 + 10 * ({k} % 5)) || ' OC ' || (8 + 4 * ({k} % 3)) || 'GB'",
        f"'AMD Ryzen ' || (3 + 2 * ({k} % 4)) || ' ' || (7000 + {k} % 900) || 'X3D AM5 8-Core Processor'",
        f"{brand} || ' B' || (650 + 10 * ({k} % 12)) || 'M mATX LGA1700'",
        f"{brand} || ' Vengeance ' || (16 * (1 + {k} % 4)) || 'GB DDR5 ' || (5200 + 400 * ({k} % 4)) || 'MHz' || {ecc}",
        f"{brand} || ' 990 Pro ' || (1 + {k} % 4) || 'TB M.2 NVMe SSD'",
        f"{brand} || ' RM ' || (550 + 100 * ({k} % 5)) || 'W 80 Plus Gold Fully Modular'",
        f"{brand} || ' Dynamic EVO Mid Tower Case'",
        f"{brand} || ' ' || (24 + {k} % 10) || '\" ' || (120 + 24 * ({k} % 5)) || 'Hz 1440p IPS HDR400'",
        f"{brand} || ' H' || (100 + {k} % 60) || 'i 360mm AIO Liquid CPU Cooler'",
    ]
    return f"(CASE {k} % 9 " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(shapes)) + " END)"


def listing_title(k: str, s: str) -> str:
    return f"({product_title(k)} || {pick(['', ' Black', ' White Edition', ' (No Cooler)'], f'{s} % 4')})"


CTES = {
    "li": f"SELECT *, l_extendedprice / l_quantity AS u, l_partkey * {OFFER_KEY} + l_suppkey AS offer_id FROM lineitem",
    "retailers": """SELECT s_suppkey AS id, s_name AS name, 'https://r' || s_suppkey || '.example' AS url,
        CAST(NULL AS VARCHAR) AS logo_url FROM supplier""",
    "categories": f"SELECT DISTINCT CAST({_type_id} AS BIGINT) AS id, p_type AS name FROM part",
    "products": f"""SELECT p_partkey AS id, p_name || ' ' || p_brand AS canonical_name,
        CAST({_type_id} AS BIGINT) AS category_id,
        CASE WHEN p_size % 10 <> 0 THEN p_brand END AS brand, 'fp-' || p_partkey AS fingerprint,
        CAST(p_size AS VARCHAR) AS attr_size, p_type AS attr_type, p_partkey % 20 <> 0 AS is_active FROM part""",
    "ranked": """SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY l_shipdate DESC, l_orderkey DESC,
        l_linenumber DESC, l_extendedprice DESC) AS rn FROM li""",
    "offers": """SELECT a.offer_id AS id, a.l_partkey AS product_id, a.offer_id AS listing_id,
        a.l_suppkey AS retailer_id, CASE WHEN a.l_linenumber <> 7 THEN p.category_id END AS category_id,
        p.canonical_name AS listing_name, 'https://r' || a.l_suppkey || '.example/p/' || a.l_partkey AS listing_url,
        CASE WHEN a.l_tax <> 0 THEN a.u END AS current_price, b.u AS previous_price,
        CASE WHEN a.l_linestatus = 'O' THEN 'available' WHEN a.l_returnflag = 'R' THEN 'end_of_life'
             ELSE 'unavailable' END AS status,
        (a.l_linestatus = 'O' AND a.l_returnflag <> 'A') AS is_active, a.l_shipdate AS last_seen_at
        FROM (SELECT * FROM ranked WHERE rn = 1) a LEFT JOIN (SELECT * FROM ranked WHERE rn = 2) b USING (offer_id)
        JOIN products p ON p.id = a.l_partkey""",
    "listings": """SELECT id, retailer_id, category_id, listing_url AS source_url, listing_name AS title, status,
        last_seen_at FROM offers""",
    "observations": """SELECT l_orderkey AS k1, l_linenumber AS k2, l_suppkey AS k3, l_extendedprice AS k4, offer_id,
        l_shipdate AS observed_at, u AS price, l_linestatus = 'O' AS in_stock FROM li""",
    "runs": """SELECT event_id AS id,
        CASE WHEN s_suppkey IS NOT NULL AND user_id % 7 <> 0 THEN user_id END AS retailer_id, ts AS started_at,
        CASE WHEN event_type NOT IN ('error', 'signup') THEN ts + INTERVAL 1 HOUR END AS finished_at,
        CASE WHEN event_type IN ('view', 'purchase') THEN 'succeeded' WHEN event_type = 'click' THEN 'partial'
             WHEN event_type = 'error' THEN 'failed' ELSE 'started' END AS status,
        'scraper' AS trigger_source, event_type AS scraper_name, CAST(floor(value) AS BIGINT) AS listings_seen,
        CAST(floor(floor(value) / 2) AS BIGINT) AS listings_created,
        CAST(floor(value) - floor(floor(value) / 2) AS BIGINT) AS listings_updated,
        CASE WHEN event_type = 'error' THEN props END AS error_summary
        FROM events LEFT JOIN supplier ON s_suppkey = user_id""",
    "decisions": f"""SELECT o_orderkey AS id, listing_id,
        CASE WHEN {_decision} IN ('auto_matched', 'manual_matched') THEN listing_id // {OFFER_KEY} END AS product_id,
        {_decision} AS decision,
        CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderkey % 101 AS DOUBLE) / 100.0::DOUBLE END AS confidence,
        'candidate_rank' AS matcher, 'fp-' || (listing_id // {OFFER_KEY}) AS fingerprint, o_orderdate AS created_at
        FROM orders JOIN (SELECT l_orderkey, min(offer_id) AS listing_id FROM li GROUP BY 1) ON l_orderkey = o_orderkey""",
    "offer_stats": """SELECT product_id, count(*) AS offer_count, count(current_price) AS priced_offer_count,
        count(*) FILTER (WHERE status = 'available' AND is_active AND current_price IS NOT NULL) AS available_offer_count,
        min(current_price) AS min_any_price,
        min(current_price) FILTER (WHERE status = 'available' AND is_active) AS min_available_price
        FROM offers GROUP BY 1""",
    "summary": None,
    "titles": f"""SELECT offer_id, l_partkey, l_suppkey, CAST(l_partkey % 9 + 1 AS BIGINT) AS category_id,
        {pick(TITLE_CATEGORIES, 'l_partkey % 9')} AS category_name, {listing_title('l_partkey', 'l_suppkey')} AS title
        FROM (SELECT DISTINCT offer_id, l_partkey, l_suppkey FROM li)""",
}


def summary(hide_unavailable: bool) -> str:
    usable = "current_price IS NOT NULL"
    if hide_unavailable:
        usable = "status = 'available' AND is_active AND current_price IS NOT NULL"
    return f"""SELECT p.id, p.canonical_name, p.category_id, c.name AS category_name, p.brand, p.fingerprint,
        p.attr_size, p.attr_type, p.is_active, coalesce(s.offer_count, 0) AS offer_count,
        coalesce(s.available_offer_count, 0) AS available_offer_count, s.best_price, s.best_price_retailer,
        s.price_range_min, s.price_range_max, coalesce(s.retailers, '') AS retailers,
        coalesce(s.retailer_count, 0) AS retailer_count
        FROM products p LEFT JOIN categories c ON c.id = p.category_id LEFT JOIN (
          SELECT product_id, count(*) AS offer_count, count(*) FILTER (WHERE {usable}) AS available_offer_count,
            min(current_price) FILTER (WHERE {usable}) AS best_price,
            arg_min(r.name, (current_price, o.id)) FILTER (WHERE {usable}) AS best_price_retailer,
            min(current_price) AS price_range_min, max(current_price) AS price_range_max,
            string_agg(DISTINCT r.name, '|' ORDER BY r.name) AS retailers, count(DISTINCT r.name) AS retailer_count
          FROM offers o JOIN retailers r ON r.id = o.retailer_id GROUP BY 1) s ON s.product_id = p.id"""


CTES["summary"] = summary(True)
CTES["summary_all"] = summary(False)


def with_ctes(query: str, **extra: str) -> str:
    """Prefix ``query`` with the common table expressions it needs, in dependency order."""
    known = {**CTES, **extra}
    order: list[str] = []

    def need(sql: str) -> None:
        for name in known:
            if name not in order and re.search(rf"\b{name}\b", sql) and known[name] is not sql:
                need(known[name])
                if name not in order:
                    order.append(name)

    need(query)
    # A base table of the same name never depends on itself.
    return "WITH " + ",\n".join(f"{n} AS ({known[n]})" for n in order) + "\n" + query if order else query
