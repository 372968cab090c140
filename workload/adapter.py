"""Catalog tables as DataFrames over the driver's parquet tables. ``adapter_sql`` states the same in SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LINE_AS_OF = datetime(2001, 11, 5)
RUN_AS_OF = datetime(2024, 1, 31)
P_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
TITLE_BRANDS = ["ASUS", "MSI", "Gigabyte", "Corsair", "be quiet!", "Lian Li", "Samsung", "Western Digital", "WD", "LG"]
TITLE_CATEGORIES = [
    "Graphics Cards", "CPUs", "Motherboards", "Memory (RAM)", "Storage (SSD/HDD)", "Power Supplies", "PC Cases",
    "Monitors", "Cooling",
]
OFFER_KEY = 100000


TEST_TABLES = {
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "pages": "page_id bigint, url string, html string",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table under its known schema, so that no job runs to infer it."""
    return spark.read.schema(TEST_TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").withColumns(
        {
            "u": F.col("l_extendedprice") / F.col("l_quantity"),
            "offer_id": F.col("l_partkey") * OFFER_KEY + F.col("l_suppkey"),
        }
    )


def retailers(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
        F.concat(F.lit("https://r"), F.col("s_suppkey").cast("string"), F.lit(".example")).alias("url"),
        F.lit(None).cast("string").alias("logo_url"),
    )


def _type_id() -> Column:
    return F.coalesce(*[F.when(F.col("p_type") == t, F.lit(i)) for i, t in enumerate(P_TYPES, 1)]).cast("long")


def categories(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "part").select(_type_id().alias("id"), F.col("p_type").alias("name")).distinct()


def products(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat_ws(" ", "p_name", "p_brand").alias("canonical_name"),
        _type_id().alias("category_id"),
        F.when(F.col("p_size") % 10 != 0, F.col("p_brand")).alias("brand"),
        F.concat(F.lit("fp-"), F.col("p_partkey").cast("string")).alias("fingerprint"),
        F.create_map(
            F.lit("size"), F.col("p_size").cast("string"), F.lit("type"), F.col("p_type")
        ).alias("attributes"),
        (F.col("p_partkey") % 20 != 0).alias("is_active"),
    )


ORD = ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice"]


def latest_lines(spark, sf_dir) -> DataFrame:
    """Latest line and second-latest price per (part, supplier); the row limit per group runs map-side."""
    newest_first = W.partitionBy("offer_id").orderBy(*[F.col(c).desc() for c in ORD])
    return (
        lines(spark, sf_dir)
        .withColumn("rn", F.row_number().over(newest_first))
        .filter("rn <= 2")
        .groupBy("offer_id", "l_partkey", "l_suppkey")
        .agg(
            F.max(F.when(F.col("rn") == 1, F.struct(
                "u", "l_tax", "l_linestatus", "l_returnflag", "l_shipdate", "l_linenumber"))).alias("last"),
            F.max(F.when(F.col("rn") == 2, F.col("u"))).alias("previous_price"),
        )
        .select("offer_id", "l_partkey", "l_suppkey", "last.*", "previous_price")
    )


def _status() -> Column:
    return (
        F.when(F.col("l_linestatus") == "O", "available")
        .when(F.col("l_returnflag") == "R", "end_of_life")
        .otherwise("unavailable")
    )


def _source_url() -> Column:
    return F.concat(
        F.lit("https://r"), F.col("l_suppkey").cast("string"), F.lit(".example/p/"), F.col("l_partkey").cast("string")
    )


def offers(spark, sf_dir) -> DataFrame:
    named = products(spark, sf_dir).select(
        F.col("id").alias("l_partkey"), F.col("canonical_name").alias("listing_name"), "category_id"
    )
    return latest_lines(spark, sf_dir).join(named, "l_partkey").select(
        F.col("offer_id").alias("id"),
        F.col("l_partkey").alias("product_id"),
        F.col("offer_id").alias("listing_id"),
        F.col("l_suppkey").alias("retailer_id"),
        F.when(F.col("l_linenumber") != 7, F.col("category_id")).alias("category_id"),
        "listing_name",
        _source_url().alias("listing_url"),
        F.lit(None).cast("string").alias("image_url"),
        F.when(F.col("l_tax") != 0, F.col("u")).alias("current_price"),
        "previous_price",
        _status().alias("status"),
        ((F.col("l_linestatus") == "O") & (F.col("l_returnflag") != "A")).alias("is_active"),
        F.col("l_shipdate").alias("last_seen_at"),
    )


def listings(spark, sf_dir) -> DataFrame:
    o = offers(spark, sf_dir)
    return o.select(
        F.col("id"), "retailer_id", "category_id", F.col("listing_url").alias("source_url"),
        F.col("listing_name").alias("title"), "status", "last_seen_at",
    )


def observations(spark, sf_dir) -> DataFrame:
    return lines(spark, sf_dir).select(
        F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").alias("id"),
        "offer_id",
        F.col("l_shipdate").alias("observed_at"),
        F.col("u").alias("price"),
        (F.col("l_linestatus") == "O").alias("in_stock"),
    )


def runs(spark, sf_dir) -> DataFrame:
    known = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"), F.lit(True).alias("known"))
    events = read(spark, sf_dir, "events").join(known, "user_id", "left")
    kind = F.col("event_type")
    status = (
        F.when(kind.isin("view", "purchase"), "succeeded")
        .when(kind == "click", "partial")
        .when(kind == "error", "failed")
        .otherwise("started")
    )
    closed = ~kind.isin("error", "signup")
    seen = F.floor("value").cast("long")
    return events.select(
        F.col("event_id").alias("id"),
        F.when(F.col("known") & (F.col("user_id") % 7 != 0), F.col("user_id")).alias("retailer_id"),
        F.col("ts").alias("started_at"),
        F.when(closed, F.col("ts") + F.expr("INTERVAL '1' HOUR")).alias("finished_at"),
        status.alias("status"),
        F.lit("scraper").alias("trigger_source"),
        kind.alias("scraper_name"),
        seen.alias("listings_seen"),
        F.floor(seen / 2).cast("long").alias("listings_created"),
        (seen - F.floor(seen / 2)).cast("long").alias("listings_updated"),
        F.when(kind == "error", F.col("props")).alias("error_summary"),
    )


DECISION_BY_PRIORITY = {
    "1-URGENT": "needs_review", "2-HIGH": "auto_matched", "3-MEDIUM": "manual_matched",
    "4-NOT SPECIFIED": "manual_rejected", "5-LOW": "auto_rejected",
}


def decisions(spark, sf_dir) -> DataFrame:
    listing = (
        lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("offer_id").alias("listing_id"))
    )
    orders = read(spark, sf_dir, "orders").join(listing, "o_orderkey")
    kind = F.coalesce(*[F.when(F.col("o_orderpriority") == p, d) for p, d in DECISION_BY_PRIORITY.items()])
    product = F.expr(f"listing_id div {OFFER_KEY}")
    return orders.select(
        F.col("o_orderkey").alias("id"), "listing_id",
        F.when(kind.isin("auto_matched", "manual_matched"), product).alias("product_id"),
        kind.alias("decision"),
        F.when(F.col("o_orderkey") % 17 != 0, (F.col("o_orderkey") % 101) / F.lit(100.0)).alias("confidence"),
        F.lit("candidate_rank").alias("matcher"),
        F.concat(F.lit("fp-"), product.cast("string")).alias("fingerprint"),
        F.col("o_orderdate").alias("created_at"),
    )


class LazyCatalog:
    """The catalog interface over the test tables; a table is planned when a query first asks for it."""

    BUILDERS = {
        "retailers": retailers, "categories": categories, "products": products, "listings": listings,
        "offers": offers, "observations": observations, "runs": runs, "decisions": decisions,
    }

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._args = (spark, sf_dir)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.BUILDERS:
            raise AttributeError(name)
        table = self.BUILDERS[name](*self._args)
        self.__dict__[name] = table
        return table

    def listings_of(self, ids: DataFrame) -> DataFrame:
        return self.listings.join(ids.select("id"), "id", "left_semi")

    def with_tables(self, **tables: DataFrame) -> "LazyCatalog":
        changed = LazyCatalog(*self._args)
        changed.__dict__.update({**self.__dict__, **tables})
        return changed


def catalog(spark: SparkSession, sf_dir: str) -> LazyCatalog:
    return LazyCatalog(spark, sf_dir)


# Hardware titles over part and supplier keys, for the text and matching operators.


def title_category_id(k: Column) -> Column:
    return (k % 9 + 1).cast("long")


def title_category(k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in TITLE_CATEGORIES]), (k % 9 + 1).cast("int"))


def product_title(k: Column) -> Column:
    t = lambda c: c.cast("string")
    brand = F.when(k % 13 == 0, "Acme").otherwise(
        F.element_at(F.array(*[F.lit(b) for b in TITLE_BRANDS]), (k % 10 + 1).cast("int"))
    )
    ecc = F.element_at(F.array(*[F.lit(s) for s in ("", " SODIMM", " non-ECC", " ECC")]), (k % 4 + 1).cast("int"))
    shapes = [
        (brand, " GeForce RTX ", t(5050 + 10 * (k % 5)), " OC ", t(8 + 4 * (k % 3)), "GB"),
        ("AMD Ryzen ", t(3 + 2 * (k % 4)), " ", t(7000 + k % 900), "X3D AM5 8-Core Processor"),
        (brand, " B", t(650 + 10 * (k % 12)), "M mATX LGA1700"),
        (brand, " Vengeance ", t(16 * (1 + k % 4)), "GB DDR5 ", t(5200 + 400 * (k % 4)), "MHz", ecc),
        (brand, " 990 Pro ", t(1 + k % 4), "TB M.2 NVMe SSD"),
        (brand, " RM ", t(550 + 100 * (k % 5)), "W 80 Plus Gold Fully Modular"),
        (brand, " Dynamic EVO Mid Tower Case"),
        (brand, " ", t(24 + k % 10), '" ', t(120 + 24 * (k % 5)), "Hz 1440p IPS HDR400"),
        (brand, " H", t(100 + k % 60), "i 360mm AIO Liquid CPU Cooler"),
    ]
    out = [
        F.when(k % 9 == i, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
        for i, parts in enumerate(shapes)
    ]
    return F.coalesce(*out)


def listing_title(k: Column, s: Column) -> Column:
    suffix = F.element_at(
        F.array(*[F.lit(x) for x in ("", " Black", " White Edition", " (No Cooler)")]), (s % 4 + 1).cast("int")
    )
    return F.concat(product_title(k), suffix)


def titles(spark, sf_dir, wanted: DataFrame | None = None) -> DataFrame:
    """One hardware title per (part, supplier) pair that occurs in lineitem, or of those among them with a wanted ``id``."""
    pairs = lines(spark, sf_dir).select("offer_id", "l_partkey", "l_suppkey")
    if wanted is not None:
        pairs = pairs.join(wanted.select(F.col("id").alias("offer_id")), "offer_id", "left_semi")
    pairs = pairs.distinct()
    k = F.col("l_partkey")
    return pairs.select(
        "offer_id", "l_partkey", "l_suppkey", title_category_id(k).alias("category_id"),
        title_category(k).alias("category_name"), listing_title(k, F.col("l_suppkey")).alias("title"),
    )


def title_categories(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(title_category_id(k).alias("id"), title_category(k).alias("name")).distinct()


def price_text() -> Column:
    return F.when(F.col("l_tax") == 0, "POA").otherwise(
        F.concat(F.lit("$"), F.format_number(F.floor("u"), 0))
    )


def snapshots(spark, sf_dir) -> DataFrame:
    """Every lineitem row as a listing snapshot with a hardware title."""
    k = F.col("l_partkey")
    return lines(spark, sf_dir).select(
        listing_title(k, F.col("l_suppkey")).alias("name"),
        _source_url().alias("url"),
        F.when(F.col("l_tax") != 0, F.col("u")).alias("price"),
        F.when(F.col("l_linestatus") == "O", "available").otherwise("unavailable").alias("status"),
        F.lit(None).cast("string").alias("image_url"),
        F.lit(None).cast("double").alias("previous_price"),
        F.lit(None).cast("string").alias("retailer_sku"),
        F.lit(None).cast("string").alias("raw_payload"),
        F.col("l_suppkey").alias("retailer_id"),
        title_category_id(k).alias("category_id"),
        title_category(k).alias("category_name"),
        F.struct(*ORD).alias("seq"),
        F.date_format("l_shipdate", "yyyy-MM").alias("run_id"),
    )
