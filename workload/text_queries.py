"""Text, attribute, fingerprint and scalar operators over the hardware titles."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from pricetide.fixed_values import (
    ATTRIBUTES_UNKNOWN, BRAND_EQUAL, BRAND_UNEQUAL, BRAND_UNKNOWN, FINGERPRINT_KEYS, KNOWN_BRANDS,
    LOOSE_EXTRA_WORDS, NUMERIC_KEYS, STRICT_WORDS,
)
from pricetide.functions import attributes as A
from pricetide.functions import fingerprint as FP
from pricetide.functions import predicates as P
from pricetide.functions import similarity as SIM
from pricetide.functions import text as X
from pricetide.sources.lineage import stored
from workload import adapter
from workload.adapter import RUN_AS_OF, catalog, lines, titles
from workload.adapter_sql import with_ctes
from workload.registry import query

RUN_TS = f"TIMESTAMP '{RUN_AS_OF}'"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def word(text: str) -> str:
    return lit(rf"\b{re.escape(text)}\b")


BRANDS = sorted(KNOWN_BRANDS, key=len, reverse=True)
BRAND_SQL = "CASE " + " ".join(
    [f"WHEN regexp_matches(title, {word(b)}, 'i') THEN {lit(b)}" for b in BRANDS]
    + [f"WHEN starts_with(lower(title), {lit(b.lower())}) THEN {lit(b)}" for b in BRANDS]
) + " END"
MODEL_SQL = "CASE brand " + " ".join(
    f"WHEN {lit(b)} THEN trim(regexp_replace(title, {word(b)}, '', 'i'))" for b in BRANDS
) + " ELSE title END"


def squeeze(s: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({s}, '[^a-z0-9\s-]', '', 'g'), '\s{{2,}}', ' ', 'g'))"


def drop_words(s: str, words: list[str]) -> str:
    for w in sorted(words, key=len, reverse=True):
        s = f"regexp_replace({s}, {word(w.lower())}, '', 'gi')"
    return s


STRICT_SQL = squeeze(
    rf"regexp_replace({drop_words('lower(model)', STRICT_WORDS)}, '(\d+)\s*(gb|mb|mhz|cl\d+)', '\1', 'gi')"
)
LOOSE_SQL = squeeze(
    drop_words(r"regexp_replace(lower(model), '\b\d+(\.\d+)?\s*-?(core|ghz)\b', '', 'gi')", STRICT_WORDS + LOOSE_EXTRA_WORDS)
)
BASE_SQL = r"trim(regexp_replace(regexp_replace(lower(coalesce(nullif(loose, ''), nullif(strict, ''), nullif(model, ''), title)), '[^a-z0-9\s-]', ' ', 'g'), '\s+', ' ', 'g'))"
TEXT_CTES = {
    "branded": f"SELECT *, {BRAND_SQL} AS brand FROM titles",
    "modelled": f"SELECT *, {MODEL_SQL} AS model FROM branded",
    "normal": f"SELECT *, {STRICT_SQL} AS strict, {LOOSE_SQL} AS loose FROM modelled",
    "based": f"SELECT *, {BASE_SQL} AS base FROM normal",
}


def branded(spark, d):
    return titles(spark, d).withColumn("brand", X.brand(F.col("title")))


def modelled(spark, d):
    return branded(spark, d).withColumn("model", X.model(F.col("title"), F.col("brand")))


def normalized(rows):
    return rows.withColumns({"strict": X.normalize_strict(F.col("model")), "loose": X.normalize_loose(F.col("model"))})


def normal(spark, d):
    return normalized(modelled(spark, d))


@query("text_brand", with_ctes("SELECT offer_id, title, brand FROM branded", **TEXT_CTES))
def _(spark, d):
    return branded(spark, d).select("offer_id", "title", "brand")


@query("text_model", with_ctes("SELECT offer_id, model FROM modelled", **TEXT_CTES))
def _(spark, d):
    return modelled(spark, d).select("offer_id", "model")


@query("text_normalize_strict", with_ctes("SELECT offer_id, strict FROM normal", **TEXT_CTES))
def _(spark, d):
    return modelled(spark, d).select("offer_id", X.normalize_strict(F.col("model")).alias("strict"))


@query("text_normalize_loose", with_ctes("SELECT offer_id, loose FROM normal", **TEXT_CTES))
def _(spark, d):
    return modelled(spark, d).select("offer_id", X.normalize_loose(F.col("model")).alias("loose"))


@query("text_brand_default", with_ctes(
    "SELECT offer_id, coalesce(nullif(CASE WHEN l_partkey % 13 = 0 THEN 'Acme' ELSE '' END, ''), brand) AS brand FROM branded",
    **TEXT_CTES))
def _(spark, d):
    given = F.when(F.col("l_partkey") % 13 == 0, "Acme").otherwise("")
    return titles(spark, d).select("offer_id", X.brand_or(given, F.col("title")).alias("brand"))


@query("match_bucket_and_model_key", with_ctes("""
SELECT offer_id, replace(lower(category_name), ' ', '_') AS match_bucket,
  coalesce(nullif(loose, ''), nullif(strict, ''), model) AS model_key FROM normal""", **TEXT_CTES))
def _(spark, d):
    return normal(spark, d).select(
        "offer_id", X.match_bucket(F.col("category_name")).alias("match_bucket"),
        X.first_text(F.col("loose"), F.col("strict"), F.col("model")).alias("model_key"),
    )


# Attributes.


def _rules(low: str, rules) -> str:
    return "CASE " + " ".join(
        "WHEN " + " OR ".join(f"contains({low}, {lit(w)})" for w in words) + f" THEN {lit(label)}" for words, label in rules
    ) + " END"


def _rx(col: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({col}, {lit(pattern)}, {group}, 'i'), '')"


def _int(s: str) -> str:
    return f"CAST(CAST({s} AS BIGINT) AS VARCHAR)"


L = "lower(title)"
_cpu_socket = _rules(L, A.CPU_SOCKETS)
_board_socket = _rules(L, A.BOARD_SOCKETS)
_intel_chip, _amd_chip = f"upper({_rx('title', r'\b([ZBHXW][0-9]{3,4})')})", f"upper({_rx('title', r'\b([XBA][0-9]{3}E?)\b')})"
_amd_side = f"(contains({L}, 'amd') OR coalesce({_board_socket} IN ('AM5', 'AM4'), false))"
_intel_side = f"(contains({L}, 'intel') OR coalesce({_board_socket} IN ('LGA1700', 'LGA1200'), false))"
_flat = f"regexp_replace({L}, '[-_/]+', ' ', 'g')"
_tier = f"coalesce({_rx(_flat, A.PSU_80PLUS + '(titanium|platinum|gold|silver|bronze|white|standard)' + chr(92) + 'b')}, {_rx(_flat, chr(92) + 'b(titanium|platinum|gold|silver|bronze)' + chr(92) + 'b')}, CASE WHEN regexp_matches({_flat}, '\\b(?:80\\s*(?:\\+|plus)|80plus)\\b') THEN 'white' END)"
_disk = r"(\d+(\.\d)?)\s*(TB|GB)"
ATTRIBUTE_SQL = {
    "cpu": {
        "socket": _cpu_socket,
        "intel_series": f"CASE WHEN contains({L}, 'intel') OR {_cpu_socket} IN ('LGA1700', 'LGA1200') THEN {_rules(L, A.INTEL_SERIES)} END",
        "amd_series": f"CASE WHEN contains({L}, 'amd') OR {_cpu_socket} IN ('AM5', 'AM4') THEN {_rules(L, A.AMD_SERIES)} END",
    },
    "gpu": {"vram_gb": _int(_rx("title", r"(\d+)\s*GB")), "series": _rules(L, A.GPU_SERIES)},
    "monitor": {
        "screen_size_inch": f"CAST(CAST({_rx('title', r'(\d{2}(\.\d)?)\s*(inch|\")')} AS DOUBLE) AS VARCHAR)",
        "resolution": _rules(L, A.RESOLUTIONS), "panel_type": _rules(L, A.PANELS),
        "refresh_rate_hz": _int(_rx("title", r"(\d{2,3})\s*hz")), "hdr_level": _rules(L, A.HDR_LEVELS),
    },
    "board": {
        "socket": _board_socket,
        "form_factor": f"""CASE WHEN contains({L}, 'e-atx') OR contains({L}, 'eatx') THEN 'E-ATX'
            WHEN contains({L}, 'atx') AND NOT contains({L}, 'micro-atx') THEN 'ATX' WHEN contains({L}, 'micro-atx') THEN 'Micro-ATX'
            WHEN contains({L}, 'mini-itx') OR contains({L}, 'mitx') THEN 'Mini-ITX' END""",
        "amd_chipset": f"CASE WHEN {_amd_side} THEN {_amd_chip} WHEN {_intel_side} THEN NULL WHEN {_intel_chip} IS NULL THEN {_amd_chip} END",
        "intel_chipset": f"CASE WHEN NOT {_amd_side} THEN {_intel_chip} END",
    },
    "ram": {
        "type": _rules(L, A.RAM_TYPES), "capacity_gb": _int(_rx("title", r"(\d+)\s*GB")),
        "speed_mhz": _int(_rx("title", r"(\d{4,})\s*MHz")),
        "form_factor": f"CASE WHEN contains({L}, 'sodimm') THEN 'SODIMM' ELSE 'Desktop' END",
        "ecc": f"CASE WHEN regexp_matches(replace({L}, 'non-ecc', '#'), '\\becc\\b') THEN 'ECC' ELSE 'Non-ECC' END",
    },
    "disk": {
        "type": _rules(L, A.DISK_TYPES),
        "capacity_gb": f"""CAST(CAST(trunc(CAST({_rx('title', _disk)} AS DOUBLE) *
            CASE WHEN upper({_rx('title', _disk, 3)}) = 'TB' THEN 1000 ELSE 1 END) AS BIGINT) AS VARCHAR)""",
        "form_factor": _rules(L, A.DISK_FORMS),
    },
    "psu": {
        "wattage": _int(_rx("title", r"(\d{3,4})W")),
        "rating": f"""'80+ ' || CASE {_tier} WHEN 'standard' THEN 'White' WHEN 'white' THEN 'White' WHEN 'bronze' THEN 'Bronze'
            WHEN 'silver' THEN 'Silver' WHEN 'gold' THEN 'Gold' WHEN 'platinum' THEN 'Platinum' WHEN 'titanium' THEN 'Titanium' END""",
        "modularity": _rules(L, A.MODULARITY),
    },
    "case": {"size": _rules(L, A.CASE_SIZES)},
    "cooler": {"type": _rules(L, A.COOLER_TYPES)},
}


def _attribute_query(label: str, columns: dict[str, str]) -> None:
    picked = ", ".join(f"{sql} AS {k}" for k, sql in columns.items())

    @query(f"attributes_{label}", with_ctes(f"SELECT offer_id, {picked} FROM titles"))
    def _(spark, d):
        out = titles(spark, d).withColumn("a", A.EXTRACTORS[label](F.col("title")))
        return out.select("offer_id", *[F.try_element_at("a", F.lit(k)).alias(k) for k in columns])


for _label, _columns in ATTRIBUTE_SQL.items():
    _attribute_query(_label, _columns)

ALL_KEYS = sorted({k for cols in ATTRIBUTE_SQL.values() for k in cols})
FAMILY_OF = dict(zip(adapter.TITLE_CATEGORIES, ["gpu", "cpu", "board", "ram", "disk", "psu", "case", "monitor", "cooler"]))
ROUTED_SQL = "SELECT based.*, " + ", ".join(
    "CASE category_name " + " ".join(
        f"WHEN {lit(c)} THEN {ATTRIBUTE_SQL[f][k]}" for c, f in FAMILY_OF.items() if k in ATTRIBUTE_SQL[f]
    ) + f" END AS a_{k}"
    for k in ALL_KEYS
) + " FROM based"


def attributed(spark, d):
    """Attributes, which a fingerprint reads many times, come before the normal forms, which it reads once and only where it needs them."""
    return normalized(modelled(spark, d).withColumn("attributes", A.attributes(F.col("title"), F.col("category_name"))))


@query("attributes_routed", with_ctes(
    f"SELECT offer_id, {', '.join('a_' + k for k in ALL_KEYS)} FROM routed", **TEXT_CTES, routed=ROUTED_SQL))
def _(spark, d):
    out = titles(spark, d).withColumn("a", A.attributes(F.col("title"), F.col("category_name")))
    return out.select("offer_id", *[F.try_element_at("a", F.lit(k)).alias(f"a_{k}") for k in ALL_KEYS])


def _pairs_sql(shown: bool) -> str:
    def one(k: str) -> str:
        if not shown:
            return f"{lit(k + '=')} || a_{k}"
        if k in NUMERIC_KEYS:
            return f"{lit(f'({chr(39)}{k}{chr(39)}, ')} || a_{k} || ')'"
        quote = f"CASE WHEN contains(a_{k}, {lit(chr(39))}) THEN '\"' ELSE {lit(chr(39))} END"
        return f"{lit(f'({chr(39)}{k}{chr(39)}, ')} || {quote} || a_{k} || {quote} || ')'"

    return "CASE category_name " + " ".join(
        f"WHEN {lit(c)} THEN list_filter([{', '.join(one(k) for k in FINGERPRINT_KEYS[c.lower()])}], lambda x: x IS NOT NULL)"
        for c in adapter.TITLE_CATEGORIES
    ) + " END"


@query("fingerprint_base", with_ctes("SELECT offer_id, base FROM based", **TEXT_CTES))
def _(spark, d):
    base = X.fingerprint_base(F.col("loose"), F.col("strict"), F.col("model"), F.col("title"))
    return normal(spark, d).select("offer_id", base.alias("base"))


@query("fingerprint_attributes", with_ctes(
    f"SELECT offer_id, array_to_string({_pairs_sql(False)}, ';') AS pairs FROM routed", **TEXT_CTES, routed=ROUTED_SQL))
def _(spark, d):
    pairs = FP.attribute_pairs(F.col("category_name"), F.col("attributes"))
    shown = F.array_join(F.transform(pairs, lambda p: F.concat(p["key"], F.lit("="), p["value"])), ";")
    return attributed(spark, d).select("offer_id", shown.alias("pairs"))


FINGERPRINT_SQL = f"""SELECT *, substr(sha1('(' || category_id || ', ''' || lower(coalesce(brand, '')) || ''', ''' || base || ''', ('
  || array_to_string(pairs, ', ') || CASE WHEN len(pairs) = 1 THEN ',)' ELSE ')' END || ')'), 1, 24) AS fingerprint
  FROM (SELECT *, {_pairs_sql(True)} AS pairs FROM routed)"""
IDENTITY_CTES = {**TEXT_CTES, "routed": ROUTED_SQL, "printed": FINGERPRINT_SQL}


def printed(spark, d):
    """Titles with fingerprint. Materialized where it is joined on: a filter on the fingerprint would otherwise be
    pushed below the text expressions and evaluate them twice."""
    c = F.col
    return attributed(spark, d).withColumn(
        "fingerprint",
        FP.fingerprint(c("category_id"), c("category_name"), c("brand"), c("attributes"), c("loose"), c("strict"),
                       c("model"), c("title")),
    )


@query("fingerprint", with_ctes("SELECT offer_id, fingerprint FROM printed", **IDENTITY_CTES))
def _(spark, d):
    return printed(spark, d).select("offer_id", "fingerprint")


@query("source_hash", with_ctes("SELECT id, substr(sha1(source_url), 1, 24) AS source_hash FROM listings"))
def _(spark, d):
    return catalog(spark, d).listings.select("id", X.short_hash(F.col("source_url")).alias("source_hash"))


# Scalars.


@query("price_from_text", with_ctes(r"""
SELECT offer_id, l_orderkey, price_text, CASE WHEN regexp_matches(bare, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$')
  THEN TRY_CAST(bare AS DOUBLE) END AS price FROM (
SELECT *, trim(replace(replace(price_text, '$', ''), ',', '')) AS bare FROM (
SELECT offer_id, l_orderkey, CASE WHEN l_tax = 0 THEN 'POA' ELSE '$' || format('{:,}', CAST(floor(u) AS BIGINT)) END AS price_text
FROM li))"""))
def _(spark, d):
    rows = lines(spark, d).withColumn("price_text", adapter.price_text())
    return rows.select("offer_id", "l_orderkey", "price_text", X.price_from_text(F.col("price_text")).alias("price"))


@query("run_age_hours", with_ctes(f"""
SELECT id, CASE WHEN finished_at IS NOT NULL THEN greatest(0,
  CAST(floor(date_diff('microsecond', finished_at, {RUN_TS}) / 3600000000.0) AS BIGINT)) END AS age_hours FROM runs"""))
def _(spark, d):
    return catalog(spark, d).runs.select("id", P.age_hours(F.col("finished_at"), RUN_AS_OF).alias("age_hours"))


@query("severity", with_ctes("""
SELECT id, CASE WHEN listings_seen <= 0 THEN 'ok' WHEN scraper_name = 'error' THEN 'critical' ELSE 'warning' END AS severity
FROM runs"""))
def _(spark, d):
    return catalog(spark, d).runs.select(
        "id", P.severity(F.col("listings_seen"), F.col("scraper_name") == "error").alias("severity")
    )


@query("snapshot_validation", with_ctes("""
SELECT offer_id, l_orderkey, l_linenumber, price, CASE WHEN price <= 0 OR price > 50000 THEN 'suspicious_price' END AS problem
FROM (SELECT *, CASE WHEN l_tax <> 0 THEN l_extendedprice END AS price FROM li)"""))
def _(spark, d):
    price = F.when(F.col("l_tax") != 0, F.col("l_extendedprice"))
    return lines(spark, d).select(
        "offer_id", "l_orderkey", "l_linenumber", price.alias("price"),
        P.snapshot_problem(F.lit("x"), price).alias("problem"),
    )


# Candidate score parts that plain SQL can state: each title against its part's own product.

PARTS_CTES = {
    **IDENTITY_CTES,
    "own": "SELECT l_partkey AS pk, offer_id AS own_offer, brand AS p_brand_name, fingerprint AS p_fp, "
           + ", ".join(f"a_{k} AS p_{k}" for k in ALL_KEYS) + " FROM printed",
    "owned": "SELECT own.* FROM own JOIN (SELECT pk, min(own_offer) AS own_offer FROM own GROUP BY 1) USING (pk, own_offer)",
}
_shared = " + ".join(f"CAST(a_{k} IS NOT NULL AND p_{k} IS NOT NULL AS INTEGER)" for k in ALL_KEYS)
_same = " + ".join(f"CAST(coalesce(a_{k} = p_{k}, false) AS INTEGER)" for k in ALL_KEYS)


@query("candidate_score_parts", with_ctes(f"""
SELECT offer_id, CASE WHEN brand IS NULL OR p_brand_name IS NULL THEN {BRAND_UNKNOWN}::DOUBLE
    WHEN lower(brand) = lower(p_brand_name) THEN {BRAND_EQUAL}::DOUBLE ELSE {BRAND_UNEQUAL}::DOUBLE END AS brand_score,
  CASE WHEN shared = 0 THEN {ATTRIBUTES_UNKNOWN}::DOUBLE ELSE (CAST(same AS DOUBLE) / shared) * 100.0::DOUBLE END AS attribute_score,
  fingerprint = p_fp AS fingerprint_match
FROM (SELECT *, {_shared} AS shared, {_same} AS same FROM printed JOIN owned ON pk = l_partkey + 1)""", **PARTS_CTES))
def _(spark, d):
    rows = stored(printed(spark, d).select("offer_id", "l_partkey", "brand", "fingerprint", "attributes"))
    first = rows.groupBy("l_partkey").agg(F.min("offer_id").alias("offer_id"))
    own = rows.join(first, ["l_partkey", "offer_id"]).select(
        F.col("l_partkey").alias("pk"), *[F.col(c).alias(f"p_{c}") for c in ("brand", "fingerprint", "attributes")]
    )
    joined = rows.join(own, F.col("pk") == F.col("l_partkey") + 1)
    return joined.select(
        "offer_id",
        SIM.brand_score(F.lower("brand"), F.lower("p_brand")).alias("brand_score"),
        SIM.attribute_score(F.col("attributes"), F.col("p_attributes")).alias("attribute_score"),
        (F.col("fingerprint") == F.col("p_fingerprint")).alias("fingerprint_match"),
    )
