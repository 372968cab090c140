"""Review queue: decision list, candidates, manual and bulk resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide import fixed_values as V
from pricetide.functions import predicates as P
from pricetide.operators import match as M
from pricetide.operators import stats as S
from pricetide.schemas import Catalog
from pricetide.sources.lineage import grown, stored


def _matching(cat: Catalog, decision, retailer_id, category_id, search) -> DataFrame:
    rows = cat.decisions.filter(P.all_of(P.equals(F.col("decision"), decision)))
    if retailer_id is None and category_id is None and not search:
        return rows
    listing = cat.listings.select(
        F.col("id").alias("listing_id"), F.col("retailer_id").alias("_r"), F.col("category_id").alias("_c"),
        F.col("title").alias("_t"),
    )
    text = None
    if search:
        pattern = f"%{search.strip()}%"
        text = F.col("fingerprint").ilike(pattern) | F.col("_t").ilike(pattern)
    keep = P.all_of(P.equals(F.col("_r"), retailer_id), P.equals(F.col("_c"), category_id), text)
    return rows.join(listing, "listing_id").filter(keep).drop("_r", "_c", "_t")


def _order(sort_by: str) -> list:
    newest = [F.col("created_at").desc(), F.col("id").desc()]
    return [F.col("confidence").desc_nulls_last(), *newest] if sort_by == "confidence_desc" else newest


def decisions(
    cat: Catalog, *, decision: str | None = None, retailer_id=None, category_id=None, search: str | None = None,
    sort_by: str = "created_desc", limit: int = 50, offset: int = 0,
) -> DataFrame:
    """A page of decisions with listing, retailer, category and product.

    Filters and the page limit run on the decision log (plus the listing columns they test); the other tables
    are joined to the page only.
    """
    order = _order(sort_by)
    page = _matching(cat, decision, retailer_id, category_id, search).orderBy(*order).offset(offset).limit(limit)
    listing = cat.listings.select(
        F.col("id").alias("listing_id"), "title", "source_url", F.col("status").alias("listing_status"),
        "retailer_id", "category_id",
    )
    name = lambda df, key, out: df.select(F.col("id").alias(key), F.col(out[0]).alias(out[1]))
    return (
        page.select("id", "decision", "confidence", "matcher", "fingerprint", "created_at", "listing_id", "product_id")
        .join(listing, "listing_id")
        .join(name(cat.retailers, "retailer_id", ("name", "retailer_name")), "retailer_id")
        .join(name(cat.categories, "category_id", ("name", "category_name")), "category_id", "left")
        .join(name(cat.products, "product_id", ("canonical_name", "canonical_name")), "product_id", "left")
        .orderBy(*order)
    )


def decisions_total(
    cat: Catalog, *, decision: str | None = None, retailer_id=None, category_id=None, search: str | None = None
) -> DataFrame:
    return _matching(cat, decision, retailer_id, category_id, search).agg(F.count("*").alias("total"))


#: what a candidate shows besides its ids
SHOWN = ["position", "score", "model_score", "name_score", "reasons", "canonical_name", "fingerprint", "brand", "category_name",
         "best_price", "retailer_count"]


def _listing_texts(cat: Catalog, listings: DataFrame) -> DataFrame:
    """Listing columns the ranking reads, with the category's name."""
    named = cat.categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    return listings.join(named, "category_id", "left").select(
        F.col("id").alias("listing_id"), "title", "brand", "model", "normalized_model", "loose_normalized_model",
        "category_id", "category_name",
    )


def _ranked(
    cat: Catalog, listings: DataFrame, *, k: int, search: str | None = None, min_score: float = 0.0
) -> tuple[DataFrame, DataFrame]:
    """``(listing_id, probe_id)``, and the ranked products of each ``probe_id`` with price and retailer counts.

    Products and the rollup of offers feed the ranking and what is shown of it, so both are computed once.
    """
    products = stored(cat.products.select(
        "id", "canonical_name", "category_id", "brand", "model_key", "fingerprint", "attributes", "is_active"
    ))
    rollup = grown(stored(S.candidate_rollup(cat.offers)))
    asked, best = M.rank_texts(
        _listing_texts(cat, listings), products, rollup.select("product_id", F.col("offer_count").alias("c_offers")),
        k=k, search=search, min_score=min_score,
    )
    product = grown(products).select(F.col("id").alias("product_id"), "canonical_name", "fingerprint", "category_id", "brand")
    named = cat.categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    return asked, (
        best.join(product, "product_id").join(named, "category_id", "left").join(rollup.drop("offer_count"), "product_id", "left")
        .withColumn("retailer_count", F.coalesce("retailer_count", F.lit(0)).cast("long"))
        .select("probe_id", "product_id", "category_id", *SHOWN)
    )


def candidates(
    cat: Catalog, listings: DataFrame, *, k: int = 8, search: str | None = None, min_score: float = 0.0
) -> DataFrame:
    """Ranked candidate products for a set of listing rows, with price and retailer counts."""
    asked, best = _ranked(cat, listings, k=k, search=search, min_score=min_score)
    return asked.join(best, "probe_id").select("product_id", "category_id", "listing_id", *SHOWN)


def decision_candidates(
    cat: Catalog, decision_ids: DataFrame | None = None, *, k: int = 8, search: str | None = None
) -> DataFrame:
    """Candidates for the given decisions, or for the whole review queue."""
    if decision_ids is None:
        rows = cat.decisions.filter(F.col("decision") == "needs_review")
    else:
        rows = cat.decisions.join(decision_ids.select("id"), "id", "left_semi")
    decided = grown(stored(rows.select(F.col("id").alias("decision_id"), "listing_id")))
    wanted = cat.listings_of(decided.select(F.col("listing_id").alias("id")))
    asked, best = _ranked(cat, wanted, k=k, search=search)
    # Narrow rows meet first; each candidate is then joined to the decisions of its text once.
    return decided.join(grown(asked), "listing_id").join(best, "probe_id").select(
        "listing_id", "decision_id", "product_id", "category_id", *SHOWN
    )


def pending_with_top_candidate(cat: Catalog, **page) -> DataFrame:
    """A page of the review queue with each decision's best candidate."""
    rows = stored(decisions(cat, **{**page, "decision": "needs_review"}))
    wanted = cat.listings_of(rows.select(F.col("listing_id").alias("id")))
    top = candidates(cat, wanted, k=1).select(
        "listing_id", F.col("product_id").alias("top_product_id"), F.col("canonical_name").alias("top_name"),
        F.col("score").alias("top_score"), F.col("reasons").alias("top_reasons"),
        F.col("best_price").alias("top_best_price"), F.col("retailer_count").alias("top_retailer_count"),
    )
    return rows.join(top, "listing_id", "left").orderBy(*_order(page.get("sort_by", "created_desc")))


def check_resolutions(cat: Catalog, resolutions: DataFrame) -> DataFrame:
    """Resolutions ``(decision_id, decision, product_id, rationale, seq)`` with the reason each is refused, or null."""
    known = cat.decisions.select(F.col("id").alias("decision_id"), "listing_id")
    listing = cat.listings.select(F.col("id").alias("listing_id"), F.col("category_id").alias("_listing_category"))
    product = cat.products.select(F.col("id").alias("product_id"), F.col("category_id").alias("_product_category"))
    matched = F.col("decision") == "manual_matched"
    problem = (
        F.when(~F.col("decision").isin("manual_matched", "manual_rejected"), "unsupported_decision")
        .when(F.col("listing_id").isNull(), "decision_not_found")
        .when(matched & F.col("product_id").isNull(), "product_required")
        .when(matched & F.col("_product_category").isNull(), "product_not_found")
        .when(matched & (F.col("_listing_category") != F.col("_product_category")), "category_mismatch")
    )
    return (
        resolutions.join(known, "decision_id", "left").join(listing, "listing_id", "left")
        .join(product, "product_id", "left")
        .withColumn("problem", problem)
        .withColumnRenamed("_product_category", "product_category_id")
        .drop("_listing_category")
    )


def resolve(cat: Catalog, resolutions: DataFrame) -> tuple[Catalog, DataFrame]:
    """Apply manual matches and rejections; returns the next catalog and the refused resolutions.

    Later ``seq`` wins. A rejection keeps the product an earlier match in the same batch gave the offer.
    """
    checked = check_resolutions(cat, resolutions)
    valid = checked.filter(F.col("problem").isNull())
    matched = F.col("decision") == "manual_matched"
    last = valid.groupBy("decision_id").agg(F.max_by(F.struct("decision", "product_id"), "seq").alias("r"),
                                            F.max_by("rationale", F.when(F.col("rationale").isNotNull(), F.col("seq"))).alias("why"))
    new_decisions = (
        cat.decisions.join(last.withColumnRenamed("decision_id", "id"), "id", "left")
        .withColumns(
            {
                "product_id": F.when(F.col("r").isNull(), F.col("product_id"))
                .when(F.col("r.decision") == "manual_matched", F.col("r.product_id")),
                "decision": F.coalesce("r.decision", "decision"),
                "matcher": F.when(F.col("r").isNotNull(), "manual_review").otherwise(F.col("matcher")),
                "confidence": F.when(F.col("r").isNotNull(), 1.0).otherwise(F.col("confidence")),
                "rationale": F.coalesce("why", "rationale"),
            }
        )
        .select(*cat.decisions.columns)
    )
    per_listing = valid.groupBy("listing_id").agg(
        F.max_by(matched, "seq").alias("_keep"),
        F.max_by(F.when(matched, F.struct("product_id", "product_category_id")), F.when(matched, F.col("seq"))).alias("_to"),
    )
    live = F.col("_keep") & (F.col("status") == "available")
    new_offers = (
        cat.offers.join(per_listing, "listing_id", "left")
        .withColumns(
            {
                "product_id": F.coalesce("_to.product_id", "product_id"),
                "category_id": F.when(F.col("_to").isNotNull(), F.col("_to.product_category_id")).otherwise(F.col("category_id")),
                "is_active": F.when(F.col("_keep").isNull(), F.col("is_active")).otherwise(live),
            }
        )
        .select(*cat.offers.columns)
    )
    chosen = valid.filter(matched).select(F.col("product_id").alias("id"), F.lit(True).alias("_chosen")).distinct()
    new_products = (
        cat.products.join(chosen, "id", "left")
        .withColumn("is_active", F.col("is_active") | F.coalesce("_chosen", F.lit(False)))
        .select(*cat.products.columns)
    )
    return (
        cat.with_tables(decisions=new_decisions, offers=new_offers, products=new_products),
        checked.filter(F.col("problem").isNotNull()),
    )


def bulk_outcomes(cat: Catalog, decision_ids: DataFrame, *, min_score: float = V.BULK_MIN_SCORE) -> DataFrame:
    """What bulk acceptance does with each decision: ``resolved`` or the reason it is skipped."""
    known = cat.decisions.select("id", "decision", "listing_id")
    asked = stored(decision_ids.select("id").distinct().join(known, "id", "left"))
    pending = asked.filter(F.col("decision") == "needs_review")
    wanted = cat.listings_of(pending.select(F.col("listing_id").alias("id")))
    top = M.rank(_listing_texts(cat, wanted), cat.products, cat.offers, k=1, min_score=min_score).select(
        "listing_id", "product_id", "score"
    )
    stocked = cat.products.filter("is_active").select(F.col("category_id").alias("_stocked")).distinct()
    place = cat.listings.select(F.col("id").alias("listing_id"), "category_id")
    # Any active product of the listing's category, or of the catalog when the listing has no category.
    some = stocked.select(F.lit(True).alias("_any")).limit(1)
    here = stocked.withColumn("_here", F.lit(True))
    rows = (
        asked.join(place, "listing_id", "left")
        .join(here, F.col("category_id") == F.col("_stocked"), "left")
        .join(some, F.col("category_id").isNull() == F.col("_any"), "left")
        .join(top, "listing_id", "left")
        .join(cat.products.select(F.col("id").alias("product_id"), "canonical_name"), "product_id", "left")
    )
    has_candidate = F.coalesce("_here", "_any", F.lit(False))
    outcome = (
        F.when(F.col("decision").isNull(), "decision_not_found")
        .when(F.col("decision") != "needs_review", "decision_not_pending_review")
        .when(~has_candidate, "no_candidate")
        .when(F.col("score").isNull() | (F.col("score") < min_score), "below_min_score")
        .otherwise("resolved")
    )
    return rows.select(
        F.col("id").alias("decision_id"), outcome.alias("outcome"), "product_id", "canonical_name", "score"
    )


def bulk_apply(
    cat: Catalog, decision_ids: DataFrame, *, min_score: float = V.BULK_MIN_SCORE
) -> tuple[Catalog, DataFrame]:
    """Accept top candidates in bulk. One unknown id means nothing is applied; a refused resolution is reported as skipped,
    with the reason. Of two decisions on one listing the later one in the catalog holds."""
    outcomes = bulk_outcomes(cat, decision_ids, min_score=min_score)
    unknown = outcomes.filter(F.col("outcome") == "decision_not_found").limit(1).select(F.lit(1).alias("_one"))
    accepted = (
        outcomes.filter(F.col("outcome") == "resolved")
        .withColumn("_one", F.lit(1)).join(unknown, "_one", "left_anti")
        .select(
            "decision_id", F.lit("manual_matched").alias("decision"), "product_id",
            F.concat(F.lit(V.RATIONALE_BULK), "canonical_name").alias("rationale"), F.col("decision_id").alias("seq"),
        )
    )
    order = cat.decisions.select(F.col("id").alias("decision_id"), F.struct("created_at", "id").alias("seq"))
    updated, refused = resolve(cat, accepted.drop("seq").join(order, "decision_id"))
    skipped = refused.select("decision_id", F.col("problem").alias("_problem"))
    return updated, outcomes.join(skipped, "decision_id", "left").withColumn("outcome", F.coalesce("_problem", "outcome")).drop("_problem")
