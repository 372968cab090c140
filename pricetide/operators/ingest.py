"""Set-based merge of a batch of listing snapshots into the catalog.

Decisions equal those of an item-by-item reading of the URLs' last snapshots in the order (seq, url): a listing is compared with
the catalog as it was when the batch began and with the products that earlier listings of the batch created, by the texts
they were created with. The last snapshot of a URL sets its state; every snapshot counts for the price history.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricetide import fixed_values as V
from pricetide.functions import attributes as A
from pricetide.functions import fingerprint as FP
from pricetide.functions import predicates as P
from pricetide.functions import text as X
from pricetide.operators import changes
from pricetide.operators import match as M
from pricetide.operators import stats as S
from pricetide.operators.election import elect
from pricetide.operators.ordering import numbered
from pricetide.schemas import Catalog
from pricetide.sources.lineage import cut, release, scratch, settled, stored

MANUAL = ("manual_matched", "manual_rejected")


@dataclass(frozen=True)
class IngestResult:
    catalog: Catalog
    results: DataFrame
    rejected: DataFrame
    conflicts: DataFrame
    new_observations: DataFrame


def _problem() -> Column:
    """What is wrong with a snapshot by itself, or null."""
    return F.coalesce(P.snapshot_problem(F.col("name"), F.col("price")), F.when(F.col("category_id").isNull(), "no_category"))


def _without_repeats(usable: DataFrame) -> DataFrame:
    """Usable snapshots, of which all but the greatest row of one URL and sequence number become a problem.

    Rows are written out for comparison only where a sequence number repeats.
    """
    same = W.partitionBy("url", "seq")
    row = F.to_json(F.struct(*[F.col(n) for n in sorted(usable.columns) if n != "problem"]))
    again = F.row_number().over(same.orderBy(F.col("_row").desc())) > 1
    counted = usable.withColumn("_row", F.when(F.count(F.lit(1)).over(same) > 1, row))
    return counted.withColumn("problem", F.when(again, "repeated_sequence")).drop("_row")


def _named(checked: DataFrame) -> DataFrame:
    return checked.withColumn("name", X.strip(F.col("name")))


def _checked(snapshots: DataFrame) -> DataFrame:
    """Snapshots with trimmed names and the ``problem`` of those that are not valid."""
    marked = snapshots.withColumn("problem", _problem())
    good = F.col("problem").isNull()
    return _named(_without_repeats(marked.filter(good)).unionByName(marked.filter(~good)))


def _checked_once(snapshots: DataFrame) -> DataFrame:
    """``_checked``, for a batch that is read several times: it is written down as it lies, and only snapshots that share
    a hash of URL and sequence number with another are dealt by them."""
    marked = stored(snapshots.withColumn("problem", _problem()))
    usable = marked.filter("problem is null").withColumn("_key", F.xxhash64("url", "seq"))
    shared = stored(usable.groupBy("_key").agg(F.count("*").alias("n")).filter("n > 1").select("_key"))
    if shared.isEmpty():
        release(shared)
        return _named(marked)
    apart = usable.join(shared, "_key", "left_anti").drop("_key")
    near = _without_repeats(usable.join(shared, "_key", "left_semi").drop("_key"))
    out = stored(apart.unionByName(near).unionByName(marked.filter("problem is not null")))
    release(marked, shared)
    return _named(out)


def validate(snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split snapshots into valid ones, with trimmed names, and rejected ones with a reason.

    A snapshot needs a category, and a URL takes one snapshot per sequence number: of several the greatest row stays.
    """
    return _split(_checked(snapshots))


def _split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return checked.filter(F.col("problem").isNull()).drop("problem"), checked.filter(F.col("problem").isNotNull())


def identify(snapshots: DataFrame) -> DataFrame:
    """Add brand, model texts, attributes and fingerprint."""
    c = F.col
    named = snapshots.withColumn("brand", X.brand(c("name")))
    named = named.withColumn("model", X.model(c("name"), c("brand")))
    named = named.withColumns(
        {
            "normalized_model": X.normalize_strict(c("model")),
            "loose_normalized_model": X.normalize_loose(c("model")),
            "attributes": A.attributes(c("name"), c("category_name")),
        }
    )
    return named.withColumn(
        "fingerprint",
        FP.fingerprint(c("category_id"), c("category_name"), c("brand"), c("attributes"),
                       c("loose_normalized_model"), c("normalized_model"), c("model"), c("name")),
    )


def new_product_id(category_id: Column, fingerprint: Column) -> Column:
    return F.concat_ws("-", category_id.cast("string"), fingerprint)


def exact_owner(products: DataFrame) -> DataFrame:
    """The least product of each identity, so that imported duplicates of one match no snapshot twice."""
    return products.groupBy("category_id", "fingerprint").agg(F.min("id").alias("exact_id"))


def duplicate_identities(products: DataFrame) -> DataFrame:
    """Identities that several products claim, with their number."""
    counts = products.filter(F.col("fingerprint").isNotNull()).groupBy("category_id", "fingerprint").agg(
        F.count("*").alias("products"), F.min("id").alias("exact_id"))
    return counts.filter(F.col("products") > 1)


def exact_matches(snapshots: DataFrame, products: DataFrame) -> DataFrame:
    """Identified snapshots with the product of equal category and fingerprint, if any."""
    return snapshots.join(exact_owner(products), ["category_id", "fingerprint"], "left")


def _known(cat: Catalog, latest: DataFrame) -> DataFrame:
    """Attach each URL's listing, latest decision, manually chosen product and exact product."""
    listing = cat.listings.select(F.col("source_url").alias("url"), F.col("id").alias("old_listing_id"))
    decided = S.latest_decision(cat.decisions).select(
        "listing_id", *[F.col(c).alias(f"was_{c}") for c in ("id", "decision", "product_id", "confidence", "matcher", "rationale")]
    )
    products = cat.products.select("id", "category_id", "fingerprint")
    chosen = products.select(F.col("id").alias("was_product_id"), F.col("category_id").alias("chosen_category_id"))
    exact = exact_owner(cat.products)
    decided_rows = (
        latest.join(listing, "url", "left")
        .withColumn("listing_id", F.coalesce("old_listing_id", X.short_hash(F.col("url"))))
        .join(decided, "listing_id", "left")
        .join(chosen, "was_product_id", "left")
    )
    return exact_matches(decided_rows, cat.products)


def _plan(decision, confidence, matcher, rationale, product) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        as_col(decision).alias("decision"), as_col(confidence).cast("double").alias("confidence"),
        as_col(matcher).alias("matcher"), as_col(rationale).alias("rationale"), product.alias("product_id"),
    )


def plan_matches(cat: Catalog, latest: DataFrame, compare_new: bool = True) -> DataFrame:
    """Decide product and decision per URL: kept manual decisions, exact identity, ranked candidate, new product.

    Without ``compare_new`` the new products of a batch are compared with the catalog only, not with each other.
    """
    known = stored(_known(cat, latest))
    c = F.col
    was = c("was_decision")
    kept = F.when(
        (was == "manual_matched") & c("chosen_category_id").isNotNull(),
        _plan("manual_matched", 1.0, "manual_review", F.coalesce(X.nonempty(c("was_rationale")), F.lit(V.RATIONALE_KEPT_MATCH)),
              c("was_product_id")),
    ).when(
        was == "manual_rejected",
        _plan("manual_rejected", 1.0, "manual_review", F.coalesce(X.nonempty(c("was_rationale")), F.lit(V.RATIONALE_KEPT_REJECT)),
              c("exact_id")),
    ).when(
        was == "needs_review",
        _plan("needs_review", c("was_confidence"), F.coalesce(X.nonempty(c("was_matcher")), F.lit("candidate_rank")),
              F.coalesce(X.nonempty(c("was_rationale")), F.lit(V.RATIONALE_PENDING)), c("exact_id")),
    )
    exact = _plan("auto_matched", 1.0, "fingerprint", V.RATIONALE_EXACT, c("exact_id"))
    settled_rows = known.withColumn("plan", F.coalesce(kept, F.when(c("exact_id").isNotNull(), exact)))
    open_rows = settled_rows.filter(c("plan").isNull())
    # Only products of categories that have open rows can be candidates; the rest of the catalog is left alone.
    near = cat.products.join(open_rows.select("category_id").distinct(), "category_id", "left_semi")
    ranked = M.rank(
        open_rows.select("listing_id", F.col("name").alias("title"), "brand", "model", "normalized_model",
                         "loose_normalized_model", "category_id", "category_name"),
        near, cat.offers, k=1, min_score=V.REVIEW_SCORE,
    ).select("listing_id", F.col("product_id").alias("best_id"), "score")
    contends = c("plan.product_id").isNull()
    planned = stored(settled_rows.join(ranked, "listing_id", "left").withColumns({
        "forced": c("plan").isNotNull(), "matched": F.coalesce(c("score") >= V.AUTO_MATCH_SCORE, F.lit(False)),
        "identity": new_product_id(c("category_id"), c("fingerprint")),
    }).withColumn("node", F.when(contends, F.sha1(F.to_json(F.struct("identity", "name", "forced"))))))
    release(known)
    return _plan_batch(planned, compare_new)


def _by_rank(score: Column, product: Column) -> Column:
    """The plan that follows from the best score."""
    text, confidence = score.cast("string"), F.round(score / 100.0, 3)
    nothing = F.lit(None).cast("string")
    return (
        F.when(score >= V.AUTO_MATCH_SCORE, _plan("auto_matched", confidence, "candidate_rank", F.concat(F.lit(V.RATIONALE_AUTO), text), product))
        .when(score >= V.REVIEW_SCORE, _plan("needs_review", confidence, "candidate_rank", F.concat(F.lit(V.RATIONALE_QUEUED), text), nothing))
        .otherwise(_plan("auto_matched", 1.0, "fingerprint", V.RATIONALE_NEW, nothing))
    )


TEXTS = ("name", "brand", "model", "normalized_model", "loose_normalized_model", "attributes", "category_name")


def _as_listings(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("node").alias("listing_id"), F.col("name").alias("title"), *[t for t in TEXTS if t not in ("name", "attributes")], "category_id", "place")


def _as_products(nodes: DataFrame) -> DataFrame:
    """The products that the texts would create."""
    model_key = X.first_text(F.col("loose_normalized_model"), F.col("normalized_model"), F.col("model"))
    return nodes.select(F.col("node").alias("id"), F.col("name").alias("canonical_name"), "category_id", "brand", model_key.alias("model_key"),
                        "attributes", "fingerprint", F.lit(True).alias("is_active"), "place")


def _batch_matches(nodes: DataFrame, compare_new: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Who creates a product, which creators each text is close enough to match, and the best score of each creator among earlier ones.

    Equal texts are one node, the first of them: a later one either finds its product or matches what the first one matches.
    """
    c = F.col
    no_offers = nodes.sparkSession.createDataFrame([], "product_id string")
    place = nodes.select(c("node").alias("product_id"), c("place").alias("product_place"))
    links = nodes.sparkSession.createDataFrame([], "node string, earlier string, score double")
    scores = nodes.sparkSession.createDataFrame([], "node string, batch_score double")
    if not compare_new:  # the first text of an identity creates its product
        first = nodes.filter("forced or not matched").groupBy("identity").agg(F.min("place").alias("_first"))
        nodes = nodes.join(first, "identity", "left").withColumn("creates", F.coalesce(c("place") == c("_first"), F.lit(False))).drop("_first")
        links = links.withColumn("product_place", F.lit(None).cast("long"))
    elif nodes.limit(2).count() > 1:
        able = nodes.filter("forced or not matched")
        links = cut(M.rank(_as_listings(nodes.filter("not forced")).drop("place"), _as_products(able), no_offers, k=None, min_score=V.AUTO_MATCH_SCORE).join(
            place, "product_id").select(c("listing_id").alias("node"), c("product_id").alias("earlier"), "score", "product_place"))
        before = links.join(nodes.select("node", "place"), "node").filter("product_place < place")
        creators = elect(able.select("node", "place", "identity", "forced"), before).filter("creates").select("node")
        nodes = cut(nodes.join(creators.withColumn("creates", F.lit(True)), "node", "left").fillna({"creates": False}))
        leaders = nodes.filter("creates")
        if leaders.limit(2).count() > 1:
            scores = M.rank(_as_listings(leaders.filter("not forced")), _as_products(leaders), no_offers, k=1, min_score=V.REVIEW_SCORE).select(
                c("listing_id").alias("node"), c("score").alias("batch_score"))
        links = links.join(leaders.select(c("node").alias("earlier")), "earlier", "left_semi")
    else:
        nodes = nodes.withColumn("creates", c("forced") | ~c("matched"))
        links = links.withColumn("product_place", F.lit(None).cast("long"))
    return nodes, links, scores


def _nearest(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per node ``near``: the products of the batch that one of its listings may be matched with, best first.

    Best is the highest score, then as products of the catalog tie. A product is left out where a better one was created
    before it, or before the node's first listing, so that a listing takes the first one created before itself.
    """
    c = F.col
    made = nodes.select(c("node").alias("earlier"), c("at").alias("made_at"), c("identity").alias("made_id"), F.lower("name").alias("made_name"))
    best_first = [c("score").desc(), c("made_name").desc_nulls_last(), c("product_place").asc()]
    better = W.partitionBy("node").orderBy(*best_first).rowsBetween(W.unboundedPreceding, -1)
    seen = links.join(made, "earlier").join(nodes.select("node", "place"), "node").withColumn("_least", F.min("product_place").over(better))
    useful = seen.filter(c("_least").isNull() | ((c("product_place") < c("_least")) & (c("_least") >= c("place"))))
    entry = F.struct((-c("score")).alias("_by"), (-c("product_place")).alias("_then"), "score", "made_at", "made_id")
    return useful.groupBy("node").agg(F.sort_array(F.collect_list(entry)).alias("near"))


def _plan_batch(planned: DataFrame, compare_new: bool) -> DataFrame:
    """Plans of the listings that no product of the catalog settles, each as if the earlier ones of the batch were stored.

    Texts are numbered in the order of their first listings. Listings are not: they are held against the listing that
    created a product by the order itself.
    """
    c = F.col
    spent = ("forced", "matched", "identity", "node")
    done = planned.filter(c("node").isNull()).withColumn("product_id", c("plan.product_id")).withColumn("creates", F.lit(False)).drop(*spent)
    rows = planned.filter(c("node").isNotNull()).withColumn("at", F.struct("seq", "url"))
    first = rows.groupBy("node").agg(F.min("at").alias("at"), F.min_by(F.struct(*TEXTS, "category_id", "fingerprint", "identity", "forced", "matched"), "at").alias("n"))
    texts = numbered(first.select("node", "at", "n.*"), [c("at.seq").asc(), c("at.url").asc()], "place")
    nodes, links, scores = _batch_matches(texts, compare_new)
    nodes = stored(nodes)
    creators = nodes.filter("creates").select("identity", c("at").alias("creator"))
    joined = rows.join(creators, "identity", "left").join(_nearest(links, nodes).join(scores, "node", "full"), "node", "left")
    joined = joined.withColumn("best", F.get(F.filter("near", lambda made: made["made_at"] < c("at")), F.lit(0)))
    later = F.coalesce(c("creator") < c("at"), F.lit(False))
    in_batch = F.coalesce(c("best.score"), c("batch_score"))
    better = in_batch.isNotNull() & (c("score").isNull() | (in_batch > c("score")))
    exact = _plan("auto_matched", 1.0, "fingerprint", V.RATIONALE_EXACT, c("identity"))
    ranked = _by_rank(F.when(better, in_batch).otherwise(c("score")), F.when(better, c("best.made_id")).otherwise(c("best_id").cast("string")))
    decided = joined.withColumn("creates", F.coalesce(c("creator") == c("at"), F.lit(False))).withColumn(
        "plan", F.when(c("forced"), c("plan")).when(later, exact).otherwise(ranked))
    decided = decided.withColumn("product_id", F.coalesce(c("plan.product_id"), c("identity")))
    conflict = F.coalesce((c("plan.decision") == "manual_matched") & (c("chosen_category_id") != c("category_id")), F.lit(False))
    return done.unionByName(decided.select(*done.columns)).withColumn("conflict", conflict)


def merge_listings(listings: DataFrame, rows: DataFrame, as_of: datetime) -> DataFrame:
    now = P.timestamp(as_of)
    fresh = rows.select(
        "url", F.lit(True).alias("_new"),
        F.struct(
            "listing_id", "retailer_id", "category_id", "retailer_sku", F.col("name").alias("title"), "brand", "model",
            "normalized_model", "loose_normalized_model", "image_url", "raw_payload", "status",
        ).alias("n"),
    )
    joined = listings.join(fresh, listings.source_url == fresh.url, "full")
    replaced = ["retailer_id", "category_id", "retailer_sku", "title", "brand", "model", "normalized_model",
                "loose_normalized_model", "image_url", "raw_payload", "status"]
    newer = lambda name: F.when(F.col("_new"), F.col(f"n.{name}")).otherwise(F.col(name)).alias(name)
    out = {
        "id": F.coalesce("id", "n.listing_id").alias("id"),
        "source_url": F.coalesce("source_url", "url").alias("source_url"),
        "source_hash": F.coalesce("source_hash", X.short_hash(F.col("url"))).alias("source_hash"),
        "first_seen_at": F.coalesce("first_seen_at", now).alias("first_seen_at"),
        "last_seen_at": F.when(F.col("_new"), now).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        **{name: newer(name) for name in replaced},
    }
    return joined.select(*[out[c] for c in listings.columns])


def merge_products(products: DataFrame, rows: DataFrame, as_of: datetime) -> DataFrame:
    """Create or enrich: the longest name wins, a missing brand and empty attributes are filled.

    Rows are reduced per product with aggregates that combine map-side, so a hot product stays cheap.
    """
    c, now = F.col, P.timestamp(as_of)
    order = F.struct("seq", "url")
    filled = F.size("attributes") > 0
    # Longest name, earliest among equals: the minimum of (-length, order).
    gain = rows.groupBy("product_id").agg(
        F.min_by("name", F.struct(-F.length("name"), order)).alias("_name"),
        F.min_by("brand", F.when(c("brand").isNotNull(), order)).alias("_brand"),
        F.min_by("attributes", F.when(filled, order)).alias("_attributes"),
        F.min_by(
            F.struct("category_id", "category_name", "fingerprint",
                     X.first_text(c("loose_normalized_model"), c("normalized_model"), c("model")).alias("model_key")),
            order,
        ).alias("_first"),
    )
    joined = products.join(gain, products.id == gain.product_id, "full")
    old = c("id").isNotNull()
    longer = F.coalesce(F.length("_name") > F.length("canonical_name"), F.lit(False))
    no_brand = F.coalesce(c("brand"), F.lit("")) == ""
    no_attributes = F.coalesce(F.size("attributes"), F.lit(0)) <= 0
    changed = c("product_id").isNotNull() & (
        longer | (no_brand & c("_brand").isNotNull()) | (no_attributes & c("_attributes").isNotNull())
    )
    empty = F.create_map().cast("map<string,string>")
    out = {
        "id": F.coalesce("id", "product_id"),
        "canonical_name": F.when(~old | longer, c("_name")).otherwise(c("canonical_name")),
        "category_id": F.coalesce("category_id", "_first.category_id"),
        "brand": F.when(no_brand, F.coalesce("_brand", "brand")).otherwise(c("brand")),
        "model_key": F.when(old, c("model_key")).otherwise(c("_first.model_key")),
        "fingerprint": F.coalesce("fingerprint", "_first.fingerprint"),
        "attributes": F.when(no_attributes, F.coalesce("_attributes", "attributes", empty)).otherwise(c("attributes")),
        "match_bucket": F.when(old, c("match_bucket")).otherwise(X.match_bucket(c("_first.category_name"))),
        "is_active": F.coalesce("is_active", F.lit(True)),
        "created_at": F.coalesce("created_at", now),
        "updated_at": F.when(~old | changed, now).otherwise(c("updated_at")),
    }
    return joined.select(*[out[n].alias(n) for n in products.columns])


def merge_offers(offers: DataFrame, rows: DataFrame, as_of: datetime) -> DataFrame:
    """One offer per listing; the previous price is the price before the last snapshot, changed or not."""
    c, now = F.col, P.timestamp(as_of)
    fresh = rows.select(
        "listing_id", F.lit(True).alias("_new"),
        F.struct(
            "product_id", "retailer_id", "category_id", c("name").alias("listing_name"), c("url").alias("listing_url"),
            "image_url", c("price").alias("current_price"), "status",
            F.when(c("before").isNull(), c("previous_price")).otherwise(c("before.price")).alias("previous_price"),
            ((c("status") == "available") & (c("plan.decision") != "manual_rejected")).alias("is_active"),
        ).alias("n"),
    )
    joined = offers.join(fresh, "listing_id", "full")
    newer = lambda name: F.when(c("_new"), c(f"n.{name}")).otherwise(c(name))
    out = {
        "id": F.coalesce("id", "listing_id"),
        "listing_id": c("listing_id"),
        "currency": F.coalesce("currency", F.lit("AUD")),
        "first_seen_at": F.coalesce("first_seen_at", now),
        "last_seen_at": F.when(c("_new"), now).otherwise(c("last_seen_at")),
        **{n: newer(n) for n in ("product_id", "retailer_id", "category_id", "listing_name", "listing_url", "image_url",
                                 "current_price", "previous_price", "status", "is_active")},
    }
    return joined.select(*[out[n].alias(n) for n in offers.columns])


def merge_decisions(decisions: DataFrame, rows: DataFrame, as_of: datetime) -> DataFrame:
    """Refresh the latest decision where it still holds, append where it does not; manual decisions stay."""
    c = F.col
    stored = F.when(c("plan.decision") != "needs_review", c("product_id"))
    manual = F.coalesce(c("was_decision").isin(*MANUAL), F.lit(False))
    same = c("was_id").isNotNull() & (c("was_decision") == c("plan.decision")) & c("was_product_id").eqNullSafe(stored)
    action = F.when(manual, "touch").when(F.coalesce(same, F.lit(False)), "update").otherwise("append")
    tagged = rows.select(
        "listing_id", "was_id", "run_id", "fingerprint", action.alias("action"), stored.alias("stored_product"), "plan"
    )
    kept = tagged.filter(c("action") != "append").select(
        c("was_id").alias("id"), "action", c("run_id").alias("_run"), c("fingerprint").alias("_print"), c("plan").alias("_plan")
    )
    full = c("action") == "update"
    value = lambda n: F.when(full, c(f"_plan.{n}")).otherwise(c(n))
    refreshed = decisions.join(kept, "id", "left").withColumns(
        {
            "run_id": F.coalesce("_run", "run_id"), "fingerprint": F.coalesce("_print", "fingerprint"),
            "confidence": value("confidence"), "matcher": value("matcher"), "rationale": value("rationale"),
        }
    )
    added = tagged.filter(c("action") == "append").select(
        F.concat_ws("-", "run_id", "listing_id").alias("id"), "listing_id", c("stored_product").alias("product_id"), "run_id",
        "plan.decision", "plan.confidence", "plan.matcher", "plan.rationale", "fingerprint",
        P.timestamp(as_of).alias("created_at"),
    )
    return refreshed.select(*decisions.columns).unionByName(added.select(*decisions.columns))


def ingest_batch(
    cat: Catalog, snapshots: DataFrame, *, as_of: datetime, slices: int | None = None, compare_new: bool = True
) -> IngestResult:
    """Merge one batch of snapshots and return the next catalog."""
    c = F.col
    valid, rejected = _split(_checked_once(snapshots))
    fields = [f for f in valid.columns if f != "url"]
    latest = valid.groupBy("url").agg(F.max_by(F.struct(*fields), "seq").alias("s")).select("url", "s.*")
    # Joins on the fingerprint would push filters below the text expressions; computing them once here avoids that.
    with scratch():
        planned = settled(plan_matches(cat, stored(identify(latest)), compare_new), stored)
    conflicts = planned.filter("conflict").select("url", "listing_id", "product_id", "category_id", "chosen_category_id")
    rows = planned.filter(~c("conflict"))

    offer = cat.offers.select("listing_id", c("id").alias("offer_id"), c("status").alias("prior_status"),
                              c("current_price").alias("prior_price"))
    observed = S.latest_observation(cat.observations).select("offer_id", c("price").alias("prior_observed"))
    keyed = rows.select("url", "listing_id", "creates", c("old_listing_id").isNull().alias("new_listing")).join(offer, "listing_id", "left").join(observed, "offer_id", "left")
    carry = ["listing_id", "offer_id", "creates", "new_listing"]
    prior = keyed.select(c("url").alias("key"), "prior_status", "prior_price", "prior_observed", *carry)
    history = valid.withColumn("key", c("url"))
    followed = stored(changes.follow(history, prior, slices=slices, carry=carry).withColumn("observation_created", changes.is_change()))

    rows = rows.filter(c("url").isNotNull())
    # plain values, so that they are reduced by hash
    last_before = followed.groupBy("url").agg(F.max_by(c("before").isNull(), "seq").alias("_fresh"), F.max_by("before.price", "seq").alias("_price"))
    offered = rows.join(last_before, "url").withColumn("before", F.when(~c("_fresh"), F.struct(c("_price").alias("price"))))
    fresh = followed.filter("observation_created").select(
        F.concat_ws("-", F.lpad(c("seq").cast("string"), 20, "0"), "run_id", F.coalesce("offer_id", "listing_id")).alias("id"),
        F.coalesce("offer_id", "listing_id").alias("offer_id"), P.timestamp(as_of).alias("observed_at"), "price",
        c("before.price").alias("previous_price"), (c("status") == "available").alias("in_stock"), "run_id", "raw_payload",
    ).select(*cat.observations.columns)
    results = followed.select(
        "run_id", "retailer_id", "url", "seq",
        (c("is_first") & c("new_listing")).alias("listing_created"),
        (c("is_first") & c("offer_id").isNull()).alias("offer_created"),
        "observation_created",
        (c("is_first") & c("creates")).alias("product_created"),
    )
    updated = cat.with_tables(
        listings=merge_listings(cat.listings, rows, as_of),
        products=merge_products(cat.products, rows, as_of),
        offers=merge_offers(cat.offers, offered, as_of),
        observations=cat.observations.unionByName(fresh),
        decisions=merge_decisions(cat.decisions, rows, as_of),
    )
    return IngestResult(updated, results, rejected, conflicts, fresh)


def c_is(column: str, value: str) -> Column:
    return F.coalesce(F.col(column) == value, F.lit(False))


def missing_listings(cat: Catalog, seen: DataFrame, retailers: DataFrame) -> DataFrame:
    """Listings of the given retailers that were not seen and are not yet unavailable."""
    return (
        cat.listings.filter(~c_is("status", "unavailable"))
        .join(retailers.select("retailer_id").distinct(), "retailer_id", "left_semi")
        .join(seen.select("retailer_id", F.col("url").alias("source_url")), ["retailer_id", "source_url"], "left_anti")
    )


def mark_missing(
    cat: Catalog, seen: DataFrame, retailers: DataFrame, *, run_id: str, as_of: datetime
) -> tuple[Catalog, DataFrame, DataFrame]:
    """Set unseen listings and their offers unavailable; priced offers get an out-of-stock observation.

    ``seen`` holds every URL met, rejected ones included. ``retailers`` is the scope: pass only the retailers
    (or filter ``seen`` and the catalog to the categories) whose crawl completed. Returns the next catalog, the
    marked listing ids and the new observations.
    """
    c, now = F.col, P.timestamp(as_of)
    gone = missing_listings(cat, seen, retailers).select(c("id").alias("listing_id"), F.lit(True).alias("_gone"))
    listings = cat.listings.join(gone.withColumnRenamed("listing_id", "id"), "id", "left").withColumns(
        {"status": F.when(c("_gone"), "unavailable").otherwise(c("status")),
         "last_seen_at": F.when(c("_gone"), now).otherwise(c("last_seen_at"))}
    ).select(*cat.listings.columns)
    hit = F.coalesce(c("_gone"), F.lit(False)) & ~(c_is("status", "unavailable") & ~F.coalesce("is_active", F.lit(False)))
    tagged = cat.offers.join(gone, "listing_id", "left").withColumn("_hit", hit)
    fresh = tagged.filter(c("_hit") & c("current_price").isNotNull()).select(
        F.concat_ws("-", F.lit("~"), F.lit(run_id), "id").alias("id"), c("id").alias("offer_id"), now.alias("observed_at"),
        c("current_price").alias("price"), "previous_price", F.lit(False).alias("in_stock"), F.lit(run_id).alias("run_id"),
        F.lit('{"unavailable_marked": true}').alias("raw_payload"),
    ).select(*cat.observations.columns)
    offers = tagged.withColumns(
        {"status": F.when(c("_hit"), "unavailable").otherwise(c("status")),
         "is_active": F.when(c("_hit"), False).otherwise(c("is_active")),
         "last_seen_at": F.when(c("_hit"), now).otherwise(c("last_seen_at"))}
    ).select(*cat.offers.columns)
    updated = cat.with_tables(listings=listings, offers=offers, observations=cat.observations.unionByName(fresh))
    return updated, gone.select("listing_id"), fresh


def category_conflicts(offers: DataFrame, products: DataFrame) -> DataFrame:
    """Offers whose category does not mirror their product's."""
    owner = products.select(F.col("id").alias("product_id"), F.col("category_id").alias("product_category_id"))
    return offers.join(owner, "product_id").filter(
        ~F.col("category_id").eqNullSafe(F.col("product_category_id"))
    ).select("id", "product_id", "category_id", "product_category_id")
