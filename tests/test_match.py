"""Similarity, candidate ranking and review resolution."""

from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pricetide import fixed_values as V
from pricetide.functions.block_bounds import Summaries, highest_scores, summary
from pricetide.functions.pair_scores import Side, best_matches
from pricetide.functions.similarity import common_subsequence, token_set_ratio, tokens
from pricetide.operators import ingest
from pricetide.operators import match as M
from pricetide.plans import review
from workload import adapter
from workload import job_queries  # noqa: F401
from workload.registry import QUERIES


def ratio(a, b):
    return token_set_ratio(tokens(a), tokens(b))


def test_token_set_ratio_cases():
    assert ratio("ASUS RTX 4070", "asus rtx-4070 super") == 100
    assert ratio("rtx5070", "rtx5080") == 86
    assert ratio("", "x") == 0
    assert ratio("abc", "xyz") == 0


def slow_lcs(a, b):
    prev = [0] * (len(b) + 1)
    for ch in a:
        cur = [0]
        for j, other in enumerate(b, 1):
            cur.append(prev[j - 1] + 1 if ch == other else max(prev[j], cur[-1]))
        prev = cur
    return prev[-1]


def test_common_subsequence_against_table_method():
    rng = random.Random(5)
    for _ in range(500):
        a, b = ("".join(rng.choices("abcd 12", k=rng.randint(0, 30))) for _ in range(2))
        assert common_subsequence(a, b) == slow_lcs(a, b)


WORDS = "asus msi geforce rtx gtx 4070 5070 5070ti 5080 super ti oc 12gb 16gb dual prime gaming 8gb".split()


def brute_score(l, p):
    m, n = ratio(l["model"], p["model"]), ratio(l["name"], p["name"])
    brand = 55.0 if not l["brand"] or not p["brand"] else (100.0 if l["brand"] == p["brand"] else 15.0)
    la, pa = dict(x.split("=") for x in l["attrs"]), dict(x.split("=") for x in p["attrs"])
    shared = set(la) & set(pa)
    attr = sum(la[k] == pa[k] for k in shared) / len(shared) * 100.0 if shared else 50.0
    bonus = 18.0 if l["print"] and l["print"] == p["print"] else 0.0
    return round(min(100.0, m * 0.45 + n * 0.30 + brand * 0.15 + attr * 0.10 + bonus), 1)


def random_rows(rng, n):
    rows = []
    for i in range(n):
        words = rng.choices(WORDS, k=rng.randint(1, 7))
        attrs = [f"{k}={rng.choice('ab')}" for k in rng.sample(["series", "vram_gb", "size"], rng.randint(0, 3))]
        rows.append(dict(
            id=f"{i:04d}", name=" ".join(words), model=" ".join(words[1:]), brand=rng.choice(["asus", "msi", ""]),
            attrs=attrs, print=rng.choice(["", "p1", "p2", "p3"]),
        ))
    return rows


@pytest.mark.parametrize("k,floor", [(1, 0.0), (4, 0.0), (2, 75.0), (3, 96.0)])
def test_block_scoring_equals_brute_force(k, floor):
    rng = random.Random(k)
    left, right = random_rows(rng, 60), random_rows(rng, 90)
    side = lambda rows: Side.of(*[[r[c] for r in rows] for c in ("id", "name", "model", "brand", "attrs", "print")])
    tie = list(range(len(right)))
    got = {}
    for lid, rid, score, *_ in best_matches(side(left), side(right), tie, k, [floor] * len(left)):
        got.setdefault(lid, []).append((rid, score))
    for l in left:
        scored = sorted(((-brute_score(l, p), t, p["id"]) for t, p in enumerate(right)))
        want = [(rid, -s) for s, _, rid in scored[:k] if -s >= floor]
        assert got.get(l["id"], []) == want


def test_no_product_of_a_block_passes_its_bound():
    rng = random.Random(8)
    left, right = random_rows(rng, 80), random_rows(rng, 200) + [dict(id="e", name="", model="!", brand="", attrs=[], print="")]
    side = Side.of(*[[r[c] for r in left] for c in ("id", "name", "model", "brand", "attrs", "print")])
    blocks = [right[i : i + n] for n in (1, 2, 7, 50) for i in range(0, len(right), n)]
    bounds = highest_scores(side, Summaries.of([summary(b) for b in blocks]))
    for i, l in enumerate(left):
        for j, block in enumerate(blocks):
            assert bounds[i, j] + 0.05 >= max(brute_score(l, p) for p in block), (l, block)
    near = sum(b < max(bounds[i]) - 10 for i in range(len(left)) for b in bounds[i])
    assert near > 0.3 * bounds.size  # and the bounds tell blocks apart


def family_catalog(spark, families):
    """Products in families of thirty variants, and four listings a family."""
    rng = random.Random(2)
    products, listings = [], []
    for f in range(families):
        line = f"{rng.choice('BCDFGKLMNPRSTVZ')}{''.join(rng.choices('abcdefghijklmnopqrstuvwxyz', k=7))} {rng.choice('QXZKW')}{rng.randrange(10, 99)}"
        brand = rng.choice(["ASUS", "MSI", "Gigabyte", "Corsair"])
        for v in range(30):
            name = f"{brand} {line} v{v}"
            products.append((f"{f:04d}-{v:02d}", name, 1, brand, f"{line} v{v}".lower(), f"f{f}-{v}", True))
        for v in range(4):
            name = f"{brand} {line} v{v * 7} new"
            listings.append((f"L{f}-{v}", name, brand, f"{line} v{v * 7} new", None, f"{line} v{v * 7} new".lower(), 1, "Fans & Accessories"))
    rng.shuffle(products)
    rng.shuffle(listings)
    empty = F.create_map().cast("map<string,string>")
    return (spark.createDataFrame(listings, "listing_id string, title string, brand string, model string, normalized_model string, "
                                            "loose_normalized_model string, category_id long, category_name string"),
            spark.createDataFrame(products, "id string, canonical_name string, category_id long, brand string, model_key string, "
                                            "fingerprint string, is_active boolean").withColumn("attributes", empty),
            spark.createDataFrame([], "id string, product_id string"))


def test_block_pairs_grow_with_the_category_not_its_square(spark, monkeypatch):
    monkeypatch.setattr(M, "PROBE_BLOCK", 4)
    monkeypatch.setattr(M, "PRODUCT_BLOCK", 30)
    formed, original = [], M.block_pairs

    def counted(probe_side, index):
        pairs = original(probe_side, index)
        formed.append((pairs.count(), probe_side.count() * index.select(F.explode("blocks")).count()))
        return pairs

    monkeypatch.setattr(M, "block_pairs", counted)
    for families in (20, 80):
        assert M.rank(*family_catalog(spark, families), k=8).count() == 4 * families * 8
    (few, _), (many, possible) = formed
    assert many <= 7 * few and many < possible / 8, formed


def brute_rank(listing, products, offers, k):
    counts = {}
    for o in offers:
        counts[o["product_id"]] = counts.get(o["product_id"], 0) + 1
    scored = []
    for p in products:
        if not p["is_active"] or (listing["category_id"] is not None and p["category_id"] != listing["category_id"]):
            continue
        row = dict(name=p["canonical_name"], model=p["model_key"] or p["canonical_name"], brand=(p["brand"] or "").lower(),
                   attrs=[f"{a}={b}" for a, b in (p["attributes"] or {}).items()], print=p["fingerprint"])
        scored.append((brute_score(listing, row), counts.get(p["id"], 0), p["canonical_name"].lower(), p["id"]))
    scored.sort(key=lambda s: s[3])
    scored.sort(key=lambda s: s[:3], reverse=True)
    return [(s[3], s[0]) for s in scored[:k]]


@pytest.mark.parametrize("k,blocks", [(1, (8, 16)), (3, (8, 16)), (8, (256, 512))])
def test_rank_equals_brute_force(spark, monkeypatch, k, blocks):
    monkeypatch.setattr(M, "PROBE_BLOCK", blocks[0])
    monkeypatch.setattr(M, "PRODUCT_BLOCK", blocks[1])
    rng = random.Random(11)
    products = [
        dict(id=f"{i:03d}", canonical_name=" ".join(rng.choices(WORDS, k=rng.randint(2, 6))), category_id=rng.choice([1, 2]),
             brand=rng.choice(["ASUS", "MSI", None]), model_key=" ".join(rng.choices(WORDS, k=3)) if rng.random() < 0.8 else None,
             fingerprint=f"f{i}", attributes={"series": "RTX", "vram_gb": rng.choice(["8", "12", "16"])}, is_active=rng.random() < 0.9)
        for i in range(120)
    ]
    offers = [dict(id=str(i), product_id=rng.choice(products)["id"]) for i in range(200)]
    listings = []
    for i in range(60):
        name = " ".join(rng.choices(WORDS, k=rng.randint(2, 6)))
        cat = rng.choice([1, 2, None])
        listings.append(dict(listing_id=f"L{i}", title=name, brand=rng.choice(["ASUS", "MSI"]), model=name,
                             normalized_model=name, loose_normalized_model=name.replace("oc", ""), category_id=cat,
                             category_name={1: "Graphics Cards", 2: "Fans & Accessories", None: None}[cat]))
    # Half of the listings get a product whose fingerprint they reproduce.
    ldf = spark.createDataFrame(listings, "listing_id string, title string, brand string, model string, normalized_model string, "
                                          "loose_normalized_model string, category_id long, category_name string")
    shown = {r.listing_id: r for r in M.probes(ldf).collect()}
    for l in listings[::4]:
        p = rng.choice(products)
        if shown[l["listing_id"]].p_print:
            p.update(fingerprint=shown[l["listing_id"]].p_print, category_id=l["category_id"])
            if rng.random() < 0.5:
                p.update(canonical_name=l["title"], brand=l["brand"], model_key=shown[l["listing_id"]].p_model)
    pdf = spark.createDataFrame(products, "id string, canonical_name string, category_id long, brand string, model_key string, "
                                          "fingerprint string, attributes map<string,string>, is_active boolean")
    odf = spark.createDataFrame(offers, "id string, product_id string")
    got = {}
    for r in M.rank(ldf, pdf, odf, k=k).orderBy("listing_id", "position").collect():
        got.setdefault(r.listing_id, []).append((r.product_id, r.score))
    for l in listings:
        s = shown[l["listing_id"]]
        row = dict(category_id=l["category_id"], name=s.p_name, model=s.p_model, brand=s.p_brand,
                   attrs=[f"{a}={b}" for a, b in s.p_attributes.items()], print=s.p_print or "")
        assert got.get(l["listing_id"], []) == brute_rank(row, products, offers, k), l


def test_candidates_of_seed_decision(spark, seed):
    rows = review.decision_candidates(seed).orderBy("position").collect()
    assert [r.product_id for r in rows] == ["gpu", "legacy"]
    assert rows[0].score > rows[1].score
    assert rows[0].best_price == 950.0 and rows[0].retailer_count == 2
    assert rows[0].reasons == [
        "Brand match: ASUS", "Matched attributes: series, vram gb", "Model similarity 100", "Name similarity 100",
    ]
    only = review.decision_candidates(seed, search="Legacy").collect()
    assert [r.product_id for r in only] == ["legacy"]


def test_pending_page_carries_top_candidate(seed):
    row = review.pending_with_top_candidate(seed, retailer_id=1).collect()
    assert len(row) == 1 and row[0].top_product_id == "gpu" and row[0].product_id is None


def resolutions(spark, *rows):
    return spark.createDataFrame(list(rows), "decision_id string, decision string, product_id string, rationale string, seq long")


def test_resolve_match_reject_and_guards(spark, seed):
    done, refused = review.resolve(seed, resolutions(spark, ("d1", "manual_matched", "gpu", None, 1)))
    d = done.decisions.collect()[0]
    assert (d.decision, d.product_id, d.matcher, d.confidence) == ("manual_matched", "gpu", "manual_review", 1.0)
    o = done.offers.filter("id = 'o1'").collect()[0]
    assert o.product_id == "gpu" and o.is_active and refused.count() == 0

    done, _ = review.resolve(seed, resolutions(spark, ("d1", "manual_rejected", None, "no", 1)))
    d = done.decisions.collect()[0]
    assert (d.decision, d.product_id, d.rationale) == ("manual_rejected", None, "no")
    assert not done.offers.filter("id = 'o1'").collect()[0].is_active

    _, refused = review.resolve(seed, resolutions(
        spark, ("d1", "manual_matched", "cpu", None, 1), ("zz", "manual_rejected", None, None, 2),
        ("d1", "manual_matched", None, None, 3), ("d1", "auto_matched", "gpu", None, 4), ("d1", "manual_matched", "none", None, 5)))
    assert {r.seq: r.problem for r in refused.collect()} == {
        1: "category_mismatch", 2: "decision_not_found", 3: "product_required", 4: "unsupported_decision", 5: "product_not_found"}


def test_bulk_apply(spark, seed):
    ids = spark.createDataFrame([("d1",)], "id string")
    done, outcomes = review.bulk_apply(seed, ids)
    assert [(r.decision_id, r.outcome) for r in outcomes.collect()] == [("d1", "resolved")]
    assert done.decisions.collect()[0].rationale == V.RATIONALE_BULK + "ASUS RTX 4070 SUPER 12GB"
    _, outcomes = review.bulk_apply(seed, ids, min_score=101)
    assert outcomes.collect()[0].outcome == "below_min_score"
    done, outcomes = review.bulk_apply(seed, spark.createDataFrame([("d1",), ("nope",)], "id string"))
    assert {r.decision_id: r.outcome for r in outcomes.collect()} == {"d1": "resolved", "nope": "decision_not_found"}
    assert done.decisions.collect()[0].decision == "needs_review"


@pytest.fixture
def small_tables(spark, tmp_path):
    """Driver tables of 40 parts, each sold by two suppliers, with an order a line."""
    day = datetime(1998, 1, 1)
    lines = [(n, n % 40 + 1, n // 40 + 1, 1, 2.0, 20.0 + n, 0.0, 0.1, "N", "O", day) for n in range(80)]
    kinds = ["1-URGENT", "2-HIGH", "5-LOW", "3-MEDIUM"]
    rows = {
        "lineitem": lines, "part": [(n, f"p{n}", "b", "PROMO", 5, 1.0) for n in range(1, 41)],
        "supplier": [(n, f"s{n}", 1, 1.0) for n in (1, 2)],
        "orders": [(n, 1, "O", 1.0, day, kinds[n % 4]) for n in range(80)],
    }
    for name, found in rows.items():
        spark.createDataFrame(found, adapter.TEST_TABLES[name]).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["review_candidates", "bulk_accept_outcomes"])
def test_texts_are_worked_out_for_asked_listings_only(spark, monkeypatch, small_tables, name):
    identify = ingest.identify

    def strict(rows):
        if "offer_id" in rows.columns:
            asked = (F.col("offer_id") / adapter.OFFER_KEY).cast("long") % 4 == 1  # line n of part n % 40 + 1 is urgent for n % 4 = 0
            rows = rows.withColumn("name", F.when(asked, F.col("name")).otherwise(F.raise_error(F.lit("not asked for"))))
        return identify(rows)

    monkeypatch.setattr(ingest, "identify", strict)
    rows = QUERIES[name](spark, small_tables).collect()
    asked = {r.decision_id for r in rows if name != "bulk_accept_outcomes" or r.outcome != "decision_not_pending_review"}
    assert asked and asked <= set(range(0, 80, 4))
    assert len(rows) == 80 or name != "bulk_accept_outcomes"
