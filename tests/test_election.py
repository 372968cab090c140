"""New products of a batch against an item-by-item reading."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from conftest import NOW, table
from pricetide import fixed_values as V
from pricetide import schemas
from pricetide.operators import ingest
from pricetide.operators.election import elect
from test_match import brute_rank


@pytest.mark.parametrize("seed", [1, 2])
def test_election_equals_reading_in_order(spark, seed):
    rng = random.Random(seed)
    nodes = [(f"n{i}", i * 3, f"p{rng.randrange(60)}", rng.random() < 0.1) for i in range(120)]
    links = [(nodes[j][0], nodes[i][0]) for j in range(120) for i in range(max(0, j - 25), j) if rng.random() < 0.12]
    links += [(nodes[j][0], nodes[j - 1][0]) for j in range(60, 72)]  # a chain
    created, taken = set(), set()
    for node, _, identity, forced in nodes:
        near = any(a == node and b in created for a, b in links)
        if identity not in taken and (forced or not near):
            created.add(node)
            taken.add(identity)
    found = elect(spark.createDataFrame(nodes, "node string, place long, identity string, forced boolean"),
                  spark.createDataFrame(links, "node string, earlier string"))
    assert {r.node for r in found.filter("creates").collect()} == created and found.count() == 120
    none = spark.createDataFrame([], "node string, earlier string")
    assert elect(spark.createDataFrame(nodes[:0], "node string, place long, identity string, forced boolean"), none).count() == 0


def read_in_order(rows, products, offers, decided):
    """Decision, confidence, rationale and product of each row, one after the other."""
    products, out = [dict(p) for p in products], {}
    by_print = {p["fingerprint"]: p["id"] for p in products}
    for r in sorted(rows, key=lambda r: (r["seq"], r["url"])):
        made = f"{r['category_id']}-{r['fingerprint']}"
        exact = by_print.get(r["fingerprint"])
        listing = dict(category_id=r["category_id"], name=r["name"], brand=(r["brand"] or "").lower(), print=r["fingerprint"],
                       model=r["loose_normalized_model"] or r["normalized_model"] or r["model"], attrs=[f"{a}={b}" for a, b in r["attributes"].items()])
        best = brute_rank(listing, products, offers, 1)
        best_id, score = best[0] if best else (None, 0.0)
        if r["url"] in decided:
            plan = ("needs_review", 0.8, "kept", exact)
        elif exact:
            plan = ("auto_matched", 1.0, V.RATIONALE_EXACT, exact)
        elif score >= V.AUTO_MATCH_SCORE:
            plan = ("auto_matched", round(score / 100, 3), f"{V.RATIONALE_AUTO}{score}", best_id)
        elif score >= V.REVIEW_SCORE:
            plan = ("needs_review", round(score / 100, 3), f"{V.RATIONALE_QUEUED}{score}", None)
        else:
            plan = ("auto_matched", 1.0, V.RATIONALE_NEW, None)
        if plan[3] is None:
            by_print[r["fingerprint"]] = made
            products.append(dict(id=made, canonical_name=r["name"], category_id=r["category_id"], brand=r["brand"], attributes=r["attributes"], is_active=True,
                                 model_key=r["loose_normalized_model"] or r["normalized_model"] or r["model"], fingerprint=r["fingerprint"]))
        out[r["url"]] = (*plan[:3], plan[3] or made, plan[3] is None)
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_batch_equals_reading_in_order(spark, seed):
    rng = random.Random(seed)
    brands, lines = ["ASUS", "MSI", "Gigabyte"], ["GeForce RTX 5070", "GeForce RTX 5070 Ti", "Radeon RX 9070"]
    name = lambda: " ".join([rng.choice(brands), rng.choice(lines), *rng.sample(["OC", "Dual", "Prime", "Solid", "Shadow", "v2"], rng.randrange(3)), rng.choice(["12GB", "16GB"])])
    names = [name() for _ in range(25)]
    snaps = [dict(name=rng.choice(names) if rng.random() < 0.7 else name(), url=f"https://r1/{i:03d}", price=10.0 + i, status="available", retailer_id=1, category_id=rng.choice([1, 1, 1, 2]),
                  category_name="Graphics Cards", seq=rng.randrange(40), run_id="run") for i in range(70)]
    frame = spark.createDataFrame([[r.get(f.name) for f in schemas.SNAPSHOTS] for r in snaps], schemas.SNAPSHOTS)
    products = [dict(id=f"c{i}", canonical_name=n, category_id=1, brand=n.split()[0], model_key=n.split(" ", 1)[1].lower(), fingerprint=f"old-{i}",
                     attributes={"series": "RTX"}, is_active=i != 2) for i, n in enumerate(rng.sample(names, 4))]
    offers = [dict(id=f"o{i}", listing_id=f"x{i}", product_id=f"c{i}", retailer_id=1, category_id=1, listing_name="x", listing_url="x", currency="AUD", status="available",
                   is_active=True, first_seen_at=NOW, last_seen_at=NOW) for i in range(4)]
    cat = schemas.empty_catalog(spark)
    listing = cat.listings.sparkSession.createDataFrame([("https://r1/005",), ("https://r1/040",)], "url string")
    from pricetide.functions import text as X

    known = [r[0] for r in listing.select(X.short_hash(F.col("url"))).collect()]
    cat = cat.with_tables(
        products=table(spark, "products", products), offers=table(spark, "offers", offers),
        categories=table(spark, "categories", [dict(id=1, name="Graphics Cards"), dict(id=2, name="Graphics Cards")]),
        decisions=table(spark, "decisions", [dict(id=f"d{i}", listing_id=k, decision="needs_review", confidence=0.8, matcher="candidate_rank",
                                                  rationale="kept", fingerprint="f", created_at=NOW) for i, k in enumerate(known)]))
    latest = ingest.identify(frame)
    expected = read_in_order([r.asDict() for r in latest.collect()], products, offers, {"https://r1/005", "https://r1/040"})
    planned = ingest.plan_matches(cat, latest).collect()
    got = {r.url: (r.plan.decision, r.plan.confidence, r.plan.rationale, r.product_id, r.creates) for r in planned}
    assert got == expected
    kinds = {(v[0], v[2].split(" score")[0]) for v in expected.values()}
    assert len(kinds) >= 4 and sum(v[4] for v in expected.values()) < len({r["fingerprint"] for r in (x.asDict() for x in latest.collect())})
