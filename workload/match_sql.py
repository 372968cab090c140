"""Candidate ranking in SQL: every listing text against every product text of its category, by the definition of the score."""

from __future__ import annotations

from pricetide import fixed_values as V
from workload.adapter_sql import listing_title, pick, product_title
from workload.adapter import TITLE_CATEGORIES
from workload.text_queries import ALL_KEYS, IDENTITY_CTES

_category = pick(TITLE_CATEGORIES, "{k} % 9")
_weight = lambda w: f"{w}::DOUBLE"
_attributes = ", ".join(f"a_{k}" for k in ALL_KEYS)
_shared = " + ".join(f"CAST(l.a_{k} IS NOT NULL AND p.a_{k} IS NOT NULL AS INTEGER)" for k in ALL_KEYS)
_same = " + ".join(f"CAST(coalesce(l.a_{k} = p.a_{k}, false) AS INTEGER)" for k in ALL_KEYS)
_matched = ", ".join(f"CASE WHEN l.a_{k} = p.a_{k} THEN '{k.replace('_', ' ')}' END" for k in ALL_KEYS)
_ratio = "CASE WHEN {total} > 0 THEN 100 - 100 * ({distance})::DOUBLE / ({total}) ELSE 100.0::DOUBLE END"

MATCH_CTES = {
    **IDENTITY_CTES,
    # titles of listings, and of products under negative ids
    "titles": f"""SELECT offer_id, l_partkey, l_suppkey, CAST(l_partkey % 9 + 1 AS BIGINT) AS category_id, {_category.format(k='l_partkey')} AS category_name,
        {listing_title('l_partkey', 'l_suppkey')} AS title
      FROM (SELECT DISTINCT offer_id, l_partkey, l_suppkey FROM li WHERE offer_id IN (SELECT listing_id FROM decisions WHERE decision = 'needs_review'))
      UNION ALL SELECT -p_partkey, p_partkey, -1, CAST(p_partkey % 9 + 1 AS BIGINT), {_category.format(k='p_partkey')}, {product_title('p_partkey')} FROM part""",
    "sided": "SELECT *, coalesce(nullif(loose, ''), nullif(strict, ''), nullif(model, '')) AS model_text FROM printed",
    "asked": f"""SELECT offer_id AS listing_id, CASE WHEN l_suppkey % 10 <> 7 THEN category_id END AS category_id, title AS name, lower(coalesce(brand, '')) AS brand,
        coalesce(model_text, title) AS model, CASE WHEN l_suppkey % 10 <> 7 THEN fingerprint END AS fingerprint,
        {', '.join(f"CASE WHEN l_suppkey % 10 <> 7 THEN a_{k} END AS a_{k}" for k in ALL_KEYS)} FROM sided WHERE offer_id >= 0""",
    "known": f"""SELECT -offer_id AS product_id, category_id, category_name, title AS name, brand AS shown_brand, lower(coalesce(brand, '')) AS brand,
        coalesce(model_text, title) AS model, fingerprint, {_attributes} FROM sided WHERE offer_id < 0 AND l_partkey % 20 <> 0""",
    "wanted": """SELECT l.name AS a, p.name AS b FROM (SELECT DISTINCT name, category_id FROM asked) l JOIN (SELECT DISTINCT name, category_id FROM known) p
        ON l.category_id IS NULL OR l.category_id = p.category_id
      UNION SELECT l.model, p.model FROM (SELECT DISTINCT model, category_id FROM asked) l JOIN (SELECT DISTINCT model, category_id FROM known) p
        ON l.category_id IS NULL OR l.category_id = p.category_id""",
    "words": r"""SELECT t, list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(t), '[^a-z0-9_]', ' ', 'g'), ' '), lambda w: w <> ''))) AS w
      FROM (SELECT a AS t FROM wanted UNION SELECT b FROM wanted)""",
    "common": """SELECT a, b, x.w AS wa, y.w AS wb, list_filter(x.w, lambda t: list_contains(y.w, t)) AS both_w,
        array_to_string(list_filter(x.w, lambda t: NOT list_contains(y.w, t)), ' ') AS only_a,
        array_to_string(list_filter(y.w, lambda t: NOT list_contains(x.w, t)), ' ') AS only_b
      FROM wanted JOIN words x ON x.t = a JOIN words y ON y.t = b""",
    # one bit for each place of a character, for the longest common subsequence
    "masks": """SELECT only_a, map_from_entries(list_transform(list_distinct(string_split(only_a, '')), lambda c: {'k': c, 'v': list_sum(list_transform(
        range(length(only_a)), lambda i: CASE WHEN only_a[i + 1] = c THEN 1::HUGEINT << i::HUGEINT ELSE 0::HUGEINT END))::HUGEINT})) AS mask
      FROM (SELECT DISTINCT only_a FROM common WHERE only_a <> '' AND only_b <> '')""",
    "subsequences": """SELECT only_a, only_b, length(only_a) - bit_count(list_reduce(
        list_transform(string_split(only_b, ''), lambda c: coalesce(mask[c], 0)::HUGEINT),
        lambda s, m: ((s + (s & m)) | (s - (s & m))) & ((1::HUGEINT << length(only_a)::HUGEINT) - 1), (1::HUGEINT << length(only_a)::HUGEINT) - 1)) AS lcs
      FROM (SELECT DISTINCT only_a, only_b FROM common WHERE only_a <> '' AND only_b <> '') JOIN masks USING (only_a)""",
    "lengths": """SELECT a, b, len(wa) = 0 OR len(wb) = 0 AS has_none, len(both_w) > 0 AS has_both, only_a, only_b, coalesce(lcs, 0) AS lcs,
        length(array_to_string(both_w, '')) + greatest(len(both_w) - 1, 0) AS shared, CAST(len(both_w) > 0 AS INTEGER) AS gap, length(only_a) AS la, length(only_b) AS lb
      FROM common LEFT JOIN subsequences USING (only_a, only_b)""",
    "ratios": f"""SELECT a, b, CAST(CASE WHEN has_none THEN 0 WHEN has_both AND (only_a = '' OR only_b = '') THEN 100 ELSE round_even(greatest(
        {_ratio.format(distance='la + lb - 2 * lcs', total='2 * (shared + gap) + la + lb')},
        CASE WHEN has_both THEN {_ratio.format(distance='gap + la', total='2 * shared + gap + la')} ELSE 0 END,
        CASE WHEN has_both THEN {_ratio.format(distance='gap + lb', total='2 * shared + gap + lb')} ELSE 0 END), 0) END AS INTEGER) AS ratio FROM lengths""",
    "counted": "SELECT product_id, count(*) AS n_offers FROM offers GROUP BY 1",
    "rollup": "SELECT product_id, min(current_price) AS best_price, count(DISTINCT retailer_id) AS retailer_count FROM offers GROUP BY 1",
    "parts": f"""SELECT listing_id, p.product_id, p.category_id, p.category_name, p.name AS canonical_name, p.shown_brand, p.fingerprint, m.ratio AS model_score, n.ratio AS name_score,
        coalesce(l.fingerprint = p.fingerprint, false) AS same_print, l.brand <> '' AND l.brand = p.brand AS same_brand,
        CASE WHEN l.brand = '' OR p.brand = '' THEN {_weight(V.BRAND_UNKNOWN)} WHEN l.brand = p.brand THEN {_weight(V.BRAND_EQUAL)} ELSE {_weight(V.BRAND_UNEQUAL)} END AS brand_score,
        CASE WHEN {_shared} = 0 THEN {_weight(V.ATTRIBUTES_UNKNOWN)} ELSE (({_same})::DOUBLE / ({_shared})) * 100.0::DOUBLE END AS attribute_score,
        list_filter([{_matched}], lambda k: k IS NOT NULL)[1:3] AS matched, coalesce(n_offers, 0) AS n_offers
      FROM asked l JOIN known p ON l.category_id IS NULL OR l.category_id = p.category_id
      JOIN ratios m ON m.a = l.model AND m.b = p.model JOIN ratios n ON n.a = l.name AND n.b = p.name LEFT JOIN counted c ON c.product_id = p.product_id""",
    "scored": f"""SELECT *, CAST(format('{{:.1f}}', least(100.0::DOUBLE, model_score * {_weight(V.MODEL_WEIGHT)} + name_score * {_weight(V.NAME_WEIGHT)}
        + brand_score * {_weight(V.BRAND_WEIGHT)} + attribute_score * {_weight(V.ATTRIBUTE_WEIGHT)} + CASE WHEN same_print THEN {_weight(V.FINGERPRINT_BONUS)} ELSE 0 END)) AS DOUBLE) AS score
      FROM parts""",
    "placed": """SELECT *, CAST(row_number() OVER (PARTITION BY listing_id ORDER BY score DESC, n_offers DESC, lower(canonical_name) DESC, CAST(product_id AS VARCHAR)) AS INTEGER) AS position
      FROM scored""",
    "best": f"""SELECT placed.*, best_price, coalesce(retailer_count, 0) AS retailer_count,
        coalesce(nullif(concat_ws('; ', CASE WHEN same_print THEN '{V.REASON_FINGERPRINT}' END, CASE WHEN same_brand THEN '{V.REASON_BRAND}' || shown_brand END,
          CASE WHEN len(matched) > 0 THEN '{V.REASON_ATTRIBUTES}' || array_to_string(matched, ', ') END,
          CASE WHEN model_score >= {V.SIMILARITY_REASON_MIN} THEN '{V.REASON_MODEL}' || model_score END,
          CASE WHEN name_score >= {V.SIMILARITY_REASON_MIN} THEN '{V.REASON_NAME}' || name_score END), ''), '{V.REASON_FALLBACK}') AS reasons
      FROM placed LEFT JOIN rollup USING (product_id) WHERE position <= 8""",
}

REVIEW_CANDIDATES = """SELECT listing_id, d.id AS decision_id, product_id, category_id, position, score, model_score, name_score, reasons, canonical_name, best.fingerprint,
  shown_brand AS brand, category_name, best_price, retailer_count FROM (SELECT id, listing_id FROM decisions WHERE decision = 'needs_review') d JOIN best USING (listing_id)"""

REVIEW_QUEUE = f"""SELECT d.*, t.product_id AS top_product_id, t.canonical_name AS top_name, t.score AS top_score, t.reasons AS top_reasons, t.best_price AS top_best_price,
  t.retailer_count AS top_retailer_count FROM (
    SELECT d.listing_id, d.product_id, d.id, decision, confidence, matcher, fingerprint, created_at, title, '' AS source_url, 'available' AS listing_status,
      CASE WHEN s % 10 <> 7 THEN CAST(k % 9 + 1 AS BIGINT) END AS category_id, s AS retailer_id, r.name AS retailer_name,
      CASE WHEN s % 10 <> 7 THEN {_category.format(k='k')} END AS category_name, CAST(NULL AS VARCHAR) AS canonical_name
    FROM (SELECT *, listing_id // 100000 AS k, listing_id % 100000 AS s, {listing_title('(listing_id // 100000)', '(listing_id % 100000)')} AS title
          FROM decisions WHERE decision = 'needs_review') d JOIN retailers r ON r.id = s
    ORDER BY created_at DESC, d.id DESC LIMIT 500) d LEFT JOIN (SELECT * FROM best WHERE position = 1) t ON t.listing_id = d.listing_id"""

BULK_ELIGIBLE = """SELECT d.id AS decision_id, product_id, score AS top_score FROM (SELECT id, listing_id FROM decisions WHERE decision = 'needs_review') d
  JOIN best USING (listing_id) WHERE position = 1 AND score >= {least}"""

BULK_OUTCOMES = f"""SELECT d.id AS decision_id, CASE WHEN decision <> 'needs_review' THEN 'decision_not_pending_review' WHEN listing_id IS NULL THEN 'no_candidate'
    WHEN score < {V.BULK_MIN_SCORE} THEN 'below_min_score' ELSE 'resolved' END AS outcome,
  CASE WHEN score >= {V.BULK_MIN_SCORE} THEN b.product_id END AS product_id, CASE WHEN score >= {V.BULK_MIN_SCORE} THEN canonical_name END AS canonical_name,
  CASE WHEN score >= {V.BULK_MIN_SCORE} THEN score END AS score
  FROM decisions d LEFT JOIN (SELECT * FROM best WHERE position = 1) b USING (listing_id)"""
