"""SQL twins of the queries that SQL can state."""

from __future__ import annotations

WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: shingles per document, all pairs that share one, and what is reachable over the links
NEAR_DUPLICATES = f"""
WITH RECURSIVE texts AS (
  SELECT doc_id, {WORDS.format(text=f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS words FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM texts WHERE len(words) >= 5)
  UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM texts WHERE len(words) BETWEEN 1 AND 4),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common.n >= 85 * (x.n + y.n - common.n)),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS b FROM reached GROUP BY 1)
SELECT t.doc_id, coalesce(s.n, 0) AS n_shingles, least(t.doc_id, coalesce(l.b, t.doc_id)) AS component_id,
  t.doc_id <= coalesce(l.b, t.doc_id) AS kept
FROM texts t LEFT JOIN sizes s USING (doc_id) LEFT JOIN least l USING (doc_id)"""

SUBSTRINGS = f"""
WITH texts AS (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS words FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS run
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM texts WHERE len(words) >= 13)),
firsts AS (SELECT run, min(doc_id) AS first FROM windows GROUP BY 1),
gone AS (
  SELECT DISTINCT doc_id, i + k AS p FROM (
    SELECT doc_id, i, unnest(range(0, 13)) AS k FROM windows JOIN firsts USING (run) WHERE first < doc_id)),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM texts) w ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT t.doc_id, len(words) AS n_words, len(words) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k USING (doc_id)"""

LETTERS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _nibble(value: int) -> int:
    for _ in range(4):
        value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
    return value


#: the CRC-32 register's change by each half byte
CRC_NIBBLES = ", ".join(str(_nibble(i)) for i in range(16))

#: the CRC of each distinct feature by half bytes, bucket totals, gains, weights and the draw
RESAMPLING = f"""
WITH texts AS (
  SELECT true AS own, doc_id AS id, {LETTERS} AS words FROM documents
  UNION ALL SELECT false, item_id, {LETTERS} FROM benchmark),
runs AS (
  SELECT own, id, array_to_string(words[i:i + k - 1], ' ') AS feature
  FROM (SELECT own, id, words, unnest(range(1, len(words) + 1)) AS i FROM texts) CROSS JOIN (VALUES (1), (2), (3)) sizes(k)
  WHERE i + k - 1 <= len(words)),
counted AS (SELECT own, id, feature, count(*) AS n FROM runs GROUP BY ALL),
digits AS (SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM counted)),
buckets AS (
  SELECT feature, xor(list_reduce(
    list_transform(range(len(h)), lambda i: (strpos('0123456789ABCDEF', h[xor(i, 1) + 1]) - 1)::BIGINT),
    lambda c, x: xor(list_extract([{CRC_NIBBLES}]::BIGINT[], (xor(c, x) & 15) + 1), c >> 4), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
  FROM digits),
placed AS (SELECT own, id, bucket, sum(n) AS n FROM counted JOIN buckets USING (feature) GROUP BY ALL),
totals AS (
  SELECT bucket, coalesce(sum(n) FILTER (own), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT own), 0)::DOUBLE AS t FROM placed GROUP BY 1),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM totals) + 10000) / ((s + 1) * ((SELECT sum(t) FROM totals) + 10000))))::BIGINT AS gain FROM totals),
weights AS (SELECT id, sum(n) AS n_features, sum(n * gain)::BIGINT AS weight FROM placed JOIN gains USING (bucket) WHERE own GROUP BY 1),
scored AS (
  SELECT t.id AS doc_id, len(words) >= 20 AS fit, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('42:' || t.id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM texts t LEFT JOIN weights w USING (id) WHERE t.own)
SELECT doc_id, n_features, weight, score, 
  CASE WHEN fit AND row_number() OVER best <= (5 * (SELECT count(*) FROM scored WHERE fit)) // 100 THEN row_number() OVER best END AS rank
FROM scored WINDOW best AS (PARTITION BY fit ORDER BY score DESC, doc_id)"""

#: tf of each item term in each document, weights and scores in whole numbers
SEARCH = f"""
WITH texts AS (SELECT row_number() OVER () AS place, doc_id, {LETTERS} AS words FROM documents),
sizes AS (SELECT place, doc_id, len(words) AS n FROM texts WHERE len(words) > 0),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM sizes),
asked AS (SELECT DISTINCT item_id, unnest({LETTERS}) AS term FROM benchmark),
counts AS (
  SELECT place, term, count(*) AS tf FROM (SELECT place, unnest(words) AS term FROM texts) SEMI JOIN asked USING (term) GROUP BY 1, 2),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM counts GROUP BY 1), totals),
scores AS (
  SELECT item_id, place, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // totals.words))))::BIGINT AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN sizes USING (place), totals GROUP BY 1, 2)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank
  FROM scores JOIN sizes USING (place) WHERE score > 0) WHERE rank <= 50"""

ORACLES = {"op3_minhash": NEAR_DUPLICATES, "op10_substrings": SUBSTRINGS, "op11_resampling": RESAMPLING, "op13_search": SEARCH}
