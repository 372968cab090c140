"""Secret scan with multipart credential linking, in DataFrame expressions only.

Strong patterns are reported wherever they match. Weak parts (account identifiers, random-looking words, endpoints) are
reported only where complementary parts lie in one scope, with no more than ``scope`` code points between two spans: an
identifier needs a secret, a random word needs an identifier, an endpoint needs both. The interval join is a pair of windows over
the sparse spans of a document, the furthest end before and the nearest start behind, so it costs a sort of the spans and never
forms pairs.

A span's place comes from the lengths of the text pieces between matches, summed in order.

Defined results: null text is empty; no match gives zero counts, an empty list and the digest of the empty text;
repeated rows and rows with a null id get a result each; spans that start together are listed in the order of the kinds; texts
of any length are read whole; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricetide.llm.rows import KEY, keyed

SCOPE = 200
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
IDENT = r"""(?i:user(?:name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]+)"""
ENDPOINT = r"""((?:[a-z]{2,12}://[^\s"'<>]+)|(?:(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?(?![0-9.])))"""
RANDOM = r"""((?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-]))"""

#: kind, order of ties, pattern with its value as the first group, least code points of the match and of the value, part
KINDS = [
    ("assign", 0, ASSIGN, 0, 6, "secret"),
    ("access", 1, r"(AKIA[A-Z0-9]+)", 20, 0, "id"),
    ("hex", 2, r"([0-9a-f]{24,})", 24, 0, "secret"),
    ("ident", 3, IDENT, 0, 3, "id"),
    ("random", 4, RANDOM, 0, 16, "secret"),
    ("endpoint", 5, ENDPOINT, 0, 7, "endpoint"),
]
STRONG = 3
PIECES = "array<struct<kind:string,rank:int,k:int,gap:bigint,len:bigint,value:bigint>>"


def _guards(text: Column) -> dict[str, Column]:
    """Cheap tests that hold wherever the pattern matches."""
    low = F.lower(text)
    has = lambda *words: F.greatest(*[F.contains(low, F.lit(w)) for w in words])
    return {
        "assign": has("password", "passwd", "secret", "token", "api"), "access": F.contains(text, F.lit("AKIA")),
        "hex": text.rlike("[0-9a-f]{24}"), "ident": has("user", "login", "account", "client", "key"),
        "random": text.rlike("[A-Za-z0-9+/_=-]{16}") & text.rlike("[0-9]"),
        "endpoint": F.contains(text, F.lit("://")) | text.rlike(r"[0-9]\.[0-9]"),
    }


def _pieces(kind: str, rank: int, pattern: str, guard: Column) -> Column:
    """Per match: its number and the lengths of the text before it, of itself and of its value."""
    whole = F.lit(rf"(?s)\G(.*?)({pattern})")
    zipped = F.arrays_zip(*[F.regexp_extract_all("text", whole, F.lit(i)).alias(n) for i, n in ((1, "p"), (2, "m"), (3, "v"))])
    found = F.transform(zipped, lambda x, i: F.struct(
        F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), i.alias("k"), F.length(x["p"]).cast("long").alias("gap"),
        F.length(x["m"]).cast("long").alias("len"), F.length(x["v"]).cast("long").alias("value"),
    ))
    return F.coalesce(F.when(guard, found), F.array().cast(PIECES))


def find_spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Reported spans: key columns, kind, rank, start, end."""
    guards = _guards(F.col("text"))
    found = docs.select(*KEY, F.explode(F.concat(*[_pieces(k, r, p, guards[k]) for k, r, p, *_ in KINDS])).alias("s"))
    found = found.select(*KEY, "s.*").dropDuplicates([*KEY, "rank", "k"])
    upto = W.partitionBy(*KEY, "rank").orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = found.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto)).withColumn("start", F.col("end") - F.col("len"))
    least = F.coalesce(*[F.when(F.col("rank") == r, (F.col("len") >= a) & (F.col("value") >= b)) for _, r, _, a, b, _ in KINDS])
    part = F.coalesce(*[F.when(F.col("rank") == r, F.lit(p)) for _, r, *_, p in KINDS])
    placed = placed.filter(least).withColumn("part", part)
    strong = F.col("rank") < STRONG
    order = W.partitionBy(*KEY).orderBy("start")
    before, after = order.rangeBetween(W.unboundedPreceding, 0), order.rangeBetween(0, W.unboundedFollowing)
    covered = (F.coalesce(F.max(F.when(strong, F.col("end"))).over(before), F.lit(-1)) > F.col("start")) | (
        F.coalesce(F.min(F.when(strong, F.col("start"))).over(after) < F.col("end"), F.lit(False)))
    own = placed.withColumn("covered", ~strong & covered)
    part_is = lambda p, value: F.when((F.col("part") == p) & ~F.col("covered"), F.col(value))
    # an earlier span of the part ends, or a later one starts, within the scope
    seen = lambda p: F.coalesce(F.max(part_is(p, "end")).over(before) >= F.col("start") - scope, F.lit(False)) | F.coalesce(
        F.min(part_is(p, "start")).over(after) <= F.col("end") + scope, F.lit(False))
    linked = own.withColumn("has_id", seen("id")).withColumn("has_secret", seen("secret"))
    complete = F.when(F.col("part") == "id", F.col("has_secret")).when(F.col("part") == "secret", F.col("has_id")).otherwise(
        F.col("has_id") & F.col("has_secret"))
    return linked.filter(strong | (~F.col("covered") & complete)).select(*KEY, "kind", "rank", "start", "end")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per document: counts of the strong kinds, all spans in order and the digest of the strong ones."""
    rows = keyed(docs)
    name = F.concat_ws(":", "kind", "start", "end")
    listed = lambda keep: F.array_join(F.transform(F.array_sort(F.filter("spans", keep)), lambda x: x["name"]), ",")
    count = lambda r: F.count(F.when(F.col("rank") == r, 1))
    per_doc = find_spans(rows, scope).groupBy(*KEY).agg(
        F.collect_list(F.struct("start", "rank", name.alias("name"))).alias("spans"),
        count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.count("*").alias("n_spans"),
    ).select(*KEY, "n_assign", "n_access", "n_hex", "n_spans", listed(lambda x: x["rank"] < STRONG).alias("base"),
             listed(lambda x: F.lit(True)).alias("all"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("doc_id", *KEY).join(per_doc, KEY, "left").select(
        "doc_id", zero("n_assign"), zero("n_access"), zero("n_hex"), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("all", F.lit("")).alias("spans"), (zero("n_spans") - zero("n_assign") - zero("n_access") - zero("n_hex")).alias("n_linked"),
    )
