"""Connected components of a graph of links, by alternating large-star and small-star steps.

Every step is a grouping and a join over the links; nothing is gathered on the driver. A hub's neighbours are never
collected: each step takes the least neighbour with a map-side aggregate and joins it back, and Spark may split that join.
The steps run until the links stop changing, a few rounds for star-shaped groups and logarithmically many for chains.
Up to ``FEW`` links are worked off in one partition, where a round shuffles nothing; no step makes more links than twice as many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricetide.sources.lineage import cut, release

#: links (two numbers each) that one task takes
FEW = 250_000


def _pairs(*pairs: tuple[str, str]) -> Column:
    return F.explode(F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in pairs]))


def _star(links: DataFrame, large: bool, few: bool) -> DataFrame:
    """Large star: connect each node's larger neighbours to its least; small star: its smaller ones and itself."""
    if large:
        both = links.select(_pairs(("a", "b"), ("b", "a")).alias("l")).select(F.col("l.a").alias("u"), F.col("l.b").alias("v"))
    else:
        both = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if few:  # a window keeps the one partition, a join would deal it out
        joined = both.withColumn("m", F.least("u", F.min("v").over(W.partitionBy("u"))))
    else:
        joined = both.join(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "u")
    if large:
        new = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        new = joined.select(_pairs(("v", "m"), ("u", "m")).alias("l")).select("l.a", "l.b")
    return new.filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component``: the least node reachable, for every node that is linked to a lesser one; the others are their own."""
    now = cut(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter(F.col("a") != F.col("b")).distinct())
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before, spent = mark, now
        few = mark[0] <= FEW
        now = cut(_star(_star(now.coalesce(1) if few else now, True, few), False, few))
        release(spent)
    return now.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component")).groupBy("node").agg(
        F.min("component").alias("component"))
