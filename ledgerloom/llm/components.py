"""Connected components of a link table by alternating large and small stars.

Each round is joins and partially aggregated minima over the links, written to the shared folder;
hub vertices only make a join side that Spark may split. Nothing is gathered on the driver but counts: links take few bytes
in their files and many in memory, so no side of a join is left for Spark to broadcast.

Defined results: a link of an id with itself or with null says nothing, and ids that have no other are not in the
result; repeated links and either direction are the same; no links give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import written

MAX_ROUNDS = 60


def connected_components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) for each id of links (src, dst; any direction, repeats allowed)."""
    ordered = links.select(F.greatest("src", "dst").alias("v"), F.least("src", "dst").alias("u")).filter("u < v").distinct()
    edges = written(ordered, "links")
    before = None
    for _ in range(MAX_ROUNDS):
        stars = written(small_star(large_star(edges)), "stars")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        edges = stars
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    members = edges.groupBy("v").agg(F.min("u").alias("component")).select(F.col("v").alias("id"), "component")
    heads = members.select("component").distinct().select(F.col("component").alias("id"), "component")
    return members.unionByName(heads)


def large_star(edges: DataFrame) -> DataFrame:
    """Each vertex links its larger neighbours to the smallest of itself and its neighbours."""
    both = edges.select("v", "u").union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
    least = both.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("c"), F.least("v", "m").alias("m"))
    larger = both.filter("u > v").join(least.hint("merge"), F.col("v") == F.col("c"))
    return larger.select(F.col("u").alias("v"), F.col("m").alias("u")).filter("u < v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Each vertex links its smaller neighbours and itself to the smallest of them."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    moved = edges.join(least.withColumnRenamed("v", "c").hint("merge"), F.col("v") == F.col("c")).select(F.col("u").alias("v"), F.col("m").alias("u"))
    return moved.union(least.select("v", F.col("m").alias("u"))).filter("u < v").distinct()
