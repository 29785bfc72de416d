"""Connected components of links held in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.session import settle_table


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of a link (a, b): the smallest node reachable. Nulls are no nodes; repeated links and links of
    a node to itself do no harm; no links give no rows.

    Each node is tied to its least neighbour. If links are stars already, that ends it; what is left are links
    between centres, whose components come by alternating stars: each round ties the neighbours of a
    node to the least of them, until nothing changes."""
    edges = settle_table(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    best = settle_table(edges.groupBy("u").agg(F.min("v").alias("m")), "stars")
    between = edges.join(best, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
    centres = best.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u", F.col("m").alias("v"))
    rest = _stars(settle_table(between.unionByName(centres).distinct(), "links"))
    own = best.select(F.col("u").alias("node"), "m").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("m")).distinct())
    # A node with neighbours on both sides has two rows here; the least of them is its component.
    return own.join(rest.select(F.col("node").alias("m"), F.col("comp").alias("c")), "m", "left").select("node", F.coalesce("c", "m").alias("comp")).groupBy("node").agg(F.min("comp").alias("comp"))


def _stars(edges: DataFrame) -> DataFrame:
    """(node, comp) of edges (u, v) with u > v."""
    mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low, "u")
        edges = settle_table(tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(tied.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()
