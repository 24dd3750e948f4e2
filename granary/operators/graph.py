"""Graphs as edge tables (a, b) with a weight w: components, degrees, modularity, communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.storage import dropped, saved


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge, by alternating large and small stars.

    Each round shuffles the links once per star, pre-aggregated, and is
    written to the shared folder; the rounds grow with the logarithm of the
    longest chain, and every round but the last lowers some node's centre, so
    they end. The centre of a large component is on most of its links; a join
    to the table of centres, one row each, is one that adaptive execution
    broadcasts, or splits where a partition of links is skewed.
    """
    now = saved(edges.selectExpr("greatest(a, b) as a", "least(a, b) as b").filter("a <> b").distinct(), "links")
    before = None

    while True:
        both = now.unionByName(now.selectExpr("b as a", "a as b"))
        low = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.min("a")).alias("m"))
        large = now.join(low.withColumnRenamed("n", "b"), "b").selectExpr("a", "m as b").distinct()
        root = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = large.join(root.withColumnRenamed("n", "a"), "a").selectExpr("b as a", "m as b").unionByName(root.selectExpr("n as a", "m as b")).filter("a <> b")
        new = saved(small.selectExpr("greatest(a, b) as a", "least(a, b) as b").distinct(), "links")
        state = new.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        dropped(now)
        now = new
        if state == before:
            return now.selectExpr("a as node", "b as root")
        before = state


def both_ways(edges: DataFrame) -> DataFrame:
    """Symmetric weighted adjacency; repeated edges add up."""
    e = edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    return e.groupBy("a", "b").agg(F.sum("w").alias("w"))


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Newman's modularity of a partition (node, community)."""
    e = edges.select("a", "b", "w").join(communities.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(communities.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    ends = e.select(F.col("ca").alias("c"), "w", F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0).alias("i")).unionByName(e.select(F.col("cb").alias("c"), "w", F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0).alias("i")))
    sums = ends.groupBy("c").agg(F.sum("i").alias("i"), F.sum("w").alias("t"))
    # The total weight of all ends is twice that of all edges.
    total = sums.agg(F.sum("t").alias("m2"))
    x = sums.crossJoin(F.broadcast(total))
    return x.agg(F.sum(F.col("i") / F.col("m2") - F.pow(F.col("t") / F.col("m2"), F.lit(2))).alias("modularity"))


def community_scores(edges: DataFrame, communities: DataFrame, least: int = 3) -> DataFrame:
    """Per community of at least ``least`` nodes: size, density, and entropy in bits of its edges' types. edges: a, b, kind."""
    size = communities.groupBy("community").agg(F.count("*").alias("size")).filter(F.col("size") >= least)
    e = edges.join(communities.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(communities.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b").filter("ca = cb")
    kinds = e.groupBy(F.col("ca").alias("community"), "kind").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("community"))
    found = kinds.withColumn("h", -p * F.log2(p)).groupBy("community").agg(F.sum("n").alias("edges"), F.sum("h").alias("entropy"))
    pairs = F.col("size") * (F.col("size") - 1) / 2
    return size.join(found, "community").select("community", "size", "edges", (F.col("edges") / pairs).alias("density"), "entropy")


def louvain(edges: DataFrame) -> DataFrame:
    """(node, community): greedy modularity with nodes visited in order, inside each connected component.

    Moves depend on their order, so a component is one group; components that
    outgrow a task need a distributed method, which gives other communities.
    """
    from granary.operators.kernels import louvain_of

    roots = components(edges.select("a", "b"))
    named = edges.join(roots, edges["a"] == roots["node"], "left").select("a", "b", "w", F.coalesce("root", "a").alias("root"))
    return named.groupBy("root").applyInPandas(lambda pdf: louvain_of(pdf), "node bigint, community bigint")
