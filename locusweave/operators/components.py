"""Connected components of an edge table (survey G5), by alternating star contractions in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import cut


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the smallest node that each node of any edge can reach.

    Edges are undirected; self-loops and rows with a null end add nothing but their own node. Each round
    links every node's larger neighbours to its smallest one (large star), then its smaller ones (small
    star); edges never outnumber the input and the rounds grow with the logarithm of a component's size.
    A node's neighbours are only aggregated to their minimum, so a hub needs no group in memory.
    """
    pair = cut(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")))
    nodes = pair.select(F.explode(F.array("a", "b")).alias("node")).where("node is not null").distinct()
    links = cut(pair.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        links = cut(small.select("x.*").where("a <> b").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return nodes.join(links.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
