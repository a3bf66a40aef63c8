"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step: ``links`` (a, b) become links to the least node around.

    Large: the neighbours above a node go to the least of the node and its
    neighbours.  Small: the neighbours below it, and the node itself, do.
    """
    around = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = around.groupBy("a").agg(F.min("b").alias("__low")).select("a", F.least("a", "__low").alias("__low"))
    if large:  # stored, so that Spark can split a node of many links in the join; the small step leaves nodes few
        least = materialise(least, "least")
    joined = around.join(least, "a")
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("__low").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("__low").alias("b")).unionByName(least.select("a", F.col("__low").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b): root is the component's least node.

    Every step is written to the shared folder, so neither plans nor lineage
    grow; the number of steps is logarithmic in the longest chain.
    """
    ordered = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialise(ordered, "links")
    before = None
    while True:
        now = materialise(_star(_star(now, True), False), "links")
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
