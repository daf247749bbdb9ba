"""Connected components by alternating star operations on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from every node of ``edges`` (src, dst long), as (node, root).

    Every round hangs the larger neighbours of a node, then the smaller ones, below its smallest
    neighbour, until the edges are stars. Each step takes a minimum per node with partial aggregation
    and joins it to the edges, so no task holds a node's neighbours; each round is a written table. The
    number of rounds grows with the logarithm of the longest path. Nodes without edges are not
    returned; null nodes and loops are ignored.
    """
    pairs = (edges.where("src <> dst")
             .select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).distinct())
    pairs, state = cut_lineage(pairs, "edges"), None
    while True:
        digest = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if digest == state:
            break
        state = digest
        both = pairs.unionAll(pairs.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
        large = (both.join(least, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
                 .where("hi <> lo").distinct())
        large = cut_lineage(large, "edges")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").selectExpr(
            "inline(array(struct(hi AS hi, m AS lo), struct(lo AS hi, m AS lo)))").where("hi <> lo").distinct()
        pairs = cut_lineage(small, "edges")
    stars = pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return stars.unionAll(stars.select(F.col("root").alias("node"), "root").distinct())
