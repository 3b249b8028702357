"""Connected components of an edge table as a Spark loop.

Each node points to a smaller node of its component. A round lowers the pointers by the
grandparents of the neighbours (of the node itself and of its parent) and then halves the paths, so
the number of rounds grows with the logarithm of the longest chain. Only minima are shuffled
(partial aggregation), joins are on (node) with equal-width rows on both sides, and the pointer
table is checkpointed each round, so a lost executor costs one round. A component that holds a
third of all nodes makes the grandparent join skewed; both sides of it are plain shuffled tables,
which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns u, v of type long); root is the smallest
    node of the component. Edges may be given in either direction, repeated, or as loops."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    e = cut_lineage(both.distinct())
    f = cut_lineage(e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("f")).select("node", F.least("node", "f").alias("f")))
    total = None
    while True:
        s = f.agg(F.sum(F.col("f").cast("decimal(38,0)"))).first()[0]
        if s == total:  # pointers only ever fall, so an equal sum means that none has changed
            return f.select("node", F.col("f").alias("root"))
        total = s
        up = f.select(F.col("node").alias("f"), F.col("f").alias("g"))
        g = f.join(up, "f").select("node", "f", "g")
        low = e.join(g.select(F.col("node").alias("v"), "g"), "v").groupBy(F.col("u").alias("node")).agg(F.min("g").alias("m"))
        told = g.join(low, "node").select(
            F.explode(
                F.array(
                    F.struct(F.col("f").alias("node"), F.col("m").alias("f")),
                    F.struct(F.col("node"), F.least("m", "g").alias("f")),
                )
            ).alias("x")
        )
        f = cut_lineage(told.select("x.node", "x.f").groupBy("node").agg(F.min("f").alias("f")))
