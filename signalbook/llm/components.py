"""Connected components of a link table by alternating star contractions.

Each round hangs every neighbour on the smallest node it can see: first the larger neighbours of a
node, then the smaller ones.  The rounds end when every node points straight at the smallest node of
its component; their number grows with the logarithm of the longest chain.  Minima are folded before
the shuffle and every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbook.llm.common import staged


def _down(pairs: DataFrame) -> DataFrame:
    return pairs.where("node > low").distinct()


def _unsettled(edges: DataFrame) -> DataFrame:
    """Nodes with two parents, or with a parent and a child."""
    ends = edges.select("node", F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("low", F.lit(0), F.lit(1))
    )
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up + down > 1")


def components(links: DataFrame) -> DataFrame:
    """node, root for every node with a link; ``links`` has columns a and b of one ordered type."""
    edges = staged(_down(links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("low"))), "links")
    while not _unsettled(edges).isEmpty():
        both = edges.union(edges.select(F.col("low"), F.col("node")))
        least = both.groupBy("node").agg(F.min("low").alias("m")).select("node", F.least("node", "m").alias("m"))
        hung = _down(both.join(least, "node").where("low > node").select(F.col("low").alias("node"), F.col("m").alias("low")))
        lowest = hung.groupBy("node").agg(F.min("low").alias("m"))
        pulled = hung.join(lowest, "node")
        edges = staged(
            _down(pulled.select("node", F.col("m").alias("low")).union(pulled.select(F.col("low"), F.col("m")))), "links"
        )
    roots = edges.select("node", F.col("low").alias("root"))
    return roots.union(edges.select("low", "low").distinct())
