"""Connected components by minimum-label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspan.session import cut_lineage


def components(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """Every node with the smallest node reachable from it.

    Each round a label also jumps to the label of the node it names, so long chains close
    in a logarithmic number of rounds.  Lineage is cut once a round.
    """
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut_lineage(edges.select(F.explode(ways).alias("way")).select("way.a", "way.b").distinct())
    labels = cut_lineage(nodes.select(F.col(node).alias("node"), F.col(node).alias("label")).distinct())
    if both.isEmpty():
        return labels
    while True:
        seen = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lowered = labels.join(seen, labels["node"] == seen["a"], "left").select(
            "node", "label", F.least("label", F.coalesce("near", "label")).alias("next")
        )
        hop = lowered.select(F.col("node").alias("via"), F.col("next").alias("far"))
        jumped = cut_lineage(
            lowered.join(hop, lowered["next"] == hop["via"], "left")
            .select("node", "label", F.least("next", F.coalesce("far", "next")).alias("next"))
        )
        changed = not jumped.filter("next < label").isEmpty()
        labels = jumped.select("node", F.col("next").alias("label"))
        if not changed:
            return labels
