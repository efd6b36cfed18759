"""Connected components of a link table by minimum labels with pointer jumping; no link reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def components(links: DataFrame, what: str = "components") -> DataFrame:
    """``links``(a, b) of longs -> (node, root): root is the smallest node reachable.

    Each round takes the smallest label among a node and its neighbours, then that label's own label, so the number of
    rounds is logarithmic in the longest path. Every round is cut into the shared folder. Empty links: an empty result.
    A node without a link to another does not appear unless it is linked with itself.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{what}-links", few=True)
    labels = table = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("root")), f"{what}-0", few=True)
    turn = 0
    while True:
        turn += 1
        near = (
            both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("other")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("other").alias("other"))
        )
        lower = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "other").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        new = cut(lower.join(jump, "mid").select("node", "old", F.least("mid", "far").alias("root")), f"{what}-{turn}", few=True)
        discard(table)
        table, changed = new, new.where("root <> old").limit(1).count()
        labels = new.select("node", "root")
        if not changed:
            discard(both)
            return labels
