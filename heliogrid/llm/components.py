"""Connected components of a table of links, by label spreading with pointer jumping.

Every round is a join of two written tables, whose hot keys Spark can split, and an
aggregation that is partial before its shuffle; nothing is gathered on the driver but the
number of labels that changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b): the smallest node of its component.

    Links may repeat, in either direction; a link with a null end is not one.
    """
    links = links.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = written(links.union(links.select("b", "a")).distinct(), "cc-links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "cc-labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        spread = written(spread, "cc-spread")
        above = spread.select(F.col("node").alias("label"), F.col("label").alias("top"))
        jumped = written(spread.join(above, "label").select("node", "was", F.col("top").alias("label")), "cc-labels")
        labels = jumped.select("node", "label")
        if jumped.filter("label <> was").limit(1).count() == 0:
            return labels
