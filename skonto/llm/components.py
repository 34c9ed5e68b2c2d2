"""Connected components of a graph that is a DataFrame of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skonto.llm.common import materialise


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every node of ``links``; the label is the smallest node of its component.

    First each node's links to smaller nodes are bent to the smallest of them: nodes that share their neighbours, as the
    members of many buckets do, keep one link each. Then each round takes the smallest label among the neighbours and then
    the label's own label, so chains halve; rounds are written to the shared folder, and only counts reach the driver. Links
    may repeat and may be loops; null ends are ignored; no links give no nodes.
    """
    ends = links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    bent = ends.withColumn("hub", F.min("b").over(Window.partitionBy("a")))
    ends = bent.select(F.inline(F.array(F.struct(F.col("a"), F.col("hub").alias("b")), F.struct(F.col("b").alias("a"), F.col("hub").alias("b"))))).distinct()
    both = materialise(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        of = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = materialise(lower.join(of, "label").select("node", "was", F.least("label", "next").alias("label")), "labels")
        labels = jumped.select("node", "label")
        if jumped.where("was <> label").limit(1).count() == 0:
            return labels
