"""Connected components of a link table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramix.llm.work import drop, stored


def components(links: DataFrame) -> DataFrame:
    """(node, root): for every id in the links (a long, b long) the smallest id it is connected with.

    Each round takes the smallest label over a node's links, then the label of that label, so chains halve. All
    state is written to the shared folder between rounds; only one count a round reaches the driver."""
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a <> b").distinct()
    edges = stored(both, "edges")
    before = labels = stored(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = (
            edges.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("low"))
        )
        lower = labels.join(near, "node").select("node", F.least("root", "low").alias("up"), F.col("root").alias("was"))
        up = lower.select(F.col("node").alias("up"), F.col("up").alias("over"))
        step = stored(lower.join(up, "up").select("node", F.col("over").alias("root"), (F.col("over") < F.col("was")).alias("moved")), "labels")
        drop(before)
        before, labels = step, step.select("node", "root")
        if not step.filter("moved").limit(1).count():
            drop(edges)
            return labels
