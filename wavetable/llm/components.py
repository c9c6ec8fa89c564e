"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetable.session import materialise


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge: the root is the smallest node of the component.

    Each round gives every node the smallest label among itself and its neighbours, then follows the label's own
    label (pointer jumping), so long chains need few rounds.  Labels live in stored tables; only
    a count of changes reaches the driver.  A node with very many edges is pre-aggregated by its neighbours' labels.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    both = materialise(both.union(both.select("y", "x")).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("x"), F.min("y")).alias("root")), "labels")
    while True:
        seen = both.join(labels.withColumnsRenamed({"node": "y", "root": "near"}), "y").groupBy(F.col("x").alias("node")).agg(F.min("near").alias("near"))
        low = labels.join(seen, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("step"))
        jump = labels.select(F.col("node").alias("step"), F.col("root").alias("far"))
        new = materialise(low.join(jump, "step", "left").select("node", "old", F.least("step", F.coalesce("far", "step")).alias("root")), "labels")
        labels = new.select("node", "root")
        if not new.where("old <> root").limit(1).count():
            return labels
