"""Connected components of an edge table, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage_table


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest
    node that can be reached. Labels spread along the edges and then jump to
    their label's label, so rounds grow with the logarithm of the longest
    path. Each round is written once, which cuts the lineage. A node with
    very many edges is one row a task after the partial minimum, and on the
    joins the label side has one row a node."""
    both = stage_table(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                       .where(F.col("a") != F.col("b")), "cc-edges")
    labels = stage_table(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), "cc-labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("_m"))
        spread = labels.join(near, F.col("node") == F.col("a"), "left").select(
            "node", "root", F.least("root", F.coalesce("_m", "root")).alias("_new"))
        up = labels.select(F.col("node").alias("_n2"), F.col("root").alias("_r2"))
        moved = stage_table(spread.join(up, F.col("_new") == F.col("_n2"), "left").select(
            "node", F.least("_new", F.coalesce("_r2", "_new")).alias("root"), F.col("root").alias("_old")), "cc-labels")
        done = moved.where(F.col("root") != F.col("_old")).isEmpty()
        labels = moved.select("node", "root")
        if done:
            return labels
