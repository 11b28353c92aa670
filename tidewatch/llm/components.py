"""Connected components of an undirected edge list, as Spark joins and aggregations.

Min-label propagation (each node takes the smallest label among itself and its neighbours)
interleaved with pointer jumping (a node adopts its label's label), run until no label
changes. Every round is cut with a reliable checkpoint. No cap on rounds: it stops at the
fixed point, which on chains of length d takes O(log d) rounds thanks to the jumping step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import ensure_checkpoint_dir


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``edges`` (src, dst) string node keys -> (node, component) for every node on an edge;
    the component id is the smallest node key in the component."""
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
    e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).where(F.col("a") != F.col("b")).distinct()
    e = e.checkpoint()
    labels = e.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("comp")).withColumnRenamed("a", "node")
    labels = labels.checkpoint()
    while True:
        # neighbours' labels
        nb = e.join(labels.withColumnRenamed("node", "b").withColumnRenamed("comp", "nb_comp"), "b").groupBy("a").agg(
            F.min("nb_comp").alias("m"))
        step = labels.join(nb.withColumnRenamed("a", "node"), "node", "left").select(
            "node", F.least(F.col("comp"), F.coalesce(F.col("m"), F.col("comp"))).alias("comp"))
        # pointer jumping: take the label of the label
        jump = step.join(step.select(F.col("node").alias("comp"), F.col("comp").alias("comp2")), "comp", "left").select(
            "node", F.least(F.col("comp"), F.coalesce(F.col("comp2"), F.col("comp"))).alias("comp"))
        jump = jump.checkpoint()
        changed = jump.join(labels.withColumnRenamed("comp", "old"), "node").where(F.col("comp") != F.col("old")).limit(1).count()
        labels = jump
        if changed == 0:
            return labels
