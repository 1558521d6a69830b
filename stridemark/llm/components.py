"""Connected components of links between long ids, by smallest labels and pointer jumping, all in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) of every node of the links (a, b); root is the smallest node that it reaches.

    In a round each node takes the smallest label among its neighbours and itself, and then the label of that label,
    so that paths shrink by more than half. Every round is a written table. Null ends are left out.
    """
    pairs = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = written(pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root"))
    labels = written(labels, "labels")
    for _ in range(rounds):
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("via"), F.col("root").alias("far"))
        new = written(step.join(jump, F.col("mid") == F.col("via"), "left").select("node", "old", F.least("mid", "far").alias("root")), "labels")
        labels = new.select("node", "root")
        if new.filter("root <> old").isEmpty():
            return labels
    raise RuntimeError(f"no end after {rounds} rounds")
