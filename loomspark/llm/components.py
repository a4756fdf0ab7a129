"""Connected components of an edge table, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import discard, same_table, written


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, label)`` for every node of ``edges(a, b)``; the label is the least node of its component.

    Each round takes the least label among a node and its neighbours, then
    follows that label's own label (pointer jumping), so paths shrink by a
    factor per round.  Every round is written to the shared folder, which ends
    its lineage.  Self-loops and repeated edges are harmless, rows with a null
    end are ignored, and an empty table gives an empty one.
    """
    clean = edges.filter("a IS NOT NULL AND b IS NOT NULL")
    both = clean.select("a", "b").union(clean.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node", "left").select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        step = step.join(jump, "next", "left").select("node", F.least("next", "far").alias("label"), (F.least("next", "far") < F.col("label")).alias("moved"))
        step = written(step, "labels")
        discard(labels)
        if step.filter("moved").isEmpty():
            discard(both)
            return same_table(step.select("node", "label"), step)
        labels = same_table(step.select("node", "label"), step)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
