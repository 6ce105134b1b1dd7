"""Connected components of a link table, by smallest labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Stages


def components(links: DataFrame, run: Stages, name: str) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b): the smallest node it is joined to.

    Each round takes the smallest label among a node's neighbours and then that
    label's own label; labels only fall, so equal sums of changes end it. A
    round is a stage table, which cuts the lineage.
    """
    both = links.filter("a <> b").select("a", "b")
    edges = run.save(both.union(both.select("b", "a")).distinct(), f"{name}_edges")
    labels = run.save(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), f"{name}_0")
    turn = 0
    while True:
        turn += 1
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("lower"))
        jump = labels.select(F.col("node").alias("lower"), F.col("label").alias("far"))
        after = lower.join(jump, "lower").select("node", F.least("lower", "far").alias("label"), (F.least("lower", "far") < F.col("label")).alias("moved"))
        after = run.save(after, f"{name}_{turn}")
        moved = after.filter("moved").limit(1).count()
        labels = after.select("node", "label")
        if not moved:
            return labels
