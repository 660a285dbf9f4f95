"""Connected components of a graph kept in tables."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def contract(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels after joining the classes that ``edges`` (a, b) connect.

    ``labels`` has (node, label), label being the smallest node of its class.
    Each round maps the edges to labels, hooks every label to its smallest
    neighbour, follows the hooks to their roots (the distance doubles each time)
    and drops the edges inside a class; classes at least halve in two rounds
    where edges are left. All state is in tables.
    """
    left = materialize(edges.select("a", "b"), "edges")
    while True:
        la, lb = (labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
        cross = left.join(la, "a").join(lb, "b").where("la != lb")
        left = materialize(cross.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(),
                           "edges")
        if left.limit(1).count() == 0:
            return labels
        # edges are between labels from here on; a label is a node of its own class as long as hooks end at roots
        hook = left.groupBy(F.col("b").alias("label")).agg(F.min("a").alias("to"))
        hook = materialize(hook, "hooks")
        while True:
            up = hook.select(F.col("label").alias("to"), F.col("to").alias("further"))
            longer = materialize(hook.join(up, "to", "left").select("label", "to", "further"), "hooks")
            hook = longer.select("label", F.coalesce("further", "to").alias("to"))
            if longer.where("further is not null").limit(1).count() == 0:
                break
        labels = materialize(labels.join(hook, "label", "left").select(
            "node", F.coalesce("to", "label").alias("label")), "labels")
