"""Connected components as joins and aggregates, with every round's labels in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.sources.durable import durable


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of undirected `edges` (a, b); a component is named by its smallest node.

    Each round takes the least label among neighbours and then that label's own label, so rounds grow
    with the logarithm of a component's length. Hubs pre-aggregate. Nulls and self-loops are ignored.
    """
    one_way = edges.select("a", "b").where("a <> b")
    both = durable(one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = durable(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("component")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("component").alias("was"), F.least("component", "near").alias("now"))
        roots = labels.select(F.col("node").alias("root"), F.col("component").alias("above"))
        jumped = lower.join(roots, lower["now"] == roots["root"], "left").select("node", "was", F.least("now", F.coalesce("above", "now")).alias("component"))
        stepped = durable(jumped, "labels")
        labels = stepped.select("node", "component")
        if not stepped.where("was <> component").limit(1).count():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
