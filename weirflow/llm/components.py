"""Connected components of an undirected edge table, by label exchange with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each node that has an edge, with the least node it reaches.

    Each round gives a node the least label among its neighbours, then replaces the label by that
    label's own label, which halves the paths. Hot nodes are summed before the shuffle. The state of
    each round is staged in the shared folder; only a count of changes comes to the driver.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y")))
    both = staged(both.filter("x <> y").distinct(), "edges")
    state = staged(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("label")), "labels")
    while True:
        # edges carry the labels of their far ends to each node
        near = both.join(state, both["y"] == state["node"]).groupBy("x").agg(F.min("label").alias("near"))
        step = state.join(near, state["node"] == near["x"]).select("node", "label", F.least("label", "near").alias("least"))
        jump = state.select(F.col("node").alias("via"), F.col("label").alias("far"))
        step = step.join(jump, step["least"] == jump["via"], "left").select("node", F.col("label").alias("old"), F.least("least", F.coalesce("far", "least")).alias("label"))
        step = staged(step, "labels")
        changed = step.filter("old <> label").limit(1).count()
        state = step.drop("old")
        if not changed:
            return state.select("node", F.col("label").alias("component"))
