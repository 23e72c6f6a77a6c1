"""Connected components of a link table, by rounds of minimum labels and label jumps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteselect.llm.common import keep


def connected(links: DataFrame, src: str = "a", dst: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node reachable. Only nodes that have a link are returned.

    Each round takes the smallest label among the neighbours and then the label of that label, so that
    chains shorten by more than half. Every round ends in a written table. Groups may be of any size: labels
    meet in a partial aggregate, and no neighbour list is gathered.
    """
    edges = links.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    edges = keep(edges.union(edges.select("v", "u")), "edges")
    labels = keep(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("component")).withColumnRenamed("u", "node"), "labels")
    for _ in range(rounds):
        near = edges.join(labels, edges.v == labels.node).groupBy("u").agg(F.min("component").alias("low"))
        step = labels.join(near, labels.node == near.u).select("node", "component", F.least("component", "low").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("component").alias("above"))
        step = step.join(up, "low", "left").select("node", F.least("low", "above").alias("next"), "component")
        step = keep(step, "labels")
        labels = step.select("node", F.col("next").alias("component"))
        if not step.where("next <> component").limit(1).count():
            return labels
    raise RuntimeError(f"labels still change after {rounds} rounds")
