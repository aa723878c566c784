"""Connected components of a graph of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rondas.sources.shared import scratch, write_out


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); a component is named by its least node.

    Each round gives a node the least name among its own, its neighbours' and
    the holder's of that name, so long chains shorten by jumps. A node's
    neighbours are reduced before they are shuffled, whatever their number. Every
    round is written to the shared folder, and removed when the names are final; only a count of changes
    comes to the driver.
    """
    with scratch(links.sparkSession):
        return write_out(_names(links), keep=True)


def _names(links: DataFrame) -> DataFrame:
    edges = write_out(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    names = write_out(edges.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")))
    while True:
        near = (
            edges.join(names.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        )
        best = names.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = names.select(F.col("node").alias("component"), F.col("component").alias("further"))
        step = write_out(
            best.join(jump, "component").select("node", "old", F.least("component", "further").alias("component"))
        )
        changed = step.filter("old <> component").limit(1).count()
        names = step.select("node", "component")
        if not changed:
            return names
