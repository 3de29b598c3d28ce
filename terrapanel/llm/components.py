"""Connected components of a link table, in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.session import staged


def _flattened(parents: DataFrame) -> DataFrame:
    """(node, label) with label the root that following parents leads to. Doubles the step until nothing moves."""
    while True:
        above = parents.select(F.col("node").alias("label"), F.col("label").alias("up"))
        moved = staged(
            parents.join(above, "label", "left").select(
                "node", F.coalesce("up", "label").alias("label"), F.col("up").isNotNull().alias("moved")
            ),
            "parents",
        )
        parents = moved.select("node", "label")
        if moved.where("moved").isEmpty():
            return parents


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in `links` (a, b: comparable ids, a != b); label is the component's smallest node.

    In each step every node takes its smallest neighbour as parent if that is smaller; what is left of
    the links is contracted. A component loses at least the nodes that aren't local minima, so the steps grow with the
    logarithm of its size, not with its diameter times its size. No group is collected.
    """
    labels = None
    rest = links.select("a", "b")
    while True:
        both = rest.select("a", "b").unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = staged(
            both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).where("label < node"), "hooked"
        )
        if labels is None and parents.isEmpty():
            return links.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0)
        parents = _flattened(parents)
        if labels is None:
            labels = parents
        else:
            up = parents.select(F.col("node").alias("label"), F.col("label").alias("up"))
            old = labels.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label"))
            labels = old.unionByName(parents)
        ends = parents.select(F.col("node").alias("end"), F.col("label").alias("up"))
        for end in ("a", "b"):
            rest = rest.join(ends.withColumnRenamed("end", end), end, "left").withColumn(
                end, F.coalesce("up", end)
            ).drop("up")
        rest = staged(rest.where("a <> b").distinct(), "contracted")
        labels = staged(labels, "labels")
        if rest.isEmpty():  # else the larger end of a link has a smaller neighbour
            break
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
