"""Connected components of a graph given as links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, saved, saved_at


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the links: root is the smallest node that can be reached.

    Every round takes the least label among a node and its neighbours, then the label of that label, so paths
    shrink by half at least; each round is written to the shared folder, and the one before it deleted. Links to itself and repeated
    links are harmless, null ends are left out.
    """
    one = links.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null and x != y")
    links = saved(one.unionByName(one.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    spark, (labels, old) = links.sparkSession, saved_at(links.groupBy("x").agg(F.least(F.first("x"), F.min("y")).alias("root")).withColumnRenamed("x", "node"), "labels")
    while True:
        near = links.join(labels, links["y"] == labels["node"]).groupBy("x").agg(F.min("root").alias("near"))
        least = labels.join(near, labels["node"] == near["x"], "left")
        least, between = saved_at(least.select("node", F.col("root").alias("was"), F.least("root", "near").alias("root")), "labels")
        of = least.select(F.col("node").alias("n"), F.col("root").alias("r"))
        new = least.join(of, least["root"] == of["n"], "left")
        new, path = saved_at(new.select("node", "was", F.least("root", "r").alias("root")), "labels")
        for done in (old, between):
            delete(spark, done)
        labels, old = new.select("node", "root"), path
        if new.filter("root != was").isEmpty():
            return labels
