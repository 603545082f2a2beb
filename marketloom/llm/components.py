"""Connected components of a stored edge table: hooking to the smallest neighbour label, and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of `edges` (a, b): root is the smallest vertex of its component.

    Each round is two joins on vertices and a map-side combined minimum; labels
    are written after each round. Rounds grow with the logarithm of a component's
    diameter, and stop when no label changes.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("root"), F.lit(True).alias("moved")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        hooked = labels.select("v", F.col("root").alias("old")).join(near.withColumnRenamed("a", "v"), "v").select("v", "old", F.least("old", "m").alias("to"))
        to = labels.select(F.col("v").alias("to"), F.col("root").alias("next"))
        jumped = hooked.join(to, "to", "left").withColumn("root", F.least("to", F.coalesce("next", "to")))
        new = stored(jumped.select("v", "root", (F.col("root") != F.col("old")).alias("moved")), "labels")
        release(labels)
        labels = new
        if labels.filter("moved").isEmpty():
            release(both)
            return labels.select("v", "root")
