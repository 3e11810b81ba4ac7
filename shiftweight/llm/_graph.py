"""Connected components with DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import spread_join, written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node.

    Each round hooks nodes and their labels onto the smallest neighbouring label and then halves the paths, so
    rounds grow with the logarithm of the longest path. Every round is a written table: lineage stays short.
    Neighbours of a node and nodes of a label, of which one may have a third of all, are spread over tasks.
    """
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    degrees = written(edges.groupBy("b").agg(F.count("*").alias("n")))
    while True:
        of_b = degrees.join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
        of_a = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
        near = spread_join(edges, of_b, ["b"], F.xxhash64("a")).groupBy("a").agg(F.min("lb").alias("lb")).join(of_a, "a")
        offers = near.select(F.col("a").alias("node"), "lb").unionByName(near.select(F.col("la").alias("node"), "lb")).groupBy("node").agg(F.min("lb").alias("lb"))
        hooked = written(labels.join(offers, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "lb").alias("label")))
        sizes = hooked.groupBy("label").agg(F.count("*").alias("n"))
        up = sizes.join(hooked.select(F.col("node").alias("label"), F.col("label").alias("above")), "label", "left")
        following = written(spread_join(hooked, up, ["label"], F.xxhash64("node")).select("node", "old", F.least("label", F.coalesce("above", "label")).alias("label")))
        labels = following.select("node", "label")
        if following.filter("label <> old").isEmpty():
            return labels.withColumnRenamed("label", "component")
