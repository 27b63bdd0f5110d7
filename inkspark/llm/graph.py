"""Connected components by rounds of minimum labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeze


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): the smallest node it is connected to.

    Each round links every node to the smallest of its neighbours (large star, then small
    star), which turns components into stars around their smallest node in a number of rounds
    that grows with the logarithm of their size. Only a count reaches the driver.
    """
    links = freeze(
        edges.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y"))
        .filter("x != y")
        .distinct(),
        "links",
    )
    while True:
        both = links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
        smallest = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        # Large star: larger neighbours of x go to the smallest node around x.
        large = both.filter("y > x").join(smallest, "x").select(F.col("y").alias("x"), "m")
        large = large.filter("x != m").distinct().withColumnRenamed("m", "y")
        # Small star: x and its smaller neighbours go to the smallest of them.
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        new = freeze(
            small.filter("x != y")
            .unionByName(low.withColumnRenamed("m", "y"))
            .distinct(),
            "links",
        )
        # Done when every x has one y and no y is an x.
        many = new.groupBy("x").count().filter("count > 1").limit(1)
        deep = new.join(new.select(F.col("y").alias("x")), "x", "left_semi").limit(1)
        links = new
        if many.isEmpty() and deep.isEmpty():
            break
    nodes = links.select(F.col("x").alias("node"), F.col("y").alias("root"))
    roots = links.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct()
    return nodes.unionByName(roots)
