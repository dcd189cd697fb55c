"""Connected components of a table of links, without leaving Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelflow.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links(a, b)``; the root is the smallest node reachable.

    Every round gives a node the smallest label around it and then the label of that label, so the
    number of rounds grows with the logarithm of a component's width. Labels are written to the
    shared root between rounds.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_m")).select(
        "node", F.least("node", "_m").alias("root")), "labels")
    while True:
        around = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "root")
        near = around.unionByName(labels).groupBy("node").agg(F.min("root").alias("root"))
        up = labels.select(F.col("node").alias("_up"), F.col("root").alias("_top"))
        jumped = near.join(up, near["root"] == up["_up"], "left").select(
            "node", F.least("root", "_top").alias("root"))
        was = labels.select(F.col("node").alias("_node"), F.col("root").alias("_was"))
        new = stored(jumped.join(was, F.col("node") == F.col("_node")).select(
            "node", "root", (F.col("root") != F.col("_was")).alias("moved")), "labels")
        labels = new.select("node", "root")
        if new.where("moved").isEmpty():
            return labels


def with_more_links(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` of all links, given the ``roots`` of the earlier ones: only components that the new
    links join are looked at again."""
    at = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    ends = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(
        F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y")).where("x <> y")
    ends = ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    joined = components(ends).select(F.col("node").alias("_old"), F.col("root").alias("_new"))
    old = roots.join(joined, F.col("root") == F.col("_old"), "left").select("node", F.coalesce("_new", "root").alias("root"))
    fresh = joined.select(F.col("_old").alias("node"), F.col("_new").alias("root")).join(roots.select("node"), "node", "left_anti")
    return stored(old.unionByName(fresh), "labels")
