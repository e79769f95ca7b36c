"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asterfold.llm.shared import made, remove, write_table


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its smallest neighbour (or itself) to its larger neighbours.

    The smallest neighbours are written: a join with a written table has a shuffle of its own on both sides,
    so that the rows of a node with very many neighbours can be split.
    """
    both = edges.select("hi", "lo").union(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    least = both.groupBy("hi").agg(F.min("lo").alias("m"))
    least, _ = write_table(least.select("hi", F.least("hi", "m").alias("m")), "least")
    return both.where("lo > hi").join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands its smallest neighbour to its smaller neighbours and to itself."""
    edges, _ = write_table(edges, "large")
    least, _ = write_table(edges.groupBy("hi").agg(F.min("lo").alias("m")), "least")
    moved = edges.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.union(least.select("hi", F.col("m").alias("lo"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of the links (columns a, b); root is the smallest node of the component.

    Each round is a few aggregations with partial sums and skew-splittable joins, and is written to the
    shared folder. No node's neighbours are ever gathered. Self-links are ignored.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    edges, path = write_table(edges, "links")
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).head()
    before = mark(edges)
    while before[0]:
        before_step = len(made)
        after, later = write_table(_small_star(_large_star(edges)), "links")
        now = mark(after)
        remove(links.sparkSession, path, *(p for p in made[before_step:] if p != later))
        edges, path = after, later
        if now == before:
            break
        before = now
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(edges.select("lo", "lo").distinct())
