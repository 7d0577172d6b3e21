"""Connected components of a table of links, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candidata.cluster import written


def _large_star(links: DataFrame) -> DataFrame:
    """Connect larger neighbours of every node to the smallest node around it."""
    both = links.union(links.select(F.col("b"), F.col("a")))
    least = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("least"))
    least = written(least, "least")
    rows = both.filter("b > a").join(least, F.col("a") == F.col("node"))
    return rows.select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Connect a node and its smaller neighbours to the smallest of them. Rows have a > b."""
    least = written(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")), "least")
    rows = links.join(least, F.col("a") == F.col("node"))
    moved = rows.filter("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select(F.col("node").alias("a"), F.col("least").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) links between numbers -> (node, root), root being the smallest of the component.

    Nodes that are their own root are left out. Alternates two contractions until nothing
    changes: about as many rounds as the logarithm of the longest path. Every round is
    written to the shared folder; the driver sees a count and a checksum. A node with very
    many links is the hot side of a join of two stored tables, which Spark splits: an aggregate
    right below the join would tie all links of a node to one task.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = written(links.filter("a > b").distinct(), "links")
    seen = None
    while True:
        state = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        links = written(_small_star(_large_star(links).distinct()), "links")
