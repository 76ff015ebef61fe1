"""Connected components of links held as a DataFrame.

Each node takes its smallest smaller neighbour as parent, which makes a forest; parents are followed to their roots by
doubling; links are carried over to the roots, and what still joins two roots goes into the next round. A root is
the smallest node of its tree, so that the last roots are the smallest of their components. All tables are written
between steps; nothing but row counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import counted, dropped, written


def _roots(parents: DataFrame) -> DataFrame:
    """(node, root) from a written forest (node, root)."""
    spark = parents.sparkSession
    while True:
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("above"))
        above = parents.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
        moved, (_, n) = counted(above, "roots", F.col("moved"))
        dropped(spark, parents)
        parents = moved.drop("moved")
        if not n:
            return parents


def _carried(links: DataFrame, roots: DataFrame) -> DataFrame:
    """Links between different roots, once each, with the smaller first."""
    for side in ("a", "b"):
        to = roots.select(F.col("node").alias(side), F.col("root").alias("_root"))
        links = links.join(to, side, "left").withColumn(side, F.coalesce("_root", side)).drop("_root")
    return links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, root) of all nodes of links (a, b) that aren't their own root, and of those known before; written tables."""
    spark = links.sparkSession
    first = _carried(links, known) if known is not None else links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links, (n,) = counted(first, "links")
    while n:
        roots = _roots(written(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "parents"))
        if known is None:
            known = roots
        else:
            up = roots.select(F.col("node").alias("root"), F.col("root").alias("above"))
            old = known.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
            both = written(old.unionByName(roots), "known")
            dropped(spark, known)
            known = both
        left, (n,) = counted(_carried(links, roots), "links")
        dropped(spark, links)
        links = left
    if known is None:
        known = written(links.select(F.col("a").alias("node"), F.col("b").alias("root")), "known")
    dropped(spark, links)
    return known
