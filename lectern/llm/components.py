"""Connected components of a graph of links between ids, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import discard, staged


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step. Every node links those of its neighbours that are larger than it (large), or itself and those that are
    smaller (not large), to the least of its neighbours and itself. Minima are pre-aggregated; a hub's edges meet its one row
    of minima in a join, whose skewed side can be split."""
    if large:
        edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = edges.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("hub"), F.least("a", "least").alias("least"))
    met = edges.join(least, F.col("a") == F.col("hub"))
    if large:
        found = met.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        found = met.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select(F.col("hub").alias("a"), F.col("least").alias("b")))
    return found.filter("a <> b").distinct()


def _done(links: DataFrame) -> bool:
    """Whether the links are stars: every id hangs on one centre at most, and no centre hangs on another."""
    ends = links.select(F.col("a").alias("id"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(links.select(F.col("b").alias("id"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    return ends.groupBy("id").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).filter("hangs + holds > 1 AND hangs > 0").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the least id that each linked id can reach. Ids without links are not in it. The tables of each step are
    written to the shared folder, as the result is, so that lineage stays short; steps end when the links are stars, whose centres are
    less than all that hang on them."""
    links = staged(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct(), "links")
    while not _done(links):
        following = staged(_stars(_stars(links, large=True), large=False), "links")
        discard(links)
        links = following
    found = staged(links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct(), "components")
    discard(links)
    return found
