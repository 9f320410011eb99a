"""Connected components of a link table, as DataFrame operations (alternating large-star and small-star)."""

from __future__ import annotations

from contextlib import nullcontext

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SMALL, discard, materialize, uncompiled


def _stars(links: DataFrame, rows: int) -> DataFrame:
    """One large-star and one small-star step over a written table of links (a, b) with a > b, which goes.

    Both sides of each join are written tables, so a hub's rows meet its one minimum in a plain join, whose skewed partitions the
    planner can split; a sum and a join in one stage could not be.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low", 2 * rows)
    large = materialize(both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large", 2 * rows)
    least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "low", 2 * rows)
    small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = materialize(least.select("a", F.col("m").alias("b")).union(small).distinct(), "stars", 2 * rows)
    discard(links, low, large, least)
    return out


def _are_stars(links: DataFrame) -> bool:
    """Whether every node has one link to a smaller one, or only links to larger ones: what the steps lead to."""
    ends = links.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1").isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b: long); component is the smallest node reachable.

    Self links and nulls are ignored; an empty table gives an empty one.  Each step works on rows of two longs, the
    minima combine before the shuffle, and every step's table is written to the shared folder, so the lineage stays
    short and a lost executor costs one step at most.  Steps: logarithmic in the longest path; none for links that are stars.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    links = materialize(links, "links")
    while True:
        rows = links.count()
        with uncompiled(links.sparkSession) if rows <= SMALL else nullcontext():
            done = _are_stars(links)
        if done:
            break
        links = _stars(links, rows)
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
