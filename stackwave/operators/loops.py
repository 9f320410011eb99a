"""Triplets and loops of pair networks, their matrices and closures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import pair_name, path_name, season_of_month
from .pairs import pairs, path_pairs


def triplets(table: DataFrame) -> DataFrame:
    """(d1, d2, d3) with all three pairs in the network."""
    ab = table.select(F.col("primary").alias("d1"), F.col("secondary").alias("d2"))
    bc = table.select(F.col("primary").alias("d2"), F.col("secondary").alias("d3"))
    ac = table.select(F.col("primary").alias("d1"), F.col("secondary").alias("d3"))
    return ab.join(bc, "d2").join(ac, ["d1", "d3"], "left_semi").select("d1", "d2", "d3")


def triplets_from_names(df: DataFrame, name: str = "name") -> DataFrame:
    from ..functions.dates import names_to_dates

    d = F.array_sort(names_to_dates(F.col(name), 3))
    return df.select(d[0].alias("d1"), d[1].alias("d2"), d[2].alias("d3")).distinct()


def triplet_columns(table: DataFrame) -> DataFrame:
    """Adds the names of the three pairs, their days, and the triplet's name."""
    d1, d2, d3 = F.col("d1"), F.col("d2"), F.col("d3")
    return table.select(
        "d1", "d2", "d3",
        pair_name(d1, d2).alias("pair12"), pair_name(d2, d3).alias("pair23"), pair_name(d1, d3).alias("pair13"),
        F.datediff(d2, d1).alias("days12"), F.datediff(d3, d2).alias("days23"), F.datediff(d3, d1).alias("days13"),
        path_name(F.array("d1", "d2", "d3")).alias("loop_id"),
    )


def triplet_season(d1: Column, d2: Column, d3: Column, most_days: int = 180) -> Column:
    """The season that the three dates share, if they span fewer than ``most_days`` days; else 0."""
    s1, s2, s3 = (season_of_month(F.month(d)) for d in (d1, d2, d3))
    return F.when((s1 == s2) & (s2 == s3) & (F.datediff(d3, d1) < most_days), s1).otherwise(0)


def paths_between(table: DataFrame, path: str, start: str, end: str) -> DataFrame:
    """Rows whose path lies from start to end as a whole."""
    low, high = F.lit(start).cast("date"), F.lit(end).cast("date")
    return table.filter(F.forall(path, lambda d: d.between(low, high)))


def paths_touching(table: DataFrame, path: str, date: str) -> DataFrame:
    return table.filter(F.array_contains(path, F.lit(date).cast("date")))


def valid_diagonals(table: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs that edge pairs could bridge: the days of the edges inside a pair's span sum up to its days at least."""
    e = edges.select(F.col("primary").alias("_p"), F.col("secondary").alias("_s"), F.col("days").alias("_d"))
    inside = table.join(e, (F.col("_p") >= F.col("primary")) & (F.col("_s") <= F.col("secondary")))
    return inside.groupBy("pair_id", "primary", "secondary", "days").agg(F.sum("_d").alias("_sum")).filter("_sum >= days").drop("_sum")


def loops(table: DataFrame, max_acquisition: int = 5, max_days: int | None = None, edge_days: int | None = None, edges: DataFrame | None = None) -> DataFrame:
    """(loop_id, path): rising paths over edge pairs whose first and last date are a pair that is no edge.

    Edges are given, or those pairs that span ``edge_days`` days at most.  A path has 3 to ``max_acquisition`` dates; its closing pair
    spans ``max_days`` at most.  Paths grow by equi-joins with the edges, once a date, and are kept only while some closing pair of
    their start reaches further, so the joins stay as small as the result allows.
    """
    if edges is None:
        if edge_days is None:
            raise ValueError("edges or edge_days is needed")
        edges = table.filter(F.col("days") <= edge_days)
    edges = edges.select("primary", "secondary").distinct()
    diagonals = table.join(edges, ["primary", "secondary"], "left_anti")
    if max_days is not None:
        diagonals = diagonals.filter(F.col("days") <= max_days)
    diagonals = diagonals.select(F.col("primary").alias("start"), F.col("secondary").alias("stop"))
    reach = diagonals.groupBy("start").agg(F.max("stop").alias("reach"))
    step = edges.select(F.col("primary").alias("last"), F.col("secondary").alias("next"))
    grown = edges.select(F.col("primary").alias("start"), F.col("secondary").alias("last"), F.array("primary", "secondary").alias("path")).join(reach, "start").filter("last < reach")
    found = None
    for _ in range(3, max_acquisition + 1):
        grown = grown.join(step, "last").filter("next <= reach").select("start", F.col("next").alias("last"), F.concat("path", F.array("next")).alias("path"), "reach")
        closed = grown.join(diagonals, (grown["start"] == diagonals["start"]) & (grown["last"] == diagonals["stop"]), "left_semi").select("path")
        found = closed if found is None else found.unionByName(closed)
    if found is None:
        raise ValueError("max_acquisition is 3 at least")
    return found.select(path_name(F.col("path")).alias("loop_id"), "path")


def triplet_paths(table: DataFrame) -> DataFrame:
    """Triplets as loops."""
    return table.select(F.array("d1", "d2", "d3").alias("path")).select(path_name(F.col("path")).alias("loop_id"), "path")


def loop_matrix(table: DataFrame) -> DataFrame:
    """(loop_id, pair_id, coef): +1 for the edges of a loop, -1 for its closing pair."""
    rows = table.select("loop_id", F.explode(path_pairs(F.col("path"), True)).alias("p"))
    return rows.select("loop_id", pair_name(F.col("p.primary"), F.col("p.secondary")).alias("pair_id"), F.col("p.coef").alias("coef"))


def loop_pairs(table: DataFrame, kind: str = "all") -> DataFrame:
    """Distinct pairs of loops: all, edge or diagonal."""
    path = F.col("path")
    if kind == "edge":
        rows = table.select(F.explode(path_pairs(path, False)).alias("p"))
    elif kind == "diagonal":
        rows = table.select(F.struct(F.element_at(path, 1).alias("primary"), F.element_at(path, -1).alias("secondary")).alias("p"))
    else:
        rows = table.select(F.explode(path_pairs(path, True)).alias("p"))
    return pairs(rows.select("p.primary", "p.secondary"))


def sort_loops(table: DataFrame, order: Sequence[str] = ("loop_id",)) -> DataFrame:
    """Distinct loops with rank (from 0) in the given order, then by name."""
    by = [*order, *(["loop_id"] if "loop_id" not in order else [])]
    return table.dropDuplicates(["loop_id"]).withColumn("rank", F.row_number().over(Window.orderBy(*by)) - 1)
