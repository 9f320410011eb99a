"""Algebra of interferometric pairs: tables of pair_id, primary, secondary, days, one row a pair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import names_to_dates, pair_name

KEY = ("primary", "secondary")


def pairs(df: DataFrame, primary: str = "primary", secondary: str = "secondary") -> DataFrame:
    """Canonical pairs: the earlier date first, no repeats, no pair of a date with itself."""
    a, b = F.to_date(primary), F.to_date(secondary)
    rows = df.select(F.least(a, b).alias("primary"), F.greatest(a, b).alias("secondary")).filter("primary < secondary").distinct()
    return rows.select(pair_name(F.col("primary"), F.col("secondary")).alias("pair_id"), "primary", "secondary", F.datediff("secondary", "primary").alias("days"))


def from_names(df: DataFrame, name: str = "name") -> DataFrame:
    """Pairs of the last two dates of names."""
    dates = names_to_dates(F.col(name), 2)
    return pairs(df.select(dates[0].alias("primary"), dates[1].alias("secondary")))


def indexed(table: DataFrame, *order: str) -> DataFrame:
    """Adds idx, the place (from 0) in the order of the pairs.

    The window is over the pairs of a network, of which there are thousands, not over pixels.
    """
    return table.withColumn("idx", F.row_number().over(Window.orderBy(*(order or KEY))) - 1)


def at_positions(table: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """Rows start, start + step, ... before stop, as in a slice with a positive step; negative places count from the end."""
    if step < 1:
        raise ValueError("step is positive")
    rows = indexed(table).withColumn("_n", F.count("*").over(Window.partitionBy()))

    def place(k: int) -> Column:
        return F.lit(k) if k >= 0 else F.greatest(F.col("_n") + k, F.lit(0))

    first = place(start or 0)
    kept = rows.filter((F.col("idx") >= first) & ((F.col("idx") - first) % step == 0))
    return (kept if stop is None else kept.filter(F.col("idx") < place(stop))).drop("_n", "idx")


def between(table: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Pairs with both dates from start to end, both included.  A month or year means its first day."""
    full = {4: "-01-01", 7: "-01"}
    bounds = [None if d is None else d + full.get(len(d), "") for d in (start, end)]
    if None not in bounds and bounds[0] > bounds[1]:
        raise ValueError("start is after end")
    for date in KEY:
        if bounds[0]:
            table = table.filter(F.col(date) >= F.lit(bounds[0]).cast("date"))
        if bounds[1]:
            table = table.filter(F.col(date) <= F.lit(bounds[1]).cast("date"))
    return table


def touching(table: DataFrame, date: str) -> DataFrame:
    """Pairs that have the date at either end."""
    d = F.lit(date).cast("date")
    return table.filter((F.col("primary") == d) | (F.col("secondary") == d))


def at_indices(table: DataFrame, indices: Sequence[int]) -> DataFrame:
    """Pairs at the given places; order and repeats of the places don't matter."""
    return indexed(table).filter(F.col("idx").isin(list(indices))).drop("idx")


def member_mask(table: DataFrame, others: DataFrame) -> DataFrame:
    """Adds member: whether the pair is one of ``others``."""
    marks = others.select("pair_id").distinct().withColumn("_m", F.lit(True))
    return table.join(marks, "pair_id", "left").withColumn("member", F.coalesce("_m", F.lit(False))).drop("_m")


def where(table: DataFrame, others: DataFrame) -> DataFrame:
    """(pair_id, idx) of the pairs of ``table`` that are in ``others``."""
    return indexed(table).join(others.select("pair_id").distinct(), "pair_id", "left_semi").select("pair_id", "idx")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).dropDuplicates(["pair_id"])


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "pair_id", "left_semi")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "pair_id", "left_anti")


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: equal, whether two sets of pairs are the same."""
    left, right = (x.select("pair_id").distinct() for x in (a, b))
    odd = left.exceptAll(right).unionAll(right.exceptAll(left))
    return odd.agg((F.count("*") == 0).alias("equal"))


def acquisitions(table: DataFrame) -> DataFrame:
    """Sorted dates of either end, with idx from 0."""
    return table.select(F.explode(F.array(*KEY)).alias("date")).distinct().withColumn("idx", F.row_number().over(Window.orderBy("date")) - 1)


def edge_index(table: DataFrame) -> DataFrame:
    """Adds i and j, the places of the primary and the secondary among the acquisitions."""
    dates = acquisitions(table)
    first = dates.select(F.col("date").alias("primary"), F.col("idx").alias("i"))
    second = dates.select(F.col("date").alias("secondary"), F.col("idx").alias("j"))
    return table.join(first, "primary").join(second, "secondary").select(*table.columns, "i", "j")


def sort(table: DataFrame, order: str | Sequence[str] = "pairs", ascending: bool = True) -> DataFrame:
    """Distinct pairs with rank, their place (from 0) by pairs, primary, secondary or days, or several of them."""
    keys: list[str] = []
    for k in [order] if isinstance(order, str) else order:
        keys += KEY if k == "pairs" else [k]
    keys += [k for k in KEY if k not in keys]
    by = [F.col(k).asc() if ascending else F.col(k).desc() for k in keys]
    return table.dropDuplicates(["pair_id"]).withColumn("rank", F.row_number().over(Window.orderBy(*by)) - 1)


def gaps(table: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Dates of the network, but for the first, that are no secondary of the pairs that remain."""
    left = table if removed is None else difference(table, removed)
    dates = acquisitions(table).filter("idx > 0").select("date")
    return dates.join(left.select(F.col("secondary").alias("date")), "date", "left_anti")


def named_between(df: DataFrame, start: str, end: str, name: str = "name") -> DataFrame:
    """Rows whose name begins on or after start and ends on or before end (yyyyMMdd)."""
    first, last = F.to_date(F.left(F.col(name), F.lit(8)), "yyyyMMdd"), F.to_date(F.right(F.col(name), F.lit(8)), "yyyyMMdd")
    return df.filter((first >= F.to_date(F.lit(start), "yyyyMMdd")) & (last <= F.to_date(F.lit(end), "yyyyMMdd")))


def path_pairs(path: Column, closing: bool) -> Column:
    """Array of the pairs of consecutive dates of a path; with ``closing`` also first to last."""
    edges = F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda k: F.struct(F.element_at(path, k).alias("primary"), F.element_at(path, k + 1).alias("secondary"), F.lit(1).alias("coef")))
    diagonal = F.array(F.struct(F.element_at(path, 1).alias("primary"), F.element_at(path, -1).alias("secondary"), F.lit(-1).alias("coef")))
    return F.concat(edges, diagonal) if closing else edges

