"""Clusters of pixels by thaw and freeze index (Ward linkage, cut at a distance).

Equal pairs of indices merge at no distance, so pixels are counted by them first.  Up to ``CELLS`` squared distinct pairs are clustered as they are, which is
exact.  More are put together in the cells of a lattice, so what is clustered on one worker is bounded by the lattice and not by the number of pixels; each
pixel then stands at most one cell's diagonal, 1.4 / ``CELLS`` of the indices' range, from the mean that is clustered for it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells a side of the lattice.
CELLS = 48


def ward(points: np.ndarray, weights: np.ndarray, distance: float) -> np.ndarray:
    """Labels (from 0, by first appearance) of weighted points; merges while the cheapest Ward distance is under ``distance``."""
    n = len(points)
    label, centre, weight = np.arange(n), points.astype(float).copy(), weights.astype(float).copy()
    alive = np.ones(n, bool)
    gap = np.full((n, n), np.inf)

    def cost(k: int) -> np.ndarray:
        d = np.sqrt(2 * weight * weight[k] / (weight + weight[k]) * ((centre - centre[k]) ** 2).sum(1))
        d[~alive] = np.inf
        d[k] = np.inf
        return d

    for k in range(n):
        gap[k] = cost(k)
    while alive.sum() > 1:
        a, b = np.unravel_index(gap.argmin(), gap.shape)
        if gap[a, b] >= distance:
            break
        centre[a] = (weight[a] * centre[a] + weight[b] * centre[b]) / (weight[a] + weight[b])
        weight[a] += weight[b]
        alive[b] = False
        label[label == b] = a
        gap[b] = gap[:, b] = np.inf
        gap[a] = gap[:, a] = cost(a)
    first = {k: i for i, k in enumerate(dict.fromkeys(label.tolist()))}
    return np.array([first[k] for k in label.tolist()])


def temperature_clusters(index: DataFrame, distance: float, *pixel: str) -> DataFrame:
    """(pixel, label) for rows of pixel, ti, fi; null indices get the label -1."""
    known = index.filter("ti is not null and fi is not null")
    points = known.groupBy("ti", "fi").agg(F.count("*").alias("n"))

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([("u", "ascending"), ("v", "ascending")])
        points = np.column_stack([table["ti"].to_numpy(), table["fi"].to_numpy()])
        return pa.table({"u": table["u"], "v": table["v"], "label": pa.array(ward(points, table["n"].to_numpy(), distance), pa.int32())})

    if points.limit(CELLS**2 + 1).count() <= CELLS**2:
        placed = points.withColumns({"u": F.col("ti").cast("double"), "v": F.col("fi").cast("double")})
    else:
        r = known.agg(F.min("ti").alias("a"), F.max("ti").alias("b"), F.min("fi").alias("c"), F.max("fi").alias("d")).first()

        def cell(x: str, low: float, high: float) -> F.Column:
            return F.least(F.floor((F.col(x) - low) / (high - low) * CELLS), F.lit(CELLS - 1)).cast("double") if high > low else F.lit(0.0)

        placed = points.withColumns({"u": cell("ti", r["a"], r["b"]), "v": cell("fi", r["c"], r["d"])})
    total = F.sum("n")
    cells = placed.groupBy("u", "v").agg((F.sum(F.col("ti") * F.col("n")) / total).alias("ti"), (F.sum(F.col("fi") * F.col("n")) / total).alias("fi"), total.alias("n"))
    labels = cells.withColumn("_one", F.lit(0)).groupBy("_one").applyInArrow(work, "u double, v double, label int")  # at most CELLS**2 rows
    labelled = placed.join(F.broadcast(labels), ["u", "v"]).select("ti", "fi", "label")
    found = known.join(labelled, ["ti", "fi"]).select(*pixel, "label")
    return index.select(*pixel).join(found, list(pixel), "left").select(*pixel, F.coalesce("label", F.lit(-1)).alias("label"))
