"""Small-baseline inversion: design matrices, per-pixel least squares with missing data, unwrapping errors.

The network (dates and pairs, thousands at most) is known on the driver; pixels are not.  Pixels travel as one row each, with an array of the
pairs' values in the network's order, and are solved in slices of Arrow batches: pixels of a slice that miss the same pairs share one factorisation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .models import LINEAR, Model


@dataclass(frozen=True)
class Network:
    """Sorted acquisition dates, and pairs as places among them, in the order of primary and secondary."""

    dates: tuple[date, ...]
    pairs: tuple[tuple[int, int], ...]

    @classmethod
    def of(cls, table: DataFrame) -> Network:
        """Collects a table of pairs, which has a row a pair of the network."""
        rows = sorted({(r[0], r[1]) for r in table.select("primary", "secondary").collect()})
        dates = tuple(sorted({d for r in rows for d in r}))
        place = {d: k for k, d in enumerate(dates)}
        return cls(dates, tuple((place[a], place[b]) for a, b in rows))

    @property
    def names(self) -> list[str]:
        return [f"{self.dates[i]:%Y%m%d}_{self.dates[j]:%Y%m%d}" for i, j in self.pairs]

    def matrix(self) -> np.ndarray:
        """A row a pair, a column an interval between neighbouring dates: 1 where the pair spans it."""
        k = np.arange(max(len(self.dates) - 1, 0))
        return np.array([(k >= i) & (k < j) for i, j in self.pairs], float).reshape(-1, len(k))


@dataclass(frozen=True)
class Design:
    """Rows of ``g`` are the pairs, then a model row a date; the first ``increments`` columns are increments, then parameters."""

    g: np.ndarray
    pairs: int
    increments: int
    parameters: tuple[str, ...] = ()


def sbas(network: Network) -> Design:
    a = network.matrix()
    return Design(a, len(a), a.shape[1])


def nsbas(network: Network, model: Model | None = LINEAR, gamma: float = 1e-4, block: np.ndarray | None = None) -> Design:
    """The network's design with a model's constraint rows, weighted by gamma: gamma * (sum of increments + block * parameters) = 0.

    So the parameters are minus those of the fitted curve.  Without a model it is the plain design.  ``block`` replaces the model's own.
    """
    if model is None:
        return sbas(network)
    if gamma <= 0:
        raise ValueError("gamma is positive")
    a = network.matrix()
    b = model.block(network.dates) if block is None else block
    low = np.tril(np.ones((len(network.dates), a.shape[1])), -1)
    g = np.block([[a, np.zeros((len(a), b.shape[1]))], [gamma * low, gamma * b]])
    return Design(g, len(a), a.shape[1], model.parameters)


def design_table(pairs: DataFrame, acquisitions: DataFrame) -> DataFrame:
    """(pair_id, interval): the ones of the pairs' matrix, as a table; intervals are numbered from 0."""
    at = acquisitions.select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("k"))
    i, j = at.select(F.col("date").alias("primary"), F.col("k").alias("i")), at.select(F.col("date").alias("secondary"), F.col("k").alias("j"))
    return pairs.join(i, "primary").join(j, "secondary").select("pair_id", F.explode(F.sequence("i", F.col("j") - 1)).alias("interval"))


def series(stack: DataFrame, network: Network, *pixel: str, value: str = "phase") -> DataFrame:
    """(pixel, d): an array of the pairs' values in the network's order; null where a pair has none (or NaN).

    A pixel's rows meet in one shuffle, as places and values in any order, and are put in place by batches; where a pair comes more than once
    at a pixel, the mean of its values counts.
    """
    places = stack.sparkSession.createDataFrame(list(zip(network.names, range(len(network.pairs)), strict=True)), "pair_id string, _k int")
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    rows = stack.join(F.broadcast(places), "pair_id").groupBy(*pixel).agg(F.collect_list(F.when(v.isNotNull(), F.struct("_k", v.alias("v")))).alias("_m"))
    width = len(network.pairs)

    def work(b: pa.RecordBatch) -> list[np.ndarray]:
        lists = b.column("_m")
        size = lists.value_lengths().to_numpy(zero_copy_only=False)
        flat = lists.flatten()
        k, v = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("_k", "v"))
        at = k.astype(np.int64) * b.num_rows + np.repeat(np.arange(b.num_rows), size)
        count = np.bincount(at, minlength=width * b.num_rows)
        with np.errstate(invalid="ignore"):
            return [(np.bincount(at, v, width * b.num_rows) / np.where(count, count, np.nan)).reshape(width, b.num_rows)]

    return _per_batch(rows, pixel, ("d",), work, 8 * width)


def solve(g: np.ndarray, d: np.ndarray, more: np.ndarray | None = None) -> np.ndarray:
    """Least squares for every column of ``d`` (rows by pixels; NaN is missing), with the rows that the column has.

    A pixel is solved when it has more rows than ``g`` has columns (``more`` counts rows that are never missing) and its matrix has full
    rank; else its column is NaN.
    """
    n, m = g.shape[1], d.shape[1]
    out = np.full((n, m), np.nan)
    if not m:
        return out
    have = ~np.isnan(d)
    patterns, which = np.unique(have, axis=1, return_inverse=True)
    which = which.reshape(-1)
    order = np.argsort(which, kind="stable")
    cuts = np.searchsorted(which[order], np.arange(patterns.shape[1] + 1))
    for k in range(patterns.shape[1]):
        rows = patterns[:, k]
        if rows.sum() <= n:
            continue
        q, r = np.linalg.qr(g[rows])
        if np.abs(np.diag(r)).min(initial=np.inf) <= 1e-12 * np.abs(r).max(initial=0):
            continue
        mine = order[cuts[k] : cuts[k + 1]]
        out[:, mine] = np.linalg.solve(r, q.T @ d[np.ix_(rows, mine)])
    return out


def _rows(batch: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    """(width, pixels) matrix of an array column; null arrays and elements are NaN."""
    at = batch.column(column)
    flat = at.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    if at.null_count or len(flat) != width * len(at):
        size = at.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        fine = size == width
        rows = np.full((len(at), width), np.nan)
        rows[fine] = flat[np.repeat(fine, size)].reshape(-1, width)
        return rows.T
    return flat.reshape(-1, width).T


def _lists(matrix: np.ndarray) -> pa.Array:
    """One list a column; NaN becomes null."""
    width, n = matrix.shape
    flat = np.ascontiguousarray(matrix.T).reshape(-1)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(flat, from_pandas=True))


#: Bytes of a task's working set, whatever the session's batches are; a slice has a row at least.
SLICE = 16 << 20


def _per_batch(df: DataFrame, keep: Sequence[str], names: Sequence[str], work: Callable[[pa.RecordBatch], list[np.ndarray]], row: int) -> DataFrame:
    """Maps batches to the kept columns and new array columns, in slices; ``row`` is the number of floats that ``work`` holds a row."""
    kinds = dict(df.dtypes)
    step = max(1, SLICE // (8 * max(row, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *map(_lists, work(b))], names=[*keep, *names])

    return df.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), *(f"`{n}` array<double>" for n in names)]))


def invert(pixels: DataFrame, design: Design, *pixel: str, d: str = "d") -> DataFrame:
    """(pixel, increments, parameters, residual_pair, residual_model) for rows with an array of pair values."""
    g, n_pairs, n_model = design.g, design.pairs, len(design.g) - design.pairs

    def work(b: pa.RecordBatch) -> list[np.ndarray]:
        values = np.vstack([_rows(b, d, n_pairs), np.zeros((n_model, b.num_rows))])
        x = solve(g, values)
        residual = values - g @ x
        return [x[: design.increments], x[design.increments :], residual[:n_pairs], residual[n_pairs:]]

    return _per_batch(pixels, pixel, ("increments", "parameters", "residual_pair", "residual_model"), work, 6 * len(g) + 4 * g.shape[1])


def increments_table(solved: DataFrame, network: Network, *pixel: str) -> DataFrame:
    """(pixel, date, increment): increments at the later date of each interval."""
    days = solved.sparkSession.createDataFrame(list(enumerate(network.dates[1:])), "k int, date date")
    return solved.select(*pixel, F.posexplode("increments").alias("k", "increment")).join(F.broadcast(days), "k").select(*pixel, "date", "increment")


def cumulative(solved: DataFrame, network: Network, *pixel: str) -> DataFrame:
    """(pixel, date, deformation): sums of the increments, 0 at the first date; summed up inside the pixel's row, without a shuffle."""
    days = F.array(*(F.lit(x) for x in network.dates))
    sums = F.aggregate("increments", F.array(F.lit(0.0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    return solved.select(*pixel, F.inline(F.arrays_zip(days.alias("date"), sums.alias("deformation"))))


def baselines_from_pairs(pairs: DataFrame, values: str = "baseline", gamma: float = 1e-4) -> DataFrame:
    """(date, value): per-date baselines from those of pairs, 0 at the first date; gaps follow a straight line."""
    network = Network.of(pairs)
    one = series(pairs.withColumn("_one", F.lit(0)), network, "_one", value=values)
    return cumulative(invert(one, nsbas(network, LINEAR, gamma), "_one"), network, "_one").select("date", F.col("deformation").alias("value"))


def loop_arrays(loops: DataFrame, network: Network) -> tuple[np.ndarray, np.ndarray]:
    """The loops' matrix over the network's pairs, and which pairs close a loop."""
    place = {p: k for k, p in enumerate(network.pairs)}
    day = {d: k for k, d in enumerate(network.dates)}
    paths = sorted(tuple(r[0]) for r in loops.select("path").distinct().collect())
    c, closing = np.zeros((len(paths), len(network.pairs))), np.zeros(len(network.pairs), bool)
    for r, path in enumerate(paths):
        at = [day[d] for d in path]
        for a, b in zip(at[:-1], at[1:], strict=True):
            c[r, place[a, b]] = 1
        c[r, place[at[0], at[-1]]] = -1
        closing[place[at[0], at[-1]]] = True
    return c, closing


def closures(pixels: DataFrame, loops: DataFrame, network: Network, *pixel: str, d: str = "d") -> DataFrame:
    """(loop_id, pixel, closure): the sum of a loop's edges less its closing pair; null where a pair has no value.

    Sums are made inside the pixel's row, a batch at a time, so no row is multiplied before it is summed and nothing is shuffled.
    """
    place = {p: k for k, p in enumerate(network.pairs)}
    day = {x: k for k, x in enumerate(network.dates)}
    table = sorted({(r[0], tuple(r[1])) for r in loops.select("loop_id", "path").collect()})  # a row a loop of the network
    edges = [[place[day[a], day[b]] for a, b in zip(path[:-1], path[1:], strict=True)] for _, path in table]
    closing = [place[day[path[0]], day[path[-1]]] for _, path in table]

    def work(b: pa.RecordBatch) -> list[np.ndarray]:
        values = _rows(b, d, len(network.pairs))
        out = np.empty((len(table), b.num_rows))
        for k, (own, last) in enumerate(zip(edges, closing, strict=True)):
            out[k] = values[own].sum(0) - values[last]
        return [out]

    names = F.lit([name for name, _ in table]) if table else F.array().cast("array<string>")
    rows = _per_batch(pixels, pixel, ("_c",), work, 3 * len(table) + 2 * len(network.pairs))
    return rows.select(*pixel, F.inline(F.arrays_zip(names.alias("loop_id"), F.col("_c").alias("closure")))).select("loop_id", *pixel, "closure")


def unwrap_errors(pixels: DataFrame, loops: DataFrame, network: Network, *pixel: str, d: str = "d") -> DataFrame:
    """(pixel, u): cycles of unwrapping error a pair, from loop closures; 0 on edges of the loops, not rounded.

    The closing pairs' errors explain the closures in the least-squares sense (of least norm where they are ambiguous).  A pixel that misses pairs uses
    the loops that it has and is null where those don't determine its errors.
    """
    c, closing = loop_arrays(loops, network)
    part = c[:, closing]
    inverse = np.linalg.pinv(part)

    def work(b: pa.RecordBatch) -> list[np.ndarray]:
        values = _rows(b, d, len(network.pairs))
        u = np.zeros_like(values)
        gone = np.isnan(values).any(0)
        if len(c):
            close = np.stack([(row[row != 0] @ values[row != 0]) for row in c])
            u[closing] = inverse @ np.where(gone, 0, close) / (2 * np.pi)
            if gone.any():
                u[np.ix_(np.flatnonzero(closing), np.flatnonzero(gone))] = solve(part, close[:, gone]) / (2 * np.pi)
        return [u]

    return _per_batch(pixels, pixel, ("u",), work, 4 * len(c) + 6 * len(network.pairs))


def unwrap_corrected(pixels: DataFrame, errors: DataFrame, *pixel: str, d: str = "d") -> DataFrame:
    """Pair values less whole cycles of error."""
    both = pixels.join(errors, list(pixel))
    fixed = F.zip_with(F.col(d), F.col("u"), lambda v, u: v - 2 * np.pi * F.rint(u))
    return both.select(*pixel, fixed.alias(d))
