"""Quality by Bradley-Terry pairwise ranking.

Every text gets ``len(NAMES)`` measures of its whole text (shares of repeated words and lines, capitals, symbols, digits, ...).
Every labelled row outside the fold is learned from, and every pair of a label-1 row and a label-0 row is a preference: the
weights minimise the mean logistic loss over all these pairs, on differences of the measures and of hinges at their quantiles.
The threshold leaves as many labelled rows below it as there are of label 0 (fewer only by ties).  The score is a logistic curve
of the ranking score that is 0.3 at the threshold, with its slope fitted to the labels.

The labelled rows' measures are a table that is passed over again and again; only sums come to the driver.  Quantiles and
threshold are exact.  Sums over pairs need no pairs: ranking scores are cut into cells, and each row is laid on the Chebyshev
nodes of its cell.  The loss is so smooth that a polynomial through the nodes gives it to about 1e-10 within a cell, so pairs of
nodes, weighted, give what all pairs of rows would.

Null and empty texts have measures of 0 and are scored by them.  Without labelled rows of both kinds the score is the rate of
label 1 among the labels (0 without labels).  Several labels of one document: the lowest counts, for each of its rows.  Repeated
rows get equal results, and what is learned is rounded, so that it doesn't hang on the order of sums.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.polynomial.chebyshev import chebvander
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import crc_mod
from .shared import discard, materialize
from .textkit import Words, row_slices, string_buffers

THRESHOLD = 0.3
#: Tasks of a pass over the labelled rows (each sends its sums to the driver), and parts that a pass of a quantile cuts the values into.
TASKS, PARTS = 64, 256
#: Width of a cell of ranking scores, and Chebyshev nodes in it.
WIDTH, ORDER = 4.0, 20
QUANTILES = (0.03, 0.1, 0.5, 0.9, 0.97)
RIDGE = 1e-3
#: Bounds of the logistic curve's slope.
SLOPES = (0.05, 20.0)
NAMES = ("log_words", "distinct", "repeats", "top_word", "capitals", "symbols", "digits", "word_length", "symbol_runs", "symbol_words", "bars", "line_length", "repeated_lines", "stops", "high", "long_words")

_B = np.arange(256)
_UPPER, _LOWER = (_B >= 65) & (_B <= 90), (_B >= 97) & (_B <= 122)
_DIGIT, _HIGH = (_B >= 48) & (_B <= 57), _B >= 128
_MARK = (_B > 32) & (_B < 127) & ~(_UPPER | _LOWER | _DIGIT) & ~np.isin(_B, list(b".,'-:;()\"?"))
_STOP = np.isin(_B, list(b".?:;"))


def measures(column: pa.Array) -> np.ndarray:
    """(rows, measures) of a string column."""
    raw, offs = string_buffers(column)
    out = np.zeros((len(offs) - 1, len(NAMES)))
    for lo, hi in row_slices(offs):
        at, n = offs[lo : hi + 1] - offs[lo], hi - lo
        words = Words(raw, offs[lo : hi + 1])
        seg = words.raw
        if not len(words.starts):
            continue

        def per_row(flag: np.ndarray, at=at) -> np.ndarray:
            s = np.concatenate([[0], np.cumsum(flag)])
            return np.diff(s[at]).astype(float)

        count, size = words.counts.astype(float), np.maximum(np.diff(at).astype(float), 1)
        some = np.maximum(count, 1)
        length = words.ends - words.starts
        order = np.lexsort((words.hash, words.row))
        h, r = words.hash[order], words.row[order]
        cut = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])]))
        runs = np.diff(np.append(cut, len(h)))
        top = np.zeros(n)
        np.maximum.at(top, r[cut], runs)
        same = (words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])
        upper, mark = _UPPER[seg], _MARK[seg]
        letters = np.maximum(per_row(upper | _LOWER[seg] | _HIGH[seg]), 1)
        double = np.zeros(len(seg), bool)
        double[1:] = mark[1:] & (seg[1:] == seg[:-1])
        lines = per_row(seg == 10) + 1
        f = out[lo:hi]
        f[:, 0] = np.log1p(count)
        f[:, 1] = np.bincount(r[cut], minlength=n) / some
        f[:, 2] = np.bincount(words.row[1:][same], minlength=n) / some
        f[:, 3] = top / some
        f[:, 4] = per_row(upper) / letters
        f[:, 5] = per_row(mark) / size
        f[:, 6] = per_row(_DIGIT[seg]) / size
        f[:, 7] = np.bincount(words.row, length, n) / some / 10
        f[:, 8] = per_row(double) / some
        f[:, 9] = np.bincount(words.row[mark[words.ends - 1]], minlength=n) / some
        f[:, 10] = per_row(seg == 124) / some
        f[:, 11] = np.log1p(count / lines)
        f[:, 12] = _repeated_lines(seg, at, words)
        f[:, 13] = per_row(_STOP[seg]) / some
        f[:, 14] = per_row(_HIGH[seg]) / size
        f[:, 15] = np.bincount(words.row[length > 20], minlength=n) / some
    return out


def _repeated_lines(seg: np.ndarray, at: np.ndarray, words: Words) -> np.ndarray:
    """Share of words in lines that equal an earlier line of the text."""
    line = np.cumsum(seg == 10)[words.starts] + words.row * 1
    key = words.row.astype(np.int64) << 32 | line
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    place = np.arange(len(key)) - np.repeat(cut, np.diff(np.append(cut, len(key))))
    hashes = np.add.reduceat(words.hash * (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)), cut)
    width, row = np.diff(np.append(cut, len(key))), words.row[cut]
    order = np.lexsort((hashes, row))
    again = np.zeros(len(cut), bool)
    again[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    return np.bincount(row[again], width[again], words.n_rows) / np.maximum(words.counts, 1)


@dataclass
class QualityModel:
    knots: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float
    rate: float

    def expand(self, f: np.ndarray) -> np.ndarray:
        return np.hstack([f, *(np.maximum(f - k, 0) for k in self.knots)])

    def standard(self, f: np.ndarray) -> np.ndarray:
        return np.clip((self.expand(f) - self.mean) / self.scale, -8, 8)

    def rank(self, f: np.ndarray) -> np.ndarray:
        return _dot(self.standard(f), self.weights)

    def score(self, f: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(f), self.rate)
        z = self.slope * (self.rank(f) - self.threshold) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _dot(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w, summed row by row, so that a row's result is the same in every batch."""
    return (x * w).sum(axis=1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _lists(f: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1, dtype=np.int32) * f.shape[1]), pa.array(f.reshape(-1)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def measured(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, ``f`` (its measures)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(measures(b.column(1)))], names=["doc_id", "f"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, f array<double>")


Batches = Iterable[tuple[np.ndarray, np.ndarray]]


def _passed(table: DataFrame, step: Callable[[Batches], object]) -> list:
    """What ``step`` makes of every task's batches (labels, measures) of the labelled rows, in the order of the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = step((b.column(0).to_numpy(zero_copy_only=False), _matrix(b.column(1))) for b in batches if b.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([pickle.dumps(found)], pa.binary())], names=["task", "found"])

    rows = table.select("label", "f").coalesce(TASKS).mapInArrow(run, "task int, found binary").toArrow().sort_by("task")
    return [pickle.loads(x.as_py()) for x in rows["found"]] or [step(())]  # a table without rows has no tasks


def _extent(table: DataFrame, values: Callable[[np.ndarray], np.ndarray], columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of label 0 and 1, least and greatest value of each column of ``values(f)``."""

    def step(batches: Batches) -> tuple:
        count, low, high = np.zeros(2, np.int64), np.full(columns, np.inf), np.full(columns, -np.inf)
        for y, f in batches:
            v = values(f)
            count += np.bincount(y, minlength=2)
            low, high = np.minimum(low, v.min(0)), np.maximum(high, v.max(0))
        return count, low, high

    count, low, high = zip(*_passed(table, step), strict=True)
    return np.sum(count, axis=0), np.min(low, axis=0), np.max(high, axis=0)


def _at_ranks(table: DataFrame, values: Callable[[np.ndarray], np.ndarray], low: np.ndarray, high: np.ndarray, ranks: list[int]) -> np.ndarray:
    """(ranks, columns): the exact values at ``ranks`` (from 0) of each column of ``values(f)`` over all rows.

    Every pass counts the values of ``PARTS`` parts of the range that a wanted value is known to lie in, and goes on with the part that holds
    it, from its least to its greatest value, until both are the same.
    """
    wanted = [(c, r) for r in range(len(ranks)) for c in range(len(low))]
    lo, hi = np.tile(low, len(ranks)), np.tile(high, len(ranks))
    left = np.repeat(np.array(ranks, np.int64), len(low))
    while (lo < hi).any():
        still = np.flatnonzero(lo < hi)

        def step(batches: Batches, still=still, lo=lo.copy(), hi=hi.copy()) -> tuple:
            count, least, most = np.zeros((len(still), PARTS), np.int64), np.full((len(still), PARTS), np.inf), np.full((len(still), PARTS), -np.inf)
            for _, f in batches:
                v = values(f)
                for k, t in enumerate(still):
                    x = v[:, wanted[t][0]]
                    x = x[(x >= lo[t]) & (x <= hi[t])]
                    part = np.minimum(((x - lo[t]) / (hi[t] - lo[t]) * PARTS).astype(np.int64), PARTS - 1)
                    count[k] += np.bincount(part, minlength=PARTS)
                    np.minimum.at(least[k], part, x)
                    np.maximum.at(most[k], part, x)
            return count, least, most

        count, least, most = zip(*_passed(table, step), strict=True)
        count, least, most = np.sum(count, axis=0), np.min(least, axis=0), np.max(most, axis=0)
        for k, t in enumerate(still):
            upto = np.cumsum(count[k])
            part = int(np.searchsorted(upto, left[t], side="right"))
            left[t] -= upto[part] - count[k, part]
            lo[t], hi[t] = least[k, part], most[k, part]
    return lo.reshape(len(ranks), len(low))


_NODES = np.cos((np.arange(ORDER) + 0.5) * np.pi / ORDER)
_LAGRANGE = chebvander(_NODES, ORDER - 1).T * np.where(np.arange(ORDER) > 0, 2, 1)[:, None] / ORDER


def _laid(s: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each ranking score, and its masses on the cell's nodes (a polynomial's value at the score is theirs times its values at the nodes)."""
    cell = np.floor(s / width)
    return cell.astype(np.int64), chebvander(np.clip((s / width - cell) * 2 - 1, -1, 1), ORDER - 1) @ _LAGRANGE


def _nodes(table: DataFrame, model: QualityModel, width: float, vectors: bool) -> dict[int, dict[int, np.ndarray]]:
    """By label and cell of ranking scores: per node the mass of the rows, and with ``vectors`` the sum of their standardised measures."""

    def step(batches: Batches) -> dict:
        found: dict = {}
        for y, f in batches:
            x = model.standard(f)
            cell, mass = _laid(_dot(x, model.weights), width)
            x = np.hstack([np.ones((len(x), 1)), x]) if vectors else np.ones((len(x), 1))
            order = np.lexsort((cell, y))
            for part in np.split(order, np.flatnonzero((np.diff(cell[order]) != 0) | (np.diff(y[order]) != 0)) + 1):
                key = int(y[part[0]]), int(cell[part[0]])
                found[key] = found.get(key, 0) + mass[part].T @ x[part]
        return found

    total: dict = {0: {}, 1: {}}
    for found in _passed(table, step):
        for (y, cell), sums in found.items():
            total[y][cell] = total[y].get(cell, 0) + sums
    return total


def _places(cells: Iterable[int], width: float) -> np.ndarray:
    """(cells, nodes): the ranking scores of the nodes."""
    return (np.array(list(cells), float)[:, None] + (_NODES + 1) / 2) * width


class _Pairs:
    """Mean logistic loss over all pairs at some weights, its gradient, and what its second derivatives need of the pairs."""

    def __init__(self, table: DataFrame, model: QualityModel, counts: np.ndarray):
        found, pairs = _nodes(table, model, WIDTH, True), float(counts[0]) * float(counts[1])
        z = _places(found[0], WIDTH).reshape(-1)
        bad = np.concatenate(list(found[0].values()))
        width = len(model.weights)
        self.loss, gradient, self.cross, curve = 0.0, np.zeros(width), np.zeros((width, width)), np.zeros(len(z))
        push = np.zeros(len(z))
        self.curves: dict = {0: {}, 1: {}}
        for (cell, good), at in zip(found[1].items(), _places(found[1], WIDTH), strict=True):
            lead = at[:, None] - z
            p = _sigmoid(-lead)
            self.loss += good[:, 0] @ np.logaddexp(0, -lead) @ bad[:, 0] / pairs
            gradient -= good[:, 1:].T @ (p @ bad[:, 0])
            push += good[:, 0] @ p
            p *= 1 - p
            self.curves[1][cell] = p @ bad[:, 0] / pairs
            curve += good[:, 0] @ p / pairs
            self.cross += good[:, 1:].T @ (p @ bad[:, 1:]) / pairs
        self.gradient = (gradient + bad[:, 1:].T @ push) / pairs + RIDGE * model.weights
        self.loss += RIDGE / 2 * model.weights @ model.weights
        self.curves[0] = dict(zip(found[0], curve.reshape(-1, ORDER), strict=True))

    def hessian(self, table: DataFrame, model: QualityModel) -> np.ndarray:
        curves, width = self.curves, len(model.weights)

        def step(batches: Batches) -> np.ndarray:
            found = np.zeros((width, width))
            for y, f in batches:
                x = model.standard(f)
                cell, mass = _laid(_dot(x, model.weights), WIDTH)
                keys, back = np.unique(np.stack([y, cell], axis=1), axis=0, return_inverse=True)
                weight = (mass * np.array([curves[a][b] for a, b in keys.tolist()])[back.reshape(-1)]).sum(axis=1)
                found += (x * np.maximum(weight, 0)[:, None]).T @ x
            return found

        return np.sum(_passed(table, step), axis=0) - self.cross - self.cross.T + RIDGE * np.eye(width)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", fold: tuple[int, int] = (5, 0)) -> QualityModel:
    """Learns from every row of ``docs`` whose id ``labels`` (doc_id, label) holds outside the fold."""
    return fit_measured(measured(docs), labels, label, fold)


def fit_measured(rows: DataFrame, labels: DataFrame, label: str = "quality", fold: tuple[int, int] = (5, 0)) -> QualityModel:
    """``fit`` on the rows of ``measured``."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter((crc_mod("doc_id", fold[0]) != fold[1]) & F.col("label").isin(0, 1))
    table = materialize(rows.join(known.groupBy("doc_id").agg(F.min("label").alias("label")), "doc_id").select("label", "f"), "quality-rows")
    try:
        return _learn(table, known)
    finally:
        discard(table)


def _learn(table: DataFrame, known: DataFrame) -> QualityModel:
    counts, low, high = _extent(table, lambda f: f, len(NAMES))
    n = int(counts.sum())
    model = QualityModel(np.zeros((0, len(NAMES))), np.zeros(0), np.ones(0), np.zeros(0), 0.0, 1.0, 0.0)
    if not counts.all():
        said = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
        model.rate = said.get(1, 0) / max(1, sum(said.values()))
        return model
    model.rate = float(counts[1] / n)
    model.knots = _at_ranks(table, lambda f: f, low, high, [int(q * (n - 1)) for q in QUANTILES])
    centre = model.expand(model.knots[len(QUANTILES) // 2][None])  # sums of squares about the medians: a constant measure has a deviation of 0

    def step(batches: Batches) -> np.ndarray:
        found = np.zeros((2, centre.shape[1]))
        for _, f in batches:
            x = model.expand(f) - centre
            found += np.stack([x.sum(0), (x * x).sum(0)])
        return found

    first, second = np.sum(_passed(table, step), axis=0) / n
    model.mean, model.scale = np.round(centre[0] + first, 12), np.round(np.sqrt(np.maximum(second - first * first, 0)) + 1e-6, 12)
    model.weights = np.zeros(len(model.mean))
    at = _Pairs(table, model, counts)
    for _ in range(50):  # Newton on the mean logistic loss over all pairs, with a small ridge
        move, old = np.linalg.solve(at.hessian(table, model), at.gradient), (model.weights, at)
        model.weights = old[0] - move
        if np.abs(move).max() < 1e-6:
            break
        at = _Pairs(table, model, counts)
        while at.loss > old[1].loss + 1e-12 and np.abs(move).max() > 1e-6:
            move = move / 2
            model.weights = old[0] - move
            at = _Pairs(table, model, counts)
    model.weights = np.round(model.weights, 6)

    def ranking(f: np.ndarray) -> np.ndarray:
        return model.rank(f)[:, None]

    _, low, high = _extent(table, ranking, 1)
    model.threshold = float(_at_ranks(table, ranking, low, high, [int(counts[0]) - 1, int(counts[0])]).mean())
    # the steepest curve is as smooth over a cell that is narrower by its slope as the loss is over a whole one
    found = _nodes(table, model, WIDTH / SLOPES[1], False)
    z = np.concatenate([_places(found[y], WIDTH / SLOPES[1]).reshape(-1) for y in (0, 1)]) - model.threshold
    mass = [np.concatenate(list(found[y].values()))[:, 0] for y in (0, 1)]
    y, mass = np.repeat([0.0, 1.0], [len(m) for m in mass]), np.concatenate(mass)
    flat, steep = SLOPES
    for _ in range(50):  # the slope alone: the loss is convex in it, so its derivative has one root
        model.slope = (flat + steep) / 2
        p = _sigmoid(model.slope * z + np.log(THRESHOLD / (1 - THRESHOLD)))
        flat, steep = (flat, model.slope) if (mass * z * (p - y)).sum() > 0 else (model.slope, steep)
    model.slope = round(model.slope, 6)
    return model


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """Per row: doc_id, score, ranking (the Bradley-Terry score)."""
    return score_measured(measured(docs), model)


def score_measured(rows: DataFrame, model: QualityModel) -> DataFrame:
    """``score`` on the rows of ``measured``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = _matrix(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(f)), pa.array(model.rank(f) if len(model.weights) else np.zeros(len(f)))], names=["doc_id", "score", "ranking"])

    return rows.select("doc_id", "f").mapInArrow(run, "doc_id long, score double, ranking double")
