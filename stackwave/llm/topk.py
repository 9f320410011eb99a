"""Exact top-k inner products with multi-resolution segment statistics.

Components x become floor(1024 * x).  A vector is cut into equal segments at several resolutions; each segment keeps its mean
and its deviation.  For a segment of length l, by Cauchy-Schwarz, the inner product of two segments is at most
l * (mean * mean + deviation * deviation); with the vectors' own lengths this is a lower bound of their distance, since
|q - v|^2 = |q|^2 + |v|^2 - 2 q.v.  Bounds are taken from coarse to fine against the k-th best score so far, and only the survivors
of the finest one are scored exactly, in integers.

Vectors are dealt out by the signs of their finest segment means, which puts like ones together, and packed in chunks of ``CHUNK`` with the range of each
segment's mean and the largest deviation; a chunk's bound for a query follows from these.  Queries are packed in blocks of ``QUERIES``.  Each block
first meets the ``NEAREST`` chunks with the highest bounds, which gives every query its k-th best score so far, and then only the chunks whose
bound reaches that for one of its queries.  The chunks' bounds are a few hundred bytes each and go to the tasks while they fit ``BOUND_BYTES``; beyond that
every block meets every chunk.  So no task holds more than a chunk, a block and the bounds, and no vectors are broadcast or collected.  A chunk gives at most
k rows a query; a window merges them.

Vectors that are null or hold null or non-finite components, and rows with a null id, take no part.  Vectors of other lengths than the query's
are not compared with it.  Ties go to the smaller id.  Rows that repeat the query's id are its own; other repeated rows each count.
Scores are exact as long as they fit a long (components of up to 2**20 and beyond for usual lengths).  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

QUERIES, CHUNK, K, SCALE, NEAREST, BOUND_BYTES = 256, 8192, 10, 1024, 4, 64 << 20
_PACK = "part long, width int, kind string, ids binary, data binary, bounds binary"


def _vectors(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, integer matrix) of a batch of (vec_id, embedding) for each length; vectors with null or non-finite components are left out."""
    vectors = b.column(1)
    ids, lengths = b.column(0).to_numpy(), vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    for width in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == width)
        x = vectors.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)  # a null is a nan here
        fine = np.isfinite(x).all(1)
        if fine.any():
            yield ids[rows][fine].astype(np.int64), np.floor(x[fine] * SCALE).astype(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, vec_id, embedding): the signs of the finest segment means less those of all components, coarse to fine."""
    for b in batches:
        key = np.zeros(b.num_rows, np.int64)
        lengths = b.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        for width in np.unique(lengths[lengths > 0]).tolist():
            rows = np.flatnonzero(lengths == width)
            x = np.nan_to_num(b.column(1).take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width), posinf=0, neginf=0)
            parts = [_statistics(x, n)[:, :n] for n in _levels(width)]
            bits = np.hstack([parts[0] > 0, *(p > p.mean(1, keepdims=True) for p in parts[1:])])
            key[rows] = (bits * (np.int64(1) << np.arange(bits.shape[1], dtype=np.int64)[::-1])).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0), b.column(1)], names=["key", "vec_id", "embedding"])


def _packed(size: int):
    """Arrow batches of (vec_id, embedding) to rows of up to ``size`` vectors of one length, with their bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, count = TaskContext.get().partitionId(), {}, 0

        def flush(width: int, all_of_it: bool) -> Iterator[pa.RecordBatch]:
            nonlocal count
            ids, data = (np.concatenate(x) for x in held.pop(width))
            for k in range(0, len(ids), size):
                some = slice(k, k + size)
                if len(ids) - k < size and not all_of_it:
                    held[width] = ([ids[some]], [data[some]])
                    break
                kind = "<i4" if np.abs(data[some]).max() < 2**31 else "<i8"
                levels = _levels(width)[-1]
                stats = _statistics(data[some].astype(float), levels)
                bounds = np.concatenate([stats[:, :levels].min(0), stats[:, :levels].max(0), stats[:, levels:].max(0)])
                yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + count], pa.int64()), pa.array([width], pa.int32()), pa.array([kind]), pa.array([ids[some].tobytes()], pa.binary()), pa.array([data[some].astype(kind).tobytes()], pa.binary()), pa.array([bounds.tobytes()], pa.binary())], names=["part", "width", "kind", "ids", "data", "bounds"])
                count += 1

        for b in batches:
            for ids, data in _vectors(b):
                width = data.shape[1]
                own = held.setdefault(width, ([], []))
                own[0].append(ids)
                own[1].append(data)
                if sum(map(len, own[0])) >= size:
                    yield from flush(width, False)
        for width in list(held):
            yield from flush(width, True)

    return run


def _levels(width: int) -> list[int]:
    """Numbers of segments, coarse to fine."""
    return [s for s in (1, 4, 16) if s < width] or [1]


def _statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """(rows, 2 * segments): means and deviations times the square root of the segments' lengths."""
    cuts = np.linspace(0, x.shape[1], segments + 1).astype(int)
    size = np.diff(cuts)
    mean = np.add.reduceat(x, cuts[:-1], axis=1) / size
    square = np.add.reduceat(x * x, cuts[:-1], axis=1) / size
    return np.hstack([mean, np.sqrt(np.maximum(square - mean * mean, 0))]) * np.sqrt(np.concatenate([size, size]))


def best(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int = K, floors: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of the k best vectors of a chunk for each query of a block (integer matrices); those under a query's floor may be left out."""
    q, v = queries.astype(float), vectors.astype(float)
    exact = np.abs(q).max(initial=1) * np.abs(v).max(initial=1) * q.shape[1] < 2**52
    levels = [(_statistics(q, s), _statistics(v, s)) for s in _levels(q.shape[1])]
    coarse = levels[0][0] @ levels[0][1].T
    slack = 1e-9 * np.sqrt((q * q).sum(1).max(initial=0) * (v * v).sum(1).max(initial=0)) + 1e-6

    def scores(x: int, rows: np.ndarray) -> np.ndarray:
        return np.rint(v[rows] @ q[x]).astype(np.int64) if exact else vectors[rows] @ queries[x]

    for x in range(len(q)):
        bound = coarse[x]
        least = -np.inf if floors is None else floors[x] - slack
        rest = np.flatnonzero((ids != own[x]) & (bound >= least))
        if len(rest) > 4 * k:  # a first guess of the k-th best
            first = rest[np.argpartition(bound[rest], -4 * k)[-4 * k :]]
            least = max(least, np.partition(scores(x, first), -k)[-k] - slack)
            rest = rest[bound[rest] >= least]
            for a, b in levels[1:]:
                if len(rest) <= 8 * k:
                    break
                finer = b[rest] @ a[x]
                top = rest[np.argpartition(finer, -2 * k)[-2 * k :]]
                least = max(least, np.partition(scores(x, top), -k)[-k] - slack)
                rest = rest[finer >= least]
        s = scores(x, rest)
        order = np.lexsort((ids[rest], -s))[:k]
        yield x, ids[rest][order], s[order]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = (b.column(n).to_pylist() for n in ("block", "width", "kind", "ids", "data", "own", "queries", "query_kind", "floors"))
            for block, width, kind, ids, data, own, queries, query_kind, floors in zip(*columns, strict=True):
                ids, own = np.frombuffer(ids, np.int64), np.frombuffer(own, np.int64)
                q, v = (np.frombuffer(x, t).reshape(-1, width).astype(np.int64) for x, t in ((queries, query_kind), (data, kind)))
                found = list(best(q, own, v, ids, k, None if floors is None else np.frombuffer(floors)))
                if found:
                    size = [len(f[1]) for f in found]
                    yield pa.RecordBatch.from_arrays([pa.array([block] * sum(size), pa.int64()), pa.array(np.repeat(own, size)), pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]))], names=["block", "query_id", "vec_id", "score"])

    return run


def _bounds_of(queries: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(queries, chunks): no vector of a chunk has a higher score with a query."""
    levels = bounds.shape[1] // 3
    stats = _statistics(queries.astype(float), levels)
    mean, deviation = stats[:, :levels], stats[:, levels:]
    low, high, most = bounds[:, :levels], bounds[:, levels : 2 * levels], bounds[:, 2 * levels :]
    out = np.maximum(mean, 0) @ high.T + np.minimum(mean, 0) @ low.T + deviation @ most.T
    return out + 1e-9 * np.abs(out) + 1e-6


def _routes(chunks: dict[int, tuple[np.ndarray, np.ndarray]], again: bool):
    """Adds to every block the chunks it meets: at first the ``NEAREST`` ones, then (``again``) the others that reach a query's k-th best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            routes, floors = [], []
            for width, kind, own, queries, known in zip(*(b.column(n).to_pylist() for n in ("width", "query_kind", "own", "queries", "known")), strict=True):
                parts, bounds = chunks.get(width, (np.zeros(0, np.int64), np.zeros((0, 3))))
                reach = _bounds_of(np.frombuffer(queries, kind).reshape(-1, width).astype(np.int64), bounds)
                near = np.argsort(-reach.max(0, initial=-np.inf), kind="stable")[:NEAREST]
                if again:
                    least = dict((x["query_id"], x["least"]) for x in known or [])
                    floor = np.array([least.get(q, -np.inf) for q in np.frombuffer(own, np.int64).tolist()], float)
                    meets = (reach >= floor[:, None]).any(0)
                    meets[near] = False
                    routes.append(parts[meets].tolist())
                    floors.append(floor.tobytes())
                else:
                    routes.append(parts[near].tolist())
                    floors.append(None)
            names = ["block", "width", "query_kind", "own", "queries"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(routes, pa.list_(pa.int64())), pa.array(floors, pa.binary())], names=[*names, "parts", "floors"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each row of ``queries`` with rows of ``vectors``."""

    def packed(df: DataFrame, size: int, name: str) -> DataFrame:
        rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding")).filter("vec_id is not null and embedding is not null")
        kind = dict(rows.dtypes)["embedding"]
        keyed = rows.mapInArrow(_signed, f"key long, vec_id long, embedding {kind}")
        dealt = keyed.repartitionByRange(max(1, -(-df.count() // size)), "key", "vec_id").sortWithinPartitions("key", "vec_id")
        return materialize(dealt.select("vec_id", "embedding").mapInArrow(_packed(size), _PACK), name)

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    chunks = packed(vectors, CHUNK, "chunks")
    blocks = packed(queries, QUERIES, "blocks").select(F.col("part").alias("block"), "width", F.col("kind").alias("query_kind"), F.col("ids").alias("own"), F.col("data").alias("queries"))
    kind = "block long, width int, query_kind string, own binary, queries binary, parts array<long>, floors binary"

    def searched(routed: DataFrame) -> DataFrame:
        met = routed.withColumn("part", F.explode("parts")).drop("parts").hint("shuffle_hash")
        return chunks.drop("bounds").join(met, ["part", "width"]).select("block", "width", "kind", "ids", "data", "own", "queries", "query_kind", "floors").mapInArrow(_search(k), "block long, query_id long, vec_id long, score long")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)

    size = chunks.agg(F.sum(F.octet_length("bounds"))).first()[0] or 0
    if size > BOUND_BYTES:
        every = blocks.join(chunks.groupBy("width").agg(F.collect_list("part").alias("parts")), "width").withColumn("floors", F.lit(None).cast("binary"))  # a number a chunk
        found = searched(every)
    else:
        known: dict[int, list] = {}
        for r in chunks.select("part", "width", "bounds").orderBy("part").collect():  # at most BOUND_BYTES
            known.setdefault(r["width"], []).append((r["part"], np.frombuffer(r["bounds"])))
        table = {w: (np.array([p for p, _ in x]), np.stack([b for _, b in x])) for w, x in known.items()}
        first = materialize(ranked(searched(blocks.withColumn("known", F.lit(None).cast("array<struct<query_id:long,least:long>>")).mapInArrow(_routes(table, False), kind))).drop("rank"), "nearest")
        least = first.groupBy("block", "query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).filter(F.col("n") == k)
        least = least.groupBy("block").agg(F.collect_list(F.struct("query_id", "least")).alias("known"))  # at most a block's queries
        found = first.union(searched(blocks.join(least, "block", "left").mapInArrow(_routes(table, True), kind)))
    return ranked(found).select("query_id", "rank", "vec_id", "score")
