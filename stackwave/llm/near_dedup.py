"""MinHash near-dedup with HyperMinHash sketches.

A document is the set of its distinct ``SHINGLE``-word shingles (64-bit hashes).  A sketch has 128 buckets; a bucket
keeps, of the smallest hash that falls into it, the number of leading zeros (6 bits) and the 10 bits after the first one.
Empty buckets of short documents copy a bucket chosen by a fixed sequence (densification), so that a bucket of two
documents agrees with the probability of their similarity whatever their lengths.

1. Equal sets become one class (hash aggregation, copies combine before the shuffle).  A class is a node of its own, whatever ids its rows have.
2. Every class that can be like another one emits 32 bands of 4 compressed registers.  All 32 bands miss with probability 5e-11 at similarity 0.85,
   5e-8 at 0.8.
3. Classes that share a band are compared by the collision-corrected estimate, inside the task that has the band.  The task emits a spanning
   forest, not all pairs.
4. The components of that candidate graph are read again as texts, one a class, and within each the links are confirmed on the full sets.
5. The components of the confirmed links are the result.

A group (a band, or a candidate component) of more than ``BLOCK`` classes or ``BLOCK_SHINGLES`` shingles is dealt out in blocks, and about ``CENTRES``
of its classes go to every block: each row travels once, and what is like each other mostly hangs together after that.  Only where a group
still falls into several parts, the rows outside its largest part are compared, in pairs of blocks, with each other and with the largest
part, but for pairs within one part; so no link between parts is lost and no task gets an unbounded group.

Null or empty texts and texts of white space only have an empty set and are linked with nothing.  Repeated rows are
copies of each other; rows that repeat a doc_id with another text are compared by their own text.  Rows whose doc_id is null are compared like
any other; their component_id is the least id in reach, null without one, and they are kept only without one (``unique`` keeps one row of such
a component).  An empty table gives an empty one; further columns are not read by ``near_duplicates`` and kept by ``unique``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import by_group, discard, fresh, materialize, maybe_broadcast
from .textkit import mix64, shingle_sets

SHINGLE = 5
BUCKETS, BANDS, MANTISSA = 128, 32, 10
ROWS_A_BAND = BUCKETS // BANDS
#: Least similarity, in hundredths, of two documents that are linked.
THRESHOLD = 85
#: A group of more classes (or, for full sets, of more shingles) than this is dealt out in blocks; classes of a group that go to all of its blocks.
BLOCK, BLOCK_SHINGLES, CENTRES = 128, 1 << 20, 16

_BITS = BUCKETS.bit_length() - 1
_TURNS = (mix64(np.arange(BUCKETS * BUCKETS, dtype=np.uint64) + np.uint64(77)).reshape(BUCKETS, BUCKETS)).argsort(1)
_EDGES = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - _BITS)
_SALTS = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The 128 registers (uint16) of a non-empty sorted set of hashes."""
    at = np.searchsorted(hashes, _EDGES)
    full = at < len(hashes)
    first = hashes[np.minimum(at, len(hashes) - 1)]
    full &= (first >> np.uint64(64 - _BITS)) == np.arange(BUCKETS, dtype=np.uint64)
    mantissa, exponent = np.frexp((first << np.uint64(_BITS)).astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 62)
    bits = np.minimum((mantissa * 2 - 1) * (1 << MANTISSA), (1 << MANTISSA) - 1).clip(0).astype(np.int64)
    registers = ((zeros << MANTISSA) | bits).astype(np.uint16)
    if not full.all():
        empty = np.flatnonzero(~full)
        turns = _TURNS[empty]
        registers[empty] = registers[turns[np.arange(len(empty)), full[turns].argmax(1)]]
    return registers


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """(n, 32) keys of n sketches: the four registers of a band are 64 bits."""
    return mix64(np.ascontiguousarray(sketches).view(np.uint64).reshape(-1, BANDS) + _SALTS)


def estimates(one: np.ndarray, size: np.ndarray | int, many: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Jaccard estimates of sketches against others, row by row, less the registers expected to agree by chance."""
    agree = (many == one).mean(1)
    ratio = size / sizes
    chance = 0.169919487 * 4 * ratio / (1 + ratio) ** 2 / (1 << MANTISSA)
    return (agree - chance) / (1 - chance)


def least_estimate(threshold: int) -> float:
    """An estimate below this is no candidate: the threshold less six standard deviations of the estimate; 0.66 for 85."""
    j = threshold / 100
    return round(j - 6 * (j * (1 - j) / BUCKETS) ** 0.5, 2)


def _near(one: int, others: np.ndarray, sketches: np.ndarray, sizes: np.ndarray, threshold: int) -> np.ndarray:
    """Those of ``others`` that pass the size filter and the estimate against row ``one``."""
    n, m = sizes[one], sizes[others]
    others = others[100 * np.minimum(n, m) >= threshold * np.maximum(n, m)]
    return others[estimates(sketches[one], n, sketches[others], sizes[others]) >= least_estimate(threshold)] if len(others) else others


def _forest(sketches: np.ndarray, sizes: np.ndarray, parts: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """A spanning forest of the rows' candidate graph, without links inside a part that hangs together already.

    A tree is a star around its first row, so that the groups' links are near to what the components make of them.
    """
    rest, out = np.arange(len(sizes)), []
    while len(rest) > 1:
        first, rest = int(rest[0]), rest[1:]
        queue = [first]
        while queue and len(rest):
            x = queue.pop()
            found = _near(x, rest[parts[rest] != parts[x]], sketches, sizes, threshold)
            out += [(first, int(y)) for y in found]
            found = rest[np.isin(parts[rest], np.append(parts[found], parts[x]))]  # and what hangs together with them
            queue += found.tolist()
            rest = np.setdiff1d(rest, found, True)
    return out


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, s1, s2, data = [], [], [], []
        for s in shingle_sets(batch.column(1), SHINGLE):
            n.append(len(s))
            s1.append(mix64(s).sum(dtype=np.uint64) if len(s) else np.uint64(0))
            s2.append(mix64(s ^ np.uint64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64) if len(s) else np.uint64(0))
            data.append(sketch(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(np.array(s1, np.uint64).view(np.int64)), pa.array(np.array(s2, np.uint64).view(np.int64)), pa.array(data, pa.binary())], names=["doc_id", "text_hash", "n_shingles", "s1", "s2", "sketch"])


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = band_keys(_matrix(batch.column(2))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), *(pa.array(np.repeat(batch.column(k).to_numpy(), BANDS)) for k in (0, 1))], names=["band", "node", "n_shingles"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def _links(pairs: list[tuple[int, int]], ids: np.ndarray) -> pa.RecordBatch:
    p = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(ids[p[:, 0]]), pa.array(ids[p[:, 1]])], names=["a", "b"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Tables of rows sorted by (g, node), each node once in a group, and the groups' bounds in them."""
    for table in by_group(batches, "g"):
        g, node = table["g"].to_numpy(), table["node"].to_numpy()
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (node[1:] != node[:-1])])
        if not new.all():
            table, g = table.filter(pa.array(new)).combine_chunks(), g[new]
        bounds = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]]))
        yield table, list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))


def _candidates(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (g, node, part, n_shingles, sketch): a spanning forest of the candidates of every group g."""
    for table, groups in _groups(batches):
        ids, parts, sizes = (table[c].to_numpy() for c in ("node", "part", "n_shingles"))
        sketches, out = _matrix(table["sketch"].combine_chunks()), []
        one = np.array([lo for lo, hi in groups if hi - lo == 2], np.int64)
        for x in range(0, len(one), 4096):  # the many groups of two at once
            a = one[x : x + 4096]
            n, m = sizes[a], sizes[a + 1]
            a = a[(parts[a] != parts[a + 1]) & (100 * np.minimum(n, m) >= threshold * np.maximum(n, m)) & (estimates(sketches[a], n, sketches[a + 1], m) >= least_estimate(threshold))]
            out += zip(a.tolist(), (a + 1).tolist(), strict=True)
        for lo, hi in groups:
            if hi - lo > 2:
                out += [(lo + a, lo + b) for a, b in _forest(sketches[lo:hi], sizes[lo:hi], parts[lo:hi], threshold)]
        if out:
            yield _links(out, ids)


def confirmed(sets: list[np.ndarray], threshold: int, parts: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links on full sets that connect what all links connect: 100 * intersection >= threshold * union.

    A row is compared with all rows not compared yet that pass size and estimate and aren't connected with it by now; rows of one part are
    connected from the start.  What comes out are stars around the first row of what is connected.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    label, out, rest = np.arange(n) if parts is None else np.unique(parts, return_inverse=True)[1], [], np.arange(n)
    if n == 2:
        both = len(np.intersect1d(*sets, assume_unique=True)) if label[0] != label[1] else 0
        return [(0, 1)] if both and 100 * both >= threshold * (sizes.sum() - both) else []
    sketches = np.stack([sketch(s) for s in sets])
    for x in range(n - 1):
        rest = rest[1:]
        others = rest[label[rest] != label[x]]
        if not len(others) or not len(others := _near(x, others, sketches, sizes, threshold)):
            continue
        joined = np.concatenate([sets[y] for y in others])
        mine = sets[x]
        hit = mine[np.minimum(np.searchsorted(mine, joined), len(mine) - 1)] == joined
        both = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(sizes[others])[:-1]]), dtype=np.int64)
        for y in others[100 * both >= threshold * (sizes[x] + sizes[others] - both)].tolist():
            if label[y] != label[x]:
                label[label == label[y]] = label[x]
                out.append((x, y))
    firsts: dict[int, int] = {}
    for y in sorted({y for link in out for y in link}):
        firsts.setdefault(int(label[y]), y)
    return [(firsts[int(label[y])], y) for y in sorted({y for link in out for y in link}) if firsts[int(label[y])] != y]


def _verify(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (g, node, part, text): confirmed links of every group g."""
    for table, groups in _groups(batches):
        ids, parts, out = table["node"].to_numpy(), table["part"].to_numpy(), []
        for lo, hi in groups:
            if hi - lo > 1:
                sets = list(shingle_sets(table["text"].slice(lo, hi - lo), SHINGLE))
                out += [(lo + a, lo + b) for a, b in confirmed(sets, threshold, parts[lo:hi])]
        if out:
            yield _links(out, ids)


def _first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each node in the partition; rows that repeat an id and a text are many of one node."""
    seen: set[int] = set()
    for b in batches:
        keep = []
        for node in b.column(0).to_pylist():
            keep.append(node not in seen)
            seen.add(node)
        yield b if all(keep) else b.filter(pa.array(keep, pa.bool_()))


def _upto(n) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), n - 1)


def _in_blocks(rows: DataFrame, key: str) -> DataFrame:
    """First round: every row of a group goes to its block, the centres to all blocks; ``g`` names the block and ``part`` is the node."""
    mine = F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks"))
    centre = F.pmod(F.xxhash64("node", F.lit(11)), F.col("blocks") * (BLOCK // CENTRES)) == 0
    parts = F.when(F.col("blocks") <= 1, F.array(F.xxhash64(key))).when(centre, F.transform(_upto(F.col("blocks")), lambda j: F.xxhash64(key, j))).otherwise(F.array(F.xxhash64(key, mine)))
    return rows.withColumns({"g": F.explode(parts), "part": F.col("node")})


def _parted(rows: DataFrame, key: str, found: DataFrame) -> DataFrame | None:
    """Rows of the groups of several blocks that ``found`` (node, component) leaves in several parts, with their part and the blocks of
    the largest part (``most``) and of the others together (``rest``); None when every such group hangs together.
    """
    rows = rows.filter("blocks > 1").join(found.select("node", F.col("component").alias("part")), "node", "left").withColumn("part", F.coalesce("part", "node"))
    sizes = rows.groupBy(key, "part").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    main = sizes.groupBy(key).agg(F.max(F.struct("n", "part", "s")).alias("m"), F.sum("n").alias("n"), F.sum("s").alias("s")).filter("n > m.n")
    count = f"ceil(greatest(%s / {BLOCK}, %s / {BLOCK_SHINGLES}))"
    main = materialize(main.selectExpr(key, "m.part main", count % ("m.n", "m.s") + " most", count % ("(n - m.n)", "(s - m.s)") + " rest"), "parts")
    if main.isEmpty():
        discard(main)
        return None
    return rows.join(maybe_broadcast(main, 32), key)


def _between_parts(rows: DataFrame, key: str) -> DataFrame:
    """Second round: rows outside the largest part go to pairs of blocks with each other and with the largest part's."""
    i, k = F.pmod(F.xxhash64("node", F.lit(5)), F.col("rest")), F.pmod(F.xxhash64("node", F.lit(5)), F.col("most"))
    outside = F.concat(F.transform(_upto(F.col("rest")), lambda j: F.xxhash64(key, F.lit(1), F.least(i, j), F.greatest(i, j))), F.transform(_upto(F.col("most")), lambda j: F.xxhash64(key, F.lit(2), i, j)))
    inside = F.transform(_upto(F.col("rest")), lambda j: F.xxhash64(key, F.lit(2), j, k))
    return rows.withColumn("g", F.explode(F.when(F.col("part") == F.col("main"), inside).otherwise(outside)))


def _connected(rows: DataFrame, key: str, columns: list[str], compare: Callable, threshold: int, fill: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, component) after both rounds over written rows (key, node, n_shingles, blocks); ``fill`` adds what is compared."""

    def compared(dealt: DataFrame) -> DataFrame:
        rows = dealt.select("g", "node", "part", *columns)
        return rows.repartition("g").sortWithinPartitions("g", "node").mapInArrow(partial(compare, threshold=threshold), "a long, b long")

    found = materialize(connected_components(compared(_in_blocks(fill(rows), key))), "found")
    if rows.filter("blocks > 1").isEmpty() or (parted := _parted(rows, key, found)) is None:
        return found
    links = compared(_between_parts(fill(parted), key)).union(found.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")))
    return materialize(connected_components(links), "found")


def _measured(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text).cast("string")).alias("text_hash"))


def _classes(docs: DataFrame, doc_id: str, text: str, threshold: int) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, text_hash, n_shingles, s1, s2), and the classes of several rows or with links.

    A class has s1, s2, n_shingles, ``top`` (the same for a component), component_id (its least id), and whether its first row stands for the
    component (``first``) with that row's ``row_id`` and ``row_hash``.
    """
    rows = _measured(docs, doc_id, text)
    sketched = materialize(rows.mapInArrow(_sketch_rows, "doc_id long, text_hash long, n_shingles long, s1 long, s2 long, sketch binary"), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_hash"))
    classes = sketched.filter("n_shingles > 0").groupBy("s1", "s2", "n_shingles").agg(first.alias("row"), F.count("*").alias("copies"), F.first("sketch").alias("sketch"))
    # the written table gives the numbers once and for all
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("node"), "s1", "s2", "n_shingles", F.col("row.doc_id").alias("row_id"), F.col("row.text_hash").alias("row_hash"), "copies", "sketch"), "classes")

    able = classes.filter(100 * F.col("n_shingles") >= threshold * (F.col("n_shingles") + 1))  # smaller sets aren't like any different one
    bands = able.select("node", "n_shingles", "sketch").mapInArrow(_band_rows, "band long, node long, n_shingles long")
    crowd = bands.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    members = materialize(bands.join(crowd, "band"), "members")
    clusters = _connected(members, "band", ["n_shingles", "sketch"], _candidates, threshold, lambda some: some.join(able.select("node", "sketch"), "node"))

    clustered = clusters.withColumnRenamed("component", "cluster").join(classes.select("node", "n_shingles", "row_id", "row_hash"), "node")
    sizes = clustered.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).alias("blocks"))
    placed = materialize(clustered.join(sizes, "cluster"), "placed", clusters.count())

    def with_texts(some: DataFrame) -> DataFrame:
        found = rows.join(maybe_broadcast(some, 64), rows["doc_id"].eqNullSafe(some["row_id"]) & (rows["text_hash"] == some["row_hash"]))
        found = found.select("node", *(c for c in some.columns if c not in ("node", "row_id", "row_hash")), "text")
        return found.mapInArrow(_first_rows, found.schema)

    found = _connected(placed, "cluster", ["text"], _verify, threshold, with_texts)
    discard(members, clusters, placed)

    some = classes.drop("sketch").join(found, "node", "left").filter("copies > 1 or component is not null").withColumn("top", F.coalesce("component", "node"))
    some = materialize(some.select("s1", "s2", "n_shingles", "top", "row_id", "row_hash"), "repeated")
    least = some.groupBy("top").agg(F.min(F.struct(F.col("row_id").isNull().alias("no"), "row_id", "row_hash")).alias("m")).select("top", F.col("m.row_id").alias("component_id"), F.col("m.row_hash").alias("least_hash"))
    out = some.join(least, "top")
    out = out.withColumn("first", F.col("row_id").eqNullSafe(F.col("component_id")) & (F.col("row_hash") == F.col("least_hash"))).drop("least_hash")
    return sketched, out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id).

    Documents whose similarity is ``threshold`` hundredths or more are linked.
    """
    sketched, some = _classes(docs, doc_id, text, threshold)
    key = ["s1", "s2", "n_shingles"]
    out = sketched.select("doc_id", *key).join(some.select(*key, "component_id", F.lit(True).alias("grouped")), key, "left")
    component = F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").eqNullSafe(component)).alias("kept"))


def unique(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one of each component stays: that of the least doc_id (null last).

    Rows go by id and text together, so another text under the same id stays.  Of rows that repeat both, the one with the least hash of all
    its columns stays.  Rows with an empty set all stay.
    """
    sketched, some = _classes(docs, doc_id, text, threshold)
    gone_id, gone_hash, again_id, again_hash, own_hash = (fresh(n, docs.columns) for n in ("gone_id", "gone_hash", "again_id", "again_hash", "own_hash"))
    rows = sketched.select("doc_id", "text_hash", "s1", "s2", "n_shingles").join(some, ["s1", "s2", "n_shingles"])
    rows = rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"), F.max(F.col("first") & F.col("row_id").eqNullSafe(F.col("doc_id")) & (F.col("row_hash") == F.col("text_hash"))).alias("stays"))
    rows = materialize(rows, "decided")
    gone = rows.filter("not stays").select(F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_hash))
    again = rows.filter("stays and n > 1").select(F.col("doc_id").alias(again_id), F.col("text_hash").alias(again_hash))
    own = docs.withColumn(own_hash, F.xxhash64(F.col(text).cast("string")))

    def same(other: DataFrame, i: str, h: str) -> Column:
        return F.col(doc_id).cast("long").eqNullSafe(other[i]) & (own[own_hash] == other[h])

    kept = own.join(maybe_broadcast(gone, 16), same(gone, gone_id, gone_hash), "left_anti")
    if not again.isEmpty():
        once = kept.join(maybe_broadcast(again, 16), same(again, again_id, again_hash), "left_semi")
        once = once.groupBy(F.col(doc_id).alias(again_id), own_hash).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(gone_id)).select(f"{gone_id}.*")
        kept = kept.join(maybe_broadcast(again, 16), same(again, again_id, again_hash), "left_anti").select(*docs.columns).union(once.select(*docs.columns))
    return kept.select(*docs.columns)
