"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is its weight's share of all sizes, at most ``MOST`` times its own size; what is cut off is shared out again by
weight.  Every row of the source is asked for target / size copies: the whole copies are given, the fraction is rounded.
Two rows with fractional copies are paired and, at random, mass (fraction times size) moves from one to the other until one
of them is integral; the sum of the taken sizes stays the same.  This goes on in groups of at most about ``GROUP`` rows of a
source; the one row that is left over in a group goes on to the next level of the reduction tree, until one is left in a source,
which is rounded by itself.  Rows are paired by falling size within a group, so the leftovers are small.

Equal rows (same id, source, size and content) are one unit: of n of them with fraction f, the whole part of n * f get a copy more, and one row stands
for the rest in the pairing, so however many there are, one row of each kind travels.  Random numbers and groups come from hashes of doc_id,
size and content, so reruns agree whatever the partitions are, and neither null nor repeated ids gather in one group.

Sources are summed up and their targets found on the driver while there are at most ``FEW`` of them; more are ranked and capped as a table.

Null, empty and blank texts have size 0 and are taken 0 times their words; they get copies like any other row.  A null
source is a source of its own and comes last.  A null doc_id is hashed like any value.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, materialize, maybe_broadcast

WEIGHTS: Sequence[float] = (5, 2, 1)
MOST, GROUP, FANOUT = 3, 4096, 1024
#: Sources that the driver takes; equal rows that one task puts out.
FEW, RUN = 50_000, 100_000


def word_count(text: str = "text") -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: Sequence[float] = WEIGHTS, most: float = MOST) -> dict[str | None, float]:
    """Target size of each source: weighted shares of the sum, none over ``most`` times its size."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: float(weights[k % len(weights)]) for k, s in enumerate(names)}
    out, left, free = {}, float(sum(sizes.values())), list(names)
    while free:
        unit = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * unit > most * sizes[s]]
        if not over:
            return out | {s: weight[s] * unit for s in free}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


def _pivot(copies: np.ndarray, fraction: np.ndarray, size: np.ndarray, chance: np.ndarray) -> int:
    """Rounds all fractions but one, in place; returns the place of the row left over, or -1.

    Rows i and j with masses p_i * s_i and p_j * s_j: all mass that fits goes to i, or to j, with the odds that keep
    both rows' expectations.
    """
    keep = -1
    for j in range(len(fraction)):
        if fraction[j] <= 1e-12 or fraction[j] >= 1 - 1e-12 or size[j] == 0:
            up = fraction[j] > chance[j] if size[j] == 0 else fraction[j] > 0.5
            copies[j] += bool(up)
            fraction[j] = 0
            continue
        if keep < 0:
            keep = j
            continue
        i = keep
        to_i = min((1 - fraction[i]) * size[i], fraction[j] * size[j])
        to_j = min(fraction[i] * size[i], (1 - fraction[j]) * size[j])
        move = to_i if chance[j] * (to_i + to_j) < to_j else -to_j
        fraction[i] += move / size[i]
        fraction[j] -= move / size[j]
        keep = -1
        for k in (i, j):
            if 1e-12 < fraction[k] < 1 - 1e-12:
                keep = k
            else:
                copies[k] += fraction[k] > 0.5
                fraction[k] = 0
    return keep


def _level(rows: DataFrame, last: bool) -> DataFrame:
    """Rounds within (source, part); ``last`` rounds the leftover by its fraction."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        size, chance = group["size"].to_numpy(), group["chance"].to_numpy()
        order = np.lexsort((group["own"].to_numpy(), chance, group["doc_id"].fill_null(-1).to_numpy(), -size))
        group, size, chance = group.take(pa.array(order)), size[order].astype(float), chance[order]
        copies, fraction = group["copies"].to_numpy().copy(), group["fraction"].to_numpy().copy()
        left = _pivot(copies, fraction, size, chance)
        if last and left >= 0:
            copies[left] += fraction[left] > chance[left]
            left = -1
        new = {"copies": pa.array(copies), "fraction": pa.array(fraction), "open": pa.array(np.arange(len(size)) == left)}
        return pa.table({n: new.get(n, group[n] if n in group.column_names else None) for n in names})

    names = [c for c in rows.columns if c != "open"] + ["open"]
    kinds = dict(rows.dtypes) | {"open": "boolean"}
    return rows.groupBy("source", "part").applyInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in names))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, copies, taken."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count().alias("size"), F.xxhash64(F.col("text").cast("string")).alias("content"))
    units = mix_units(rows.withColumn("own", F.col("content")), weights, most)
    out = _spread(units.withColumn("kind", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("times", F.when(F.col("kind") == 1, F.col("more")).otherwise(F.col("rows") - F.col("more"))), "times")
    copies = F.col("whole") + F.col("kind")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _spread(rows: DataFrame, times: str) -> DataFrame:
    """Each row as often as ``times`` says; where that is often, in runs that are dealt out over tasks first."""
    rows = rows.filter(F.col(times) > 0)
    run, last = fresh("run", rows.columns), F.col(times) - 1
    if (rows.agg(F.max(times)).first()[0] or 0) > RUN:
        runs = F.transform(F.sequence(F.lit(0).cast("long"), F.floor(last / RUN)), lambda k: F.least(F.lit(RUN).cast("long"), F.col(times) - k * RUN))
        rows = rows.withColumn(times, F.explode(runs)).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.withColumn(run, F.explode(F.array_repeat(F.lit(0), F.col(times).cast("int")))).drop(run)


def _source_facts(sized: DataFrame, weights: Sequence[float], most: float) -> tuple[DataFrame, int]:
    """(name, source_size, target, ratio, parts) of each source, and the largest number of parts."""
    stats = materialize(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("n"), F.count("*").alias("units")), "sources")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    if stats.count() <= FEW:
        size = {r["source"]: r["n"] for r in stats.collect()}
        goal = targets(size, weights, most)
        facts = stats.sparkSession.createDataFrame([(s, goal[s]) for s in size], "name string, target double")
        found = stats.join(F.broadcast(facts), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    else:
        found = _targets(stats, weights, most)
    facts = found.select(F.col("source").alias("name"), F.col("n").alias("source_size"), "target", "units").withColumn("ratio", ratio).withColumn("parts", F.ceil(F.col("units") / GROUP)).drop("units")
    return facts, stats.agg(F.max(F.ceil(F.col("units") / GROUP))).first()[0] or 1


def _targets(stats: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """``targets`` for a table of any number of sources (source, n): adds target.

    Sources over ``most`` times their size stay so when the unit of weight rises, so each pass over the table gives the next unit until none is added.
    """
    by = [F.col("source").isNull(), F.col("source")]
    ranged = materialize(stats.repartitionByRange(*by).withColumn("part", F.spark_partition_id()), "ranged")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("part").agg(F.count("*").alias("c")).select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))  # a row a partition
    place = F.col("offset") + F.row_number().over(Window.partitionBy("part").orderBy(*by)) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    ranked = materialize(ranged.join(F.broadcast(offsets), "part").withColumn("weight", weight).drop("part", "offset"), "ranked")
    total, unit, capped = float(ranked.agg(F.sum("n")).first()[0] or 0), 0.0, -1
    while True:
        over = F.col("weight") * F.lit(unit) > most * F.col("n")
        cut, free, now = ranked.agg(F.sum(F.when(over, most * F.col("n"))), F.sum(F.when(~over, F.col("weight"))), F.count(F.when(over, 1))).first()
        if now == capped or not free:
            break
        unit, capped = (total - (cut or 0)) / free, now
    return ranked.withColumn("target", F.when(F.col("weight") * F.lit(unit) > most * F.col("n"), (most * F.col("n")).cast("double")).otherwise(F.col("weight") * F.lit(unit)))


def mix_units(rows: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Per kind of equal rows (doc_id, source, size, content, own): how many ``rows``, the copies that each gets (``whole``) and how many get one more (``more``)."""
    sized = materialize(rows.groupBy("doc_id", "source", "size", "content", "own").agg(F.count("*").alias("rows")), "sizes")
    facts, most_parts = _source_facts(sized, weights, most)
    rows = sized.join(maybe_broadcast(facts, 120), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    whole = F.floor(F.col("ratio") + 1e-12)
    some = F.col("rows") * F.greatest(F.col("ratio") - whole, F.lit(0.0))
    scale = 1 << 53
    rows = rows.select(
        "doc_id", "source", "size", "content", "own", "rows", "source_size", "target", "parts",
        whole.cast("long").alias("whole"),
        F.floor(some + 1e-9).cast("long").alias("copies"),
        F.greatest(some - F.floor(some + 1e-9), F.lit(0.0)).alias("fraction"),
        (F.pmod(F.xxhash64(F.lit(23), "doc_id", "size", "content"), F.lit(scale)) / scale).alias("chance"),
        F.pmod(F.xxhash64(F.lit(29), "doc_id", "size", "content"), F.col("parts")).alias("part"),
    )
    done = None
    while True:
        last = most_parts <= 1
        rows = materialize(_level(rows, last), "rounded")
        if last:
            done = rows if done is None else done.union(rows)
            break
        closed = rows.filter("not open")
        done = closed if done is None else done.union(closed)
        most_parts = -(-most_parts // FANOUT)
        rows = rows.filter("open").withColumn("part", F.floor(F.col("part") / FANOUT))
    return done.select("doc_id", "source", "size", "own", "rows", "source_size", "target", "whole", F.col("copies").alias("more"))


def repeat(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as the mix takes them; rows that are equal in all columns are interchangeable."""
    own, unit, content, copies, row = (fresh(n, docs.columns) for n in ("own", "unit", "content", "copies", "row"))
    keyed = docs.withColumn(own, F.xxhash64(*docs.columns))
    units = mix_units(keyed.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count().alias("size"), F.xxhash64(F.col("text").cast("string")).alias("content"), F.col(own).alias("own")), weights, most)
    chosen = units.select(F.col("doc_id").alias(unit), F.col("own").alias(content), "rows", (F.col("whole") * F.col("rows") + F.col("more")).alias(copies)).filter(F.col(copies) > 0)
    chosen = materialize(chosen, "copies")

    def same(other: DataFrame) -> Column:
        return keyed["doc_id"].cast("long").eqNullSafe(other[unit]) & (keyed[own] == other[content])

    single = chosen.filter("rows = 1").drop("rows")
    taken = keyed.join(maybe_broadcast(single, 24), same(single))
    out = taken.withColumn(row, F.explode(F.array_repeat(F.lit(0), F.col(copies).cast("int")))).select(*docs.columns)
    many = chosen.filter("rows > 1").drop("rows")
    if many.isEmpty():
        return out
    one = keyed.join(maybe_broadcast(many, 24), same(many)).groupBy(unit, content, copies).agg(F.first(F.struct(*docs.columns)).alias(row))
    return out.union(_spread(materialize(one, "repeated"), copies).select(f"{row}.*"))
