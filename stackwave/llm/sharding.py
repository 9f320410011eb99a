"""Sharding by global byte-size prefix sums, with DataFrame functions only.

Rows are ordered by doc_id (null first), text checksum and size.  Equal rows, which are interchangeable, are counted and travel as one.
Ranges of that order, by all three columns, are the partitions, so neither a null nor a repeated id gathers in one; their total sizes, a row a
range, are summed up to give each range its offset, and a window within the range gives each kind of rows its prefix sum.  The global sums are cut
at equal targets: a row goes to the shard that holds the middle of its bytes, so shards are contiguous and differ from the target by less than half
of a row at each end.  A kind of many equal rows is cut where the targets fall in it; slots follow from counts by range and shard.

The size of a row is the UTF-8 bytes of its text (null: none) plus ``OVERHEAD``, so empty texts are spread as well.  An empty table
gives an empty one.  Sums are exact while the total times the shards stays under 2**62.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, materialize, maybe_broadcast

#: Rows of a range; equal rows that one task puts out.
OVERHEAD, RANGE_ROWS, RUN = 16, 100_000, 100_000


def _measured(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(body) + OVERHEAD).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))


def _shard_of(middle_twice: Column, shards: int, total: int) -> Column:
    """The shard that holds a byte place, given twice."""
    return F.least(_div(middle_twice * shards, F.lit(2 * total)), F.lit(shards - 1).cast("long"))


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of longs, b > 0, rounded down."""
    return F.call_function("div", a - F.pmod(a, b), b)


def shard(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32 (of UTF-8; null text: 0), shard, slot (gapless from 0 within the shard)."""
    kinds = materialize(_measured(docs, doc_id, text).groupBy("doc_id", "text_crc32", "size").agg(F.count("*").alias("n")), "kinds")
    n, total, most = kinds.agg(F.count("*"), F.sum(F.col("size") * F.col("n")), F.max("n")).first()
    if not n:
        return kinds.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    order = ["doc_id", "text_crc32", "size"]
    ranges = max(1, -(-n // RANGE_ROWS), min(n // 200, int(kinds.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    placed = materialize(kinds.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()), "ranges")
    discard(kinds)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("part").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"))
    offsets = totals.select("part", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("offset"))  # a row a range
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.withColumn("sum", F.sum(F.col("size") * F.col("n")).over(inside)).join(maybe_broadcast(offsets, 16), "part")
    summed = summed.withColumn("start", F.col("offset") + F.col("sum") - F.col("size") * F.col("n")).drop("sum", "offset")
    # a kind's rows j = 0 .. n - 1 have their middles at start + (j + 1/2) * size; those of a shard are a run of j
    first = _shard_of(2 * F.col("start") + F.col("size"), shards, total)
    last = _shard_of(2 * F.col("start") + (2 * F.col("n") - 1) * F.col("size"), shards, total)

    def begin(k: Column) -> Column:
        """The least j in shard k or beyond: the least whole j with (2 * start + (2 * j + 1) * size) * shards >= 2 * total * k."""
        odd = -_div(-(2 * total * k - 2 * F.col("start") * shards), F.col("size") * shards)
        return F.greatest(F.least(_div(odd, F.lit(2).cast("long")), F.col("n")), F.lit(0).cast("long"))

    runs = summed.withColumns({"first": first, "last": last}).withColumn("shard", F.explode(F.sequence("first", "last")))
    begins = F.when(F.col("shard") == F.col("first"), F.lit(0).cast("long")).otherwise(begin(F.col("shard")))
    ends = F.when(F.col("shard") == F.col("last"), F.col("n")).otherwise(begin(F.col("shard") + 1))
    runs = runs.withColumn("rows", ends - begins).filter("rows > 0").select("part", *order, "shard", "rows")
    # slots: rows of the shard in earlier ranges, plus the rows before it among the range's rows of the shard
    counts = runs.groupBy("part", "shard").agg(F.sum("rows").alias("c"))
    ahead = counts.select("part", "shard", F.coalesce(F.sum("c").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    before = Window.partitionBy("part", "shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = runs.withColumn("slot", F.sum("rows").over(before) - F.col("rows")).join(maybe_broadcast(ahead, 24), ["part", "shard"]).withColumn("slot", F.col("slot") + F.col("ahead"))
    if most > RUN:  # runs of very many equal rows are dealt out over tasks first
        pieces = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / RUN)), lambda k: F.struct((F.col("slot") + k * RUN).alias("slot"), F.least(F.lit(RUN).cast("long"), F.col("rows") - k * RUN).alias("rows")))
        runs = runs.withColumn("piece", F.explode(pieces)).select(*order, "shard", "piece.slot", "piece.rows").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = runs.select(*order, "shard", F.explode(F.sequence(F.col("slot"), F.col("slot") + F.col("rows") - 1)).alias("slot"))
    return out.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot")
