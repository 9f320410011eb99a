"""Stacks that grow: new scenes of a stream, and least squares kept as running normal equations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_scenes(scenes: DataFrame, watermark: str = "30 days", time: str = "seen", key: str = "pair_id") -> DataFrame:
    """Each scene of a streaming catalog once, by pair, within the watermark."""
    return scenes.withWatermark(time, watermark).dropDuplicatesWithinWatermark([key])


def windowed_missing(stream: DataFrame, time: str = "seen", width: str = "1 day", delay: str = "1 day", value: str = "phase") -> DataFrame:
    """Per window of arrival time: pixels that came, and how many have no value; late rows count until the watermark passes."""
    rows = stream.withWatermark(time, delay).groupBy(F.window(time, width))
    return rows.agg(F.count("*").alias("n"), F.sum(F.col(value).isNull().cast("int")).alias("n_missing")).select("window.start", "window.end", "n", "n_missing")


def line_sums(stream: DataFrame, *keys: str, span: str = "span", value: str = "value") -> DataFrame:
    """Running sums that determine a straight line a key; they add up over batches."""
    x, y = F.col(span), F.col(value)
    return stream.filter(y.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"))


def line_of_sums(sums: DataFrame, *keys: str) -> DataFrame:
    """(keys, velocity, constant) from running sums; null for fewer than two distinct spans."""
    det = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    v = F.when(det != 0, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / det)
    return sums.select(*keys, v.alias("velocity"), ((F.col("sy") - v * F.col("sx")) / F.col("n")).alias("constant"))


def reinvert(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls ``work`` with every batch of new scenes, once all that are there have been read; the batch number makes reruns idempotent."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
