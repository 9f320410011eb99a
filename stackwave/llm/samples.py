"""Bounded, repeatable samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc_mod(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo a number; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def bounded(df: DataFrame, label: str, cap: int) -> tuple[DataFrame, dict]:
    """About ``cap`` distinct rows of each value of ``label`` (all, if it has fewer), chosen by a hash of the whole row; and the values' counts.

    Equal rows are taken together and come back once, so reruns agree; at most ``2 * cap`` rows for each value come back, those of the least
    hashes, so what the driver gets is bounded however large the table is.  The values are few by nature (languages, 0 and 1).
    """
    counts = {r[0]: r[1] for r in df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*")).collect()}
    scale = 1 << 30
    place, chosen = F.pmod(F.xxhash64(F.lit(7), *df.columns), F.lit(scale)), F.lit(False)
    for value, n in counts.items():
        chosen = chosen | ((F.col(label) == F.lit(value)) & (place < int(scale * min(1.0, cap / n))))
    return df.filter(chosen).dropDuplicates().orderBy(F.xxhash64(F.lit(7), *df.columns), *df.columns).limit(2 * cap * max(1, len(counts))), counts


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, fold: tuple[int, int], cap: int, highest: bool) -> tuple[DataFrame, dict]:
    """(doc_id, text, label) of about ``cap`` labelled documents of each label outside the fold, and how many rows each label has.

    Of several labels of one document the highest or the lowest counts.  Of several texts under one id the one with the least hash does, so at
    most ``4 * cap`` rows come back.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter((crc_mod("doc_id", fold[0]) != fold[1]) & F.col("label").isin(0, 1))
    sample, totals = bounded(known, "label", cap)
    chosen = sample.groupBy("doc_id").agg((F.max if highest else F.min)("label").alias("label"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")  # at most 4 * cap ids
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one")
    return rows.groupBy("doc_id", "label").agg(one).select("doc_id", F.col("one.text").alias("text"), "label"), totals
