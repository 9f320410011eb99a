"""Benchmark decontamination by spaced-seed hashing.

Terms are lower-cased runs of letters and digits.  A mask is a window of terms of which the positions marked 0 are ignored;
the windows of all benchmark items and all documents are hashed under each of ``MASKS``, so a term that was exchanged at an
ignored position doesn't hide a hit.  Document hashes are joined with the benchmark's in the task that reads the document.  Each
hit names an item and a diagonal; along it, document and item are compared term by term.  An item of up to 14 terms contaminates a document when 0.8 of its
terms are equal on a diagonal; a longer one when the best run, with +1 for an equal term and -2 for another, has ``OVERLAP`` equal terms.

The masks hit every overlap that is accepted: ``MASKS`` those of items of 15 terms or more, those of ``SHORT`` the others.  Items of one to
four terms are accepted whole only.  They are reported like any other, but as they are met by chance,
``clean_only`` drops a document for an item of fewer than ``LEAST`` terms only when the document holds nothing else.

Items without an id are searched, and come last; items of equal terms are searched once.  The benchmark is taken in blocks of at most
``BLOCK_BYTES`` of text (one item, if that is longer).  One block goes to the tasks at a time; of a larger benchmark each further block takes another pass
over the documents, written to the shared folder in between, so neither the driver nor a task ever holds more than a block.  Null and empty texts and
tables have no overlaps.  Repeated rows get equal results.  Further columns of ``docs`` are kept by ``clean_only`` and not read by ``overlaps``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize
from .textkit import SEPARATORS, HashTable, Words, lowered, mix64, ragged, row_slices, string_buffers

MASKS = ("110101011", "1110010011", "1101100111", "11101100001", "11011101", "1110001101", "11110101", "1011001011")
SHORT = {1: ("1",), 2: ("11",), 3: ("111",), 4: ("1111",), 5: ("1111", "11011", "10111", "11101")} | dict.fromkeys(range(6, 12), ("1111", "11011")) | dict.fromkeys(range(12, 15), ("1111",))
OVERLAP, LEAST, BLOCK_BYTES = 12, 5, 4 << 20
#: Places that are held at a time when hits are looked at.
PLACES = 1 << 20
_MULTIPLIER = np.uint64(0x9FB21C651E98DF25)


def masked_hashes(words: Words, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(start position, hash) of every window of a row under the mask."""
    span, n = len(mask), len(words.hash)
    if n < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    acc = np.full(n - span + 1, len(mask), np.uint64)
    for j, bit in enumerate(mask):
        if bit == "1":
            acc *= _MULTIPLIER
            acc += words.hash[j : n - span + 1 + j]
    at = np.flatnonzero(words.row[: n - span + 1] == words.row[span - 1 :])
    return at, mix64(acc[at])


def _pieces(sizes: np.ndarray, most: int = PLACES) -> Iterator[tuple[int, int]]:
    """Ranges of entries whose sizes sum up to about ``most``."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


class Benchmark:
    """The searchable items of one block: terms, and for each mask a table of hashes with the places they come from."""

    def __init__(self, ids: list[int | None], texts: pa.Array):
        raw, offs = string_buffers(lowered(texts))
        words = Words(raw, offs, SEPARATORS)
        same: dict[bytes, list[int]] = {}
        for k in range(len(ids)):
            same.setdefault(words.hash[words.first[k] : words.first[k + 1]].tobytes(), []).append(k)
        same.pop(b"", None)
        kept = np.zeros(len(ids), bool)
        kept[[rows[0] for rows in same.values()]] = True
        words.hash, words.row = words.hash[kept[words.row]], (np.cumsum(kept) - 1)[words.row[kept[words.row]]]
        counts = words.counts[kept]
        self.ids = [[ids[k] for k in same[key]] for key in sorted(same, key=lambda key: same[key][0])]
        self.terms, self.first = words.hash, np.concatenate([[0], np.cumsum(counts)])
        self.needed = np.minimum(OVERLAP, np.ceil(0.8 * counts).astype(int))
        self.tables = []
        lengths: dict[str, list[int]] = {}
        for length, masks in SHORT.items():
            for mask in masks if (counts == length).any() else ():
                lengths.setdefault(mask, []).append(length)
        for mask in (*MASKS, *lengths):
            at, hashes = masked_hashes(words, mask)
            keep = np.isin(counts[words.row[at]], lengths[mask]) if mask in lengths else counts[words.row[at]] > max(SHORT)
            at, hashes = at[keep], hashes[keep]
            order = np.argsort(hashes, kind="stable")
            at, hashes = at[order].astype(np.int32), hashes[order]
            table = HashTable(hashes)
            ends = np.zeros(len(hashes), np.int32)
            ends[table.order] = np.append(table.order[1:], len(hashes))  # hashes are sorted, so the first places rise
            self.tables.append((mask, table, at, ends))

    def _diagonals(self, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, items, start of the item in the words) of all hits, each diagonal once in a piece."""
        for mask, table, places, ends in self.tables:
            at, hashes = masked_hashes(words, mask)
            found, first = table.find(hashes)
            for lo, hi in _pieces(ends[first] - first):
                a, e = first[lo:hi], ends[first[lo:hi]]
                place, p = places[ragged(a, e)].astype(np.int64), np.repeat(at[found[lo:hi]], e - a)
                item = np.searchsorted(self.first, place, "right") - 1
                row, start = words.row[p], p - place + self.first[item]
                order = np.lexsort((start, item, row))
                row, item, start = row[order], item[order], start[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (start[1:] != start[:-1])
                yield row[new], item[new], start[new]

    def overlaps(self, texts: pa.Array) -> Iterator[tuple[int, list[tuple[int | None, int, int, int]], bool]]:
        """(row, [(item id, first term, end term, equal terms)], whether an item of ``LEAST`` terms or the whole text is among them)."""
        raw, offs = string_buffers(lowered(texts))
        for lo, hi in row_slices(offs):
            words = Words(raw, offs[lo : hi + 1], SEPARATORS)
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            for rows, items, starts in self._diagonals(words):
                a, e = np.maximum(starts, words.first[rows]), np.minimum(starts + self.first[items + 1] - self.first[items], words.first[rows + 1])
                for x, y in _pieces(e - a):
                    at = ragged(a[x:y], e[x:y])
                    equal = words.hash[at] == self.terms[at + np.repeat(self.first[items[x:y]] - starts[x:y], (e - a)[x:y])]
                    total = np.add.reduceat(equal, np.concatenate([[0], np.cumsum((e - a)[x:y])[:-1]]), dtype=np.int64)
                    for k in (x + np.flatnonzero(total >= self.needed[items[x:y]])).tolist():
                        row, item = int(rows[k]), int(items[k])
                        run = self._run(words, row, item, int(starts[k]))
                        if run[2] >= self.needed[item] and ((row, item) not in best or (-best[row, item][2], best[row, item]) > (-run[2], run)):
                            best[row, item] = run
            out: dict[int, list[int]] = {}
            for row, item in sorted(best):
                out.setdefault(row, []).append(item)
            for row, found in out.items():
                sizes = self.first[np.array(found) + 1] - self.first[np.array(found)]
                yield lo + row, [(i, *best[row, item]) for item in found for i in self.ids[item]], bool((sizes >= LEAST).any() or (sizes == words.first[row + 1] - words.first[row]).any())

    def _run(self, words: Words, row: int, item: int, start: int) -> tuple[int, int, int]:
        """The overlap on the diagonal that puts the item's first term at ``start``: first and end term of the row, equal terms."""
        base, end, size = int(words.first[row]), int(words.first[row + 1]), int(self.first[item + 1] - self.first[item])
        a, e = max(start, base), min(start + size, end)
        equal = words.hash[a:e] == self.terms[self.first[item] + a - start : self.first[item] + e - start]
        if size <= max(SHORT):
            at = np.flatnonzero(equal)
            return (a + int(at[0]) - base, a + int(at[-1]) + 1 - base, len(at)) if len(at) else (a - base, a - base, 0)
        gain = np.concatenate([[0], np.cumsum(np.where(equal, 1, -2))])
        low = np.minimum.accumulate(gain)
        stop = int((gain - low).argmax())
        begin = int(gain[: stop + 1].argmin())
        return a + begin - base, a + stop - base, int(equal[begin:stop].sum())


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[Benchmark]:
    """The benchmark in blocks of bounded size, one after the other; one block unless the table is large."""
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-2 * size // BLOCK_BYTES) if size > BLOCK_BYTES else 1  # by hash: of about half the size, so that few exceed it
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        table = part.toArrow().sort_by([("id", "ascending"), ("text", "ascending")]).combine_chunks()
        if table.num_rows:
            yield Benchmark(table["id"].to_pylist(), table["text"].combine_chunks() if table["text"].num_chunks != 1 else table["text"].chunk(0))


def _passes(rows: DataFrame, benchmark: DataFrame, search: Callable[[DataFrame, Benchmark], DataFrame]) -> DataFrame:
    """``search`` over the rows for one block after the other; the rows are written between two."""
    done, before = rows, None
    for block in blocks(benchmark):
        if done is not rows:
            done, last = materialize(done, "searched"), before
            before = done
            if last is not None:
                discard(last)
        done = search(done, block)
    return done


_HITS = "array<struct<item_id:long,first:long,end:long,equal:long>>"
_ARROW = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "first", "end", "equal")]))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, contaminated, item_ids, spans (item, first and end term in the document, equal terms)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(None).cast(_HITS).alias("spans"))

    def search(some: DataFrame, block: Benchmark) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                spans = [x or [] for x in b.column(2).to_pylist()]
                for row, hits, _ in block.overlaps(b.column(1)):
                    spans[row] = spans[row] + [dict(zip(("item_id", "first", "end", "equal"), h, strict=True)) for h in hits]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, _ARROW)], names=["doc_id", "text", "spans"])

        return some.mapInArrow(run, f"doc_id long, text string, spans {_HITS}")

    found = _passes(rows, benchmark, search).select("doc_id", F.coalesce("spans", F.array().cast(_HITS)).alias("spans"))
    order = F.transform("spans", lambda h: F.struct(h["item_id"].isNull().alias("no"), *(h[n].alias(n) for n in ("item_id", "first", "end", "equal"))))
    spans = F.transform(F.array_sort(order), lambda h: F.struct(*(h[n].alias(n) for n in ("item_id", "first", "end", "equal"))))
    found = found.select("doc_id", (F.size("spans") > 0).alias("contaminated"), spans.alias("spans"))
    return found.select("doc_id", "contaminated", F.array_distinct("spans.item_id").alias("item_ids"), "spans")


def clean_only(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that no item contaminates."""
    at = docs.columns.index(text)

    def search(some: DataFrame, block: Benchmark) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for row, _, sure in block.overlaps(b.column(at)):
                    keep[row] &= not sure
                yield b.filter(pa.array(keep))

        return some.mapInArrow(run, docs.schema)

    return _passes(docs, benchmark, search)
