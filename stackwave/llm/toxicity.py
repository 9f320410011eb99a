"""Toxicity by nearest labelled examples under exact TF-IDF cosine, searched through a block-max inverted index.

Terms are lower-cased runs of letters and digits: every word of the labelled examples, a bounded sample of labelled rows, is in
the vocabulary, but for words of more than ``MOST_DF`` of all documents that aren't marked.  Words and stems (the first 4 to 8 bytes of longer
words) that go with one of the labels, under false-discovery control, are marked terms: marked stems join the vocabulary, and the TF-IDF weight
of a marked term counts ``RELEVANCE`` times, so that of two texts on one subject the tone decides.  Document frequencies are counted over all documents.  A text's vector holds its terms of the vocabulary.

The examples, those of like words side by side, are indexed by their terms in blocks of consecutive numbers; each term keeps the largest
weight of every block that has it.  A document's bound for a block is the sum of its weights times those maxima.  Blocks are opened by falling bound, the
first few and then all others that reach the k-th best cosine so far, so the neighbours are exactly the k nearest (ties to the smaller number).

Votes weigh 1 / (distance + 0.05) with label 1 counting by its sampling rate; votes of the examples without themselves and their near copies
calibrate the score isotonically.  A text that shares no term with any example has no neighbours; its score is the rate of label 1.

Features, frequencies and the examples' votes are made on the executors; the driver gets the examples' term numbers and a row for each term.
Null and empty texts have no terms.  Without labels of both kinds every score is the rate of label 1 (0 without labels).  Several labels of one
document: the highest counts.  Repeated rows get equal results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .samples import labelled_texts
from .shared import materialize
from .textkit import SEPARATORS, HashTable, Words, lowered, mix64, ragged, row_slices, string_buffers

#: Labelled rows of each label that are sampled; neighbours; examples of a block; blocks that are opened first.
CAP, NEIGHBOURS, BLOCK, FIRST = 2500, 15, 128, 4
#: Lengths of stems in bytes.
STEMS = (4, 5, 6, 7, 8)
#: Words of more than this share of all documents are left out, unless marked: they bring any two texts near each other.
MOST_DF = 0.1
#: A marked term is in so many examples and has a log odds ratio of so much either way, at least; RATE is the share of marked terms that may be there by chance.
LEAST_DF, LEAST_LOG_ODDS, RATE, RELEVANCE = 4, 1.5, 0.005, 8.0


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts by the keys, and the places in it where a new combination starts."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    return order, np.flatnonzero(new)


def _all_terms(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, rows, hashes of words, which are stems) for slices of a column; the terms of a row are distinct."""
    raw, offs = string_buffers(lowered(column))
    for lo, hi in row_slices(offs):
        words = Words(raw, offs[lo : hi + 1], SEPARATORS)
        parts = [(words.row, words.hash, 0), *((words.row[at], h, 1) for at, h in map(words.prefixes, STEMS))]
        rows, terms = (np.concatenate([x[k] for x in parts]) for k in (0, 1))
        stem = np.repeat([x[2] for x in parts], [len(x[0]) for x in parts])
        order, cut = _runs(rows, stem, terms)
        yield lo, hi, rows[order][cut], terms[order][cut], stem[order][cut]


class Vocabulary:
    """Numbers of terms: words first, then stems."""

    def __init__(self, words: np.ndarray, stems: np.ndarray):
        self.words, self.stems = HashTable(words), HashTable(stems)
        self.n_words, self.size = len(words), len(words) + len(stems)

    def rows(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(row, distinct term numbers, their counts) of rows with a term of the vocabulary."""
        raw, offs = string_buffers(lowered(column))
        for lo, hi in row_slices(offs):
            words = Words(raw, offs[lo : hi + 1], SEPARATORS)
            at, term = self.words.find(words.hash)
            rows, terms = [words.row[at]], [term]
            for size in STEMS if len(self.stems.sorted) else ():
                of, h = words.prefixes(size)
                at, term = self.stems.find(h)
                rows.append(words.row[of[at]])
                terms.append(term + self.n_words)
            row, term = np.concatenate(rows), np.concatenate(terms)
            order, cut = _runs(row, term)
            row, term, count = row[order][cut], term[order][cut], np.diff(np.append(cut, len(order)))
            first = np.searchsorted(row, np.arange(hi - lo + 1))
            for r in np.unique(row).tolist():
                a, e = first[r], first[r + 1]
                yield lo + r, term[a:e], count[a:e]


@dataclass
class ToxicityModel:
    words: np.ndarray
    stems: np.ndarray
    weights: np.ndarray  # idf times relevance, by term
    ids: np.ndarray
    labels: np.ndarray
    groups: np.ndarray
    weight_of_one: float
    rate: float
    entries: np.ndarray  # first entry of each term; an entry is a term in a block
    blocks: np.ndarray
    maxima: np.ndarray
    starts: np.ndarray  # first posting of each entry
    examples: np.ndarray
    values: np.ndarray
    steps: np.ndarray
    rates: np.ndarray

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.weights[terms]
        return w / np.sqrt((w * w).sum())

    def nearest(self, terms: np.ndarray, weights: np.ndarray, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the nearest examples that share a term, without those of one group of near copies."""
        lo, hi = self.entries[terms], self.entries[terms + 1]
        entry, weight = ragged(lo, hi), np.repeat(weights, hi - lo)
        block = self.blocks[entry]
        bound = np.bincount(block, weight * self.maxima[entry])
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        best, score, done, size = np.zeros(0, np.int64), np.zeros(0), 0, FIRST
        while done < len(order):
            now = order[done : done + size]
            if len(score) >= NEIGHBOURS:
                now = now[bound[now] * (1 + 1e-9) >= score[-1]]
                if not len(now):
                    break
            mask = np.zeros(len(bound), bool)
            mask[now] = True
            take = mask[block]
            a, e = self.starts[entry[take]], self.starts[entry[take] + 1]
            posting = ragged(a, e)
            s = np.bincount(self.examples[posting], np.repeat(weight[take], e - a) * self.values[posting])
            new = np.flatnonzero(s)
            if without is not None:
                new = new[self.groups[new] != without]
            best, score = np.concatenate([best, new]), np.concatenate([score, s[new]])
            top = np.lexsort((best, -score))[:NEIGHBOURS]
            best, score = best[top], score[top]
            done, size = done + len(now), len(order)
        return best, np.minimum(score, 1.0)

    def vote(self, near: np.ndarray, cosine: np.ndarray) -> float:
        w = 1 / (1 - cosine + 0.05)
        one = self.labels[near] == 1
        a = self.weight_of_one * w[one].sum()
        return float(a / (a + w[~one].sum()))

    def score(self, vote: float) -> float:
        return float(self.rates[max(int(np.searchsorted(self.steps, vote, "right")) - 1, 0)])


def _isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: step positions and rising values."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, c in zip(x[order], y[order], w[order], strict=True):
        if pools and pools[-1][0] == a:
            pools[-1][1] += b * c
            pools[-1][2] += c
        else:
            pools.append([a, b * c, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, s, c2 = pools.pop()
            pools[-1][1] += s
            pools[-1][2] += c2
    return np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools])


def _sampled(docs: DataFrame, labels: DataFrame, label: str, fold: tuple[int, int]) -> tuple[DataFrame, dict]:
    """(doc_id, text, label, part) of the labelled rows that are learned from, and the labels' counts; ``part`` names the near copies."""
    rows, totals = labelled_texts(docs, labels, label, fold, CAP, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = np.full(b.num_rows, -1, np.int64)
            raw, offs = string_buffers(lowered(b.column(1)))
            for lo, hi in row_slices(offs):
                words = Words(raw, offs[lo : hi + 1], SEPARATORS)
                some = np.flatnonzero(words.counts)
                if len(some):
                    part[lo + some] = (np.minimum.reduceat(mix64(words.hash ^ np.uint64(0xA5A5A5A5A5A5A5A5)), words.first[some]) >> np.uint64(1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part)], names=["doc_id", "text", "label", "part"])

    return materialize(rows.mapInArrow(run, "doc_id long, text string, label int, part long"), "examples"), totals


def _term_counts(examples: DataFrame) -> pa.Table:
    """(term, stem, n, ones) of every term of the examples: how many groups of near copies have it, by one example each, and how many of label 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            once, y = b.column(2).to_numpy().astype(np.int64), b.column(1).to_numpy()
            for lo, _, rows, terms, stem in _all_terms(b.column(0)):
                order, cut = _runs(stem, terms)
                row = lo + rows[order]
                n, ones = (np.add.reduceat(x[row], cut) if len(cut) else cut for x in (once, once * y))
                yield pa.RecordBatch.from_arrays([pa.array(terms[order][cut].view(np.int64)), pa.array(stem[order][cut], pa.int32()), pa.array(n, pa.int64()), pa.array(ones, pa.int64())], names=["term", "stem", "n", "ones"])

    first = F.row_number().over(Window.partitionBy("part", "label").orderBy("doc_id")) == 1  # of the bounded sample
    found = examples.select("text", "label", first.cast("int").alias("once")).mapInArrow(run, "term long, stem int, n long, ones long").groupBy("term", "stem").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))
    return found.filter(f"stem = 0 or n >= {LEAST_DF}").toArrow()


def _marked(n: np.ndarray, ones: np.ndarray, n_all: int, n_ones: int) -> np.ndarray:
    """Which terms go with a label: log odds ratio and, at a false-discovery rate, the likelihood ratio of their share of label 1."""
    p, q = n_ones - ones, n_all - n_ones - (n - ones)
    odds = np.log((ones + 0.5) * (q + 0.5) / ((n - ones + 0.5) * (p + 0.5)))
    share = n_ones / n_all
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = 2 * (np.nan_to_num(ones * np.log(ones / (n * share))) + np.nan_to_num((n - ones) * np.log((n - ones) / (n * (1 - share)))))
    usual = n >= LEAST_DF
    likely = np.flatnonzero(usual & (np.abs(odds) >= LEAST_LOG_ODDS) & (gain > 0))
    chance = np.array([math.erfc(math.sqrt(x / 2)) / 2 for x in gain[likely]])
    order = np.argsort(chance, kind="stable")
    passed = np.flatnonzero(chance[order] <= RATE * np.arange(1, len(order) + 1) / max(1, int(usual.sum())))
    out = np.zeros(len(n), bool)
    out[likely[order[: passed[-1] + 1]] if len(passed) else likely[:0]] = True
    return out


def _document_frequencies(docs: DataFrame, words: np.ndarray, stems: np.ndarray) -> tuple[np.ndarray, int]:
    """Document frequencies over all documents, and their number; every task sends one row a term it has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Vocabulary(words, stems)
        df = np.zeros(terms.size + 1, np.int64)
        for b in batches:
            df[-1] += b.num_rows
            for _, term, _ in terms.rows(b.column(0)):
                df[term] += 1
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(df[seen], pa.int64())], names=["term", "df"])

    out = np.zeros(len(words) + len(stems) + 1, np.int64)
    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out[found["term"].to_numpy()] = found["df"].to_numpy()
    return out[:-1], int(out[-1])


def _numbered(examples: DataFrame, words: np.ndarray, stems: np.ndarray) -> DataFrame:
    """(doc_id, label, part, terms, counts) of the examples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(words, stems)
        for b in batches:
            terms, counts = [[]] * b.num_rows, [[]] * b.num_rows
            for r, t, c in vocabulary.rows(b.column(1)):
                terms[r], counts[r] = t, c
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["doc_id", "label", "part", "terms", "counts"])

    return materialize(examples.mapInArrow(run, "doc_id long, label int, part long, terms array<int>, counts array<int>"), "vectors")


def _together(terms: pa.Array, df: np.ndarray) -> np.ndarray:
    """An order of the examples that puts those of like words into one block: by their most, second and third most frequent term."""
    size, flat = terms.value_lengths().to_numpy(), terms.flatten().to_numpy()
    row = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((flat, -df[flat], row))
    start = np.cumsum(size) - size
    keys = [np.where(size > k, flat[order][np.minimum(start + k, max(len(flat) - 1, 0))], -1) if len(flat) else np.zeros(len(size)) for k in range(3)]
    return np.lexsort((np.arange(len(size)), *keys[::-1]))


def _votes(vectors: DataFrame, model: ToxicityModel) -> tuple[np.ndarray, np.ndarray]:
    """Votes and labels of the examples that have neighbours besides their near copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            votes = []
            for part, terms, counts in zip(b.column(1).to_numpy(), b.column(2), b.column(3), strict=True):
                t = terms.values.to_numpy()
                near = model.nearest(t, model.vector(t, counts.values.to_numpy()), part) if len(t) else ((), ())
                votes.append(model.vote(*near) if len(near[0]) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(votes, pa.float64())], names=["label", "vote"])

    found = vectors.select("label", "part", "terms", "counts").repartition(vectors.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "label int, vote double").filter("vote is not null").toArrow()
    return found["vote"].to_numpy(), found["label"].to_numpy()


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", fold: tuple[int, int] = (4, 2)) -> ToxicityModel:
    """Learns from a bounded sample of ``labels`` (doc_id, label) outside the fold, and frequencies of all ``docs``."""
    examples, totals = _sampled(docs, labels, label, fold)
    rate = totals.get(1, 0) / max(1, sum(totals.values()))
    groups = {r[0]: r[1:] for r in examples.groupBy("label").agg(F.countDistinct("part"), F.count("*")).collect()}
    none = np.zeros(0, np.int64)
    if len(groups) < 2:
        return ToxicityModel(none.view(np.uint64), none.view(np.uint64), np.zeros(0), none, none, none, 1.0, rate, none, none, np.zeros(0), none, none, np.zeros(0), np.zeros(1), np.array([rate]))
    found = _term_counts(examples).sort_by([("stem", "ascending"), ("term", "ascending")])
    term, stem = found["term"].to_numpy().view(np.uint64), found["stem"].to_numpy() == 1
    marked = _marked(found["n"].to_numpy(), found["ones"].to_numpy(), groups[0][0] + groups[1][0], groups[1][0])
    words, stems = term[~stem], term[stem & marked]
    relevance = np.concatenate([np.where(marked[~stem], RELEVANCE, 1.0), np.full(len(stems), RELEVANCE)])
    df, n_docs = _document_frequencies(docs, words, stems)
    keep = (relevance > 1) | (df <= MOST_DF * n_docs)
    words, relevance, df = words[keep[: len(words)]], relevance[keep], df[keep]
    weight_of_one = (totals[1] / groups[1][1]) / (totals[0] / groups[0][1])

    vectors = _numbered(examples, words, stems)
    table = vectors.toArrow().sort_by([("doc_id", "ascending"), ("part", "ascending")]).combine_chunks()
    table = table.take(pa.array(_together(table["terms"].combine_chunks(), df))).combine_chunks()
    model = ToxicityModel(words, stems, (np.log((n_docs + 1) / (df + 1)) + 1) * relevance, table["doc_id"].to_numpy(), table["label"].to_numpy(), table["part"].to_numpy(), weight_of_one, rate, none, none, np.zeros(0), none, none, np.zeros(0), np.zeros(1), np.array([rate]))
    size = table["terms"].combine_chunks().value_lengths().to_numpy()
    example, term = np.repeat(np.arange(len(size), dtype=np.int32), size), table["terms"].combine_chunks().flatten().to_numpy()
    value = (1 + np.log(table["counts"].combine_chunks().flatten().to_numpy())) * model.weights[term]
    norm = np.sqrt(np.bincount(example, value * value, len(size)))
    order, cut = _runs(term, example // BLOCK)
    model.examples, model.values = example[order], (value / norm[example])[order].astype(np.float32)
    model.starts = np.append(cut, len(order)).astype(np.int32)
    model.blocks = (model.examples[cut] // BLOCK).astype(np.int32)
    model.maxima = np.maximum.reduceat(model.values, cut) if len(cut) else model.values
    model.entries = np.searchsorted(term[order][cut], np.arange(len(words) + len(stems) + 1)).astype(np.int32)
    votes, truth = _votes(vectors, model)
    if len(votes):
        model.steps, model.rates = _isotonic(votes, truth.astype(float), np.where(truth == 1, weight_of_one, 1.0))
    return model


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Per row: doc_id, score, neighbours and cosines (the evidence, nearest first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(model.words, model.stems)
        for b in batches:
            n = b.num_rows
            scores, near, cosines = np.full(n, model.rate), [[]] * n, [[]] * n
            for r, terms, counts in vocabulary.rows(b.column(1)):
                found, cosine = model.nearest(terms, model.vector(terms, counts))
                if len(found):
                    scores[r] = model.score(model.vote(found, cosine))
                    near[r], cosines[r] = model.ids[found].tolist(), cosine.tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.clip(scores, 0, 1)), pa.array(near, pa.list_(pa.int64())), pa.array(cosines, pa.list_(pa.float64()))], names=["doc_id", "score", "neighbours", "cosines"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, neighbours array<long>, cosines array<double>")
