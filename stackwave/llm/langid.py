"""Language ID with error-correcting output codes.

Every language gets a codeword of a Hadamard code (any two differ in half of the bits).  For each bit a binary logistic
classifier on hashed byte 2- and 3-grams predicts it.  Decoding takes the codeword with the least sum of logistic losses,
each bit weighted by how well its classifier does on the training rows; close runners-up flag the row as ambiguous.

The features are square roots of relative n-gram frequencies of the whole text, ASCII lower-cased, with digits, white
space and ASCII punctuation all read as one space.  Training takes at most about ``CAP`` rows of each language
and ``TOTAL`` of all; their features are made on the executors.

A null text or one without letters is ``und`` with score 0, as is every text when nothing is labelled.  With one language
only, that is predicted.  Ties go to the language first by code point.  Repeated rows get equal results; an empty table
gives an empty one.  lang, source and doc_id are never features.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import bounded, crc_mod
from .textkit import row_slices, string_buffers

#: Training rows of each language, and of all languages together.
CAP, TOTAL = 512, 4096
DIMENSIONS_LOG2 = 12
STEPS = 120
#: Less than this between the two best posteriors is ambiguous; so is a best posterior under SURE.
AMBIGUOUS, SURE = 0.1, 0.4
#: Rows of a batch that are filtered at a time, so that no second copy of a whole batch is held.
PIECE = 1024
_D = 1 << DIMENSIONS_LOG2
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32
_LETTER = regex.compile(r"\p{L}")


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, matrix of unit rows, which rows hold an ASCII letter) for slices of a string column."""
    raw, offs = string_buffers(column)
    for lo, hi in row_slices(offs, rows=256):
        seg, at, n = _FOLD[raw[offs[lo] : offs[hi]]], offs[lo : hi + 1] - offs[lo], hi - lo
        row = np.repeat(np.arange(n, dtype=np.int64), np.diff(at)) * _D
        counts = np.zeros(n * _D)
        for size, salt in ((2, 0x9E3779B1), (3, 0x85EBCA77)):
            if len(seg) < size:
                continue
            gram = seg[: len(seg) - size + 1].copy()
            for j in range(1, size):
                gram = (gram << np.uint32(8)) | seg[j : len(seg) - size + 1 + j]
            gram = (gram + np.uint32(size)) * np.uint32(salt)
            gram ^= gram >> np.uint32(15)
            gram *= np.uint32(0x2C1B3C6D)
            key = row[: len(gram)] + (gram >> np.uint32(32 - DIMENSIONS_LOG2))
            inside = row[: len(gram)] == row[size - 1 :]
            counts += np.bincount(key[inside], minlength=n * _D)
        counts = counts.reshape(n, _D)
        counts /= np.maximum(counts.sum(1, keepdims=True), 1)
        letters = np.zeros(len(seg) + 1, np.int64)
        np.cumsum((seg >= 97) & (seg <= 122), out=letters[1:])
        yield lo, hi, np.sqrt(counts, out=counts).astype(np.float32), np.diff(letters[at]) > 0


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1; every two differ in half of the columns."""
    h = np.ones((1, 1))
    while len(h) < 2 * n or len(h) < 8:
        h = np.block([[h, h], [h, -h]])
    h = h[1 : n + 1]
    h = h[:, (h != h[:1]).any(0)] if n > 1 else h[:, :1]
    return h * h[:1]  # columns that say the same about the languages are weighted, not dropped


@dataclass
class LanguageModel:
    langs: list[str]
    codes: np.ndarray
    weights: np.ndarray
    mean: np.ndarray
    bias: np.ndarray
    bit_weights: np.ndarray

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        """(rows, languages): softmax of minus the weighted logistic losses."""
        margin = (x - self.mean) @ self.weights + self.bias
        loss = np.logaddexp(0, -margin[:, None, :] * self.codes[None]) @ self.bit_weights
        p = np.exp(loss.min(1, keepdims=True) - loss)
        return p / p.sum(1, keepdims=True)


def fit(labelled: DataFrame, cap: int = CAP) -> LanguageModel:
    """Learns from rows (doc_id, text, lang) with a non-null lang; see the bound in the module's text."""
    rows = labelled.filter("lang is not null and doc_id is not null").select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
    many = rows.select("lang").distinct().count()
    sample, _ = bounded(rows, "lang", max(1, min(cap, TOTAL // max(1, many))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, x, _ in features(b.column(2)):
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], names=["doc_id", "lang", "x"])

    table = sample.mapInArrow(run, "doc_id long, lang string, x binary").toArrow()
    parts = [np.frombuffer(c.buffers()[2], np.float16, (c.offset + len(c)) * _D).reshape(-1, _D)[c.offset :] for c in table["x"].chunks if len(c)]  # values of one length, side by side
    hashes = [zlib.crc32(r) for part in parts for r in part]
    order = pa.table({"lang": table["lang"], "doc_id": table["doc_id"], "h": pa.array(hashes, pa.int64()), "at": pa.array(np.arange(len(hashes)))}).sort_by([("lang", "ascending"), ("doc_id", "ascending"), ("h", "ascending")])
    names = np.array(order["lang"].to_pylist(), object)
    langs = sorted(set(names))
    if not langs:
        return LanguageModel([], np.zeros((0, 0)), np.zeros((_D, 0)), np.zeros(_D), np.zeros(0), np.zeros(0))
    place, x, at = np.argsort(order["at"].to_numpy()), np.empty((len(names), _D), np.float32), 0
    for part in parts:
        x[place[at : at + len(part)]] = part
        at += len(part)
    del table, parts, part
    codes = codewords(len(langs))
    y = codes[np.searchsorted(np.array(langs, object), names)]
    mean = x.mean(0)
    x -= mean
    share = np.array([1 / (len(langs) * (names == v).sum()) for v in names])[:, None].astype(np.float32)
    w, bias = np.zeros((_D, codes.shape[1]), np.float32), np.zeros(codes.shape[1], np.float32)
    v, c, rate, ridge = w.copy(), bias.copy(), np.float32(12.0), np.float32(1e-5)
    for step in range(STEPS):  # Nesterov on the mean logistic loss
        g = -y / (1 + np.exp(np.clip(y * (x @ v + c), -50, 50))) * share
        nw, nb = v - rate * (x.T @ g + ridge * v), c - rate / 8 * g.sum(0)
        k = step / (step + 3)
        v, c, w, bias = nw + k * (nw - w), nb + k * (nb - bias), nw, nb
    right = ((x @ w + bias) * y > 0).mean(0)
    return LanguageModel(langs, codes, w, mean, bias, np.maximum(np.log(np.maximum(right, 0.5) / np.maximum(1 - right, 1e-3)), 1e-3) / np.log(1e3))


def _predict(model: LanguageModel, texts: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
    """Predicted language, score and ambiguity of each text."""
    n = len(texts)
    lang, score, doubt = np.full(n, "und", object), np.zeros(n), np.ones(n, bool)
    names = np.array(model.langs, object)
    for lo, hi, x, has in features(texts):
        for r in np.flatnonzero(~has):
            has[r] = bool(_LETTER.search(texts[lo + int(r)].as_py() or ""))
        if len(names):
            p = model.posteriors(x)
            best = p.argmax(1)
            top = p[np.arange(hi - lo), best]
            p[np.arange(hi - lo), best] = 0
            doubtful = (top - p.max(1) < AMBIGUOUS) | (top < SURE) if len(names) > 1 else np.zeros(hi - lo, bool)
            lang[lo:hi], score[lo:hi], doubt[lo:hi] = np.where(has, names[best], "und"), np.where(has, np.clip(top, 0, 1), 0.0), ~has | doubtful
    return lang.tolist(), score, doubt


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Per row: doc_id, lang_pred, score, ambiguous."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, doubt = _predict(model, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(doubt)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def known_only(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text has a language: not ``und``, and not both ambiguous and under SURE."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, PIECE):
                b = whole.slice(k, PIECE)
                lang, score, doubt = _predict(model, b.column(at))
                yield b.filter(pa.array((np.array(lang, object) != "und") & ~(doubt & (score < SURE))))

    return docs.mapInArrow(run, docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: crc32 of the id not 1 modulo 3, lang given."""
    return docs.filter(crc_mod("doc_id", 3) != 1)


def with_fold(found: DataFrame) -> DataFrame:
    """Adds held_out: the row's id belongs to the fold that is never learned from (false for a null id)."""
    return found.withColumn("held_out", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)))
