"""Language identification with string kernels.

Texts are lower-cased; letters stay, all else counts as one space (beyond ASCII: U+0080 to U+00BF, U+2000 to U+2FFF and all above U+FFFF).  The blended-spectrum presence kernel of two texts is the
number of n-grams (n = 1, 2, 3) that occur in both, divided by the root of the product of their own numbers.  N-grams of 2
and 3 bytes are told apart by hashes into 2**13 and 2**15 places.  A Nystrom map with landmark texts turns
kernel ridge regression into a linear problem: with K the landmarks' kernel matrix, texts become k(x, landmarks) K^(-1/2), and one
ridge regression per language (target 1 or -1) is solved in closed form.  A text's score for all languages is then one product
of its presence vector with a matrix; batches of texts are scored by one matrix product.

The classifier is fitted on at most ``PER_LANGUAGE`` labelled rows of each language, those with the least hash of id and text.  The driver gets
their presence vectors as bits, 5 KB each, not their texts.  There are ``LANDMARKS`` landmarks, or ``LEAST_LANDMARKS`` for each language if that is more.

A text is rejected if its best score is under ``MIN_SCORE`` or less than ``MIN_MARGIN`` above the second: texts in languages or
scripts that the classifier hasn't seen share few n-grams with any landmark, and all their scores are alike.

Cases: a text without any letter (null and empty ones among them) has no language (null), score and margin 0, and is
rejected.  Texts are read whole.  Rows that repeat are classified each for themselves, a null
``doc_id`` is carried along, and equal scores go to the language first in the alphabet.  Without at least two labelled languages
nothing can be told: every text with a letter is kept with a null language.  An empty table stays empty.  Further columns aren't read, or stay in accepted().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import _flat
from ._spark import table

PER_LANGUAGE = 400
LANDMARKS = 160
LEAST_LANDMARKS = 8
RIDGE = 1e-2
MIN_SCORE = -0.3
MIN_MARGIN = 0.03
ROWS = 128

_CLASS = np.zeros(256, np.uint16)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = np.arange(27, 155)
_TWO, _THREE = 13, 15
PLACES = 256 + (1 << _TWO) + (1 << _THREE)


def _classes(data: np.ndarray) -> np.ndarray:
    """Each byte's class; 0 for what isn't a letter."""
    c = _CLASS[data]
    for lead, n in ((0xC2, 2), (0xE2, 3), (0xF0, 4)):  # signs of Latin-1, punctuation and symbols, emoji
        at = np.flatnonzero(data == lead)
        for k in range(n):
            c[np.minimum(at + k, len(c) - 1)] = 0
    return c


def presence(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each text which n-grams it has: float32 [texts, PLACES]."""
    n = len(ends) - 1
    out = np.zeros((n, PLACES), np.float32)
    flat = out.ravel()
    c = _classes(data)
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(ends))
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] > 0) | (c[:-1] > 0) | (doc[1:] != doc[:-1])
    c, doc = c[keep].astype(np.int64), doc[keep]
    base = doc * PLACES
    flat[base + c] = 1
    pair = c[:-1] * 155 + c[1:]
    same = doc[:-1] == doc[1:]
    flat[(base[:-1] + 256 + ((pair * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - _TWO)))[same]] = 1
    triple = pair[:-1] * 155 + c[2:]
    same = doc[:-2] == doc[2:]
    flat[(base[:-2] + 256 + (1 << _TWO) + ((triple * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - _THREE)))[same]] = 1
    return out


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """Presence vectors of a bounded number of texts and characters at a time."""
    for low, high in _flat.slices(texts):
        for a in range(low, high, ROWS):
            b = min(high, a + ROWS)
            yield a, b, presence(*_flat.utf8(texts.slice(a, b - a)))


def has_letters(texts: pa.Array) -> np.ndarray:
    out = []
    for low, high in _flat.slices(texts):
        data, ends = _flat.utf8(texts.slice(low, high - low))
        hits = np.concatenate([[0], np.cumsum(_classes(data) > 0)])
        out.append(hits[ends[1:]] > hits[ends[:-1]])
    return np.concatenate(out) if out else np.zeros(0, bool)


class Model:
    """languages, and the matrix [PLACES, languages] by which a presence vector, over the root of its sum, is multiplied."""

    def __init__(self, languages: list[str], matrix: np.ndarray):
        self.languages, self.matrix = languages, matrix

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros((len(texts), len(self.languages)))
        for a, b, p in _blocks(texts):
            out[a:b] = p @ self.matrix / np.sqrt(np.maximum(p.sum(axis=1), 1))[:, None]
        return out


def _packed(texts: pa.Array) -> Iterator[np.ndarray]:
    """Presence vectors as bits: uint8 [texts, PLACES / 8]."""
    for _, _, p in _blocks(texts):
        yield np.packbits(p > 0, axis=1)


def fit(texts: list[str], languages: list[str], **options) -> Model:
    return fit_presence(np.concatenate([*_packed(pa.array(texts, pa.string())), np.zeros((0, PLACES // 8), np.uint8)]), languages, **options)


def fit_presence(packed: np.ndarray, languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fits on presence vectors as bits; of each language the first ones are landmarks."""
    names = sorted(set(languages))
    if len(names) < 2:
        return Model([], np.zeros((PLACES, 0), np.float32))

    def unit(x: np.ndarray) -> np.ndarray:
        p = np.unpackbits(x, axis=1).astype(np.float32)
        return p / np.sqrt(np.maximum(p.sum(axis=1), 1))[:, None]

    label = np.searchsorted(names, languages)
    rank = np.zeros(len(label), np.int64)  # landmarks are taken from the languages in turn
    for k in range(len(names)):
        own = np.flatnonzero(label == k)
        rank[own] = np.arange(len(own))
    marks = np.lexsort((label, rank))[: max(landmarks, LEAST_LANDMARKS * len(names))]
    kernel = np.empty((len(label), len(marks)))
    for m in range(0, len(marks), 512):
        at_marks = unit(packed[marks[m : m + 512]])
        for a in range(0, len(label), 512):
            kernel[a : a + 512, m : m + 512] = unit(packed[a : a + 512]) @ at_marks.T
    values, vectors = np.linalg.eigh(kernel[marks])
    root = vectors * np.where(values > 1e-6, 1 / np.sqrt(np.maximum(values, 1e-6)), 0) @ vectors.T
    phi = kernel @ root
    target = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0)
    balance = 1 / np.bincount(label)[label][:, None]
    weights = root @ np.linalg.solve(phi.T @ (phi * balance) + ridge * np.eye(len(marks)), phi.T @ (target * balance))
    matrix = sum(unit(packed[marks[m : m + 512]]).T @ weights[m : m + 512] for m in range(0, len(marks), 512))
    return Model(names, matrix.astype(np.float32))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, **options) -> Model:
    """Fits on rows whose lang isn't null and whose text has a letter."""
    counts = docs.where("lang is not null").groupBy("lang").count().collect()
    rate = F.lit(1.0)  # of rows that can be among the first: four times as many as are needed
    for r in counts:
        if r["count"] > 4 * per_language:
            rate = F.when(F.col("lang") == r["lang"], F.lit(4 * per_language / r["count"])).otherwise(rate)
    rows = docs.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id", "text").alias("hash"))
    rows = rows.where(F.pmod("hash", F.lit(1 << 40)) < rate * (1 << 40)).where("text rlike '\\\\p{L}'").select("lang", F.lower("text").alias("text"), F.pmod("hash", F.lit(1 << 40)).alias("hash"))
    first = Window.partitionBy("lang").orderBy("hash", "text")
    taken = rows.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= per_language).select("lang", "rank", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [row.tobytes() for block in _packed(b.column(2)) for row in block]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bits, pa.binary())], ["lang", "rank", "bits"])

    got = taken.mapInArrow(pack, "lang string, rank int, bits binary").toArrow().sort_by([("lang", "ascending"), ("rank", "ascending")])
    packed = np.frombuffer(b"".join(got["bits"].to_pylist()), np.uint8).reshape(-1, PLACES // 8)
    return fit_presence(packed, got["lang"].to_pylist(), **options)


_RESULT = "struct<lang:string,score:double,margin:double,kept:boolean>"


def _classify(model: Model, min_score: float, min_margin: float):
    @F.arrow_udf(_RESULT)
    def classify(texts: pa.Array) -> pa.Array:
        letters = has_letters(texts)
        if model.languages:
            s = model.scores(texts)
            best = s.argmax(axis=1)
            top = np.where(letters, s[np.arange(len(s)), best], 0.0)
            margin = np.where(letters, top - np.sort(s, axis=1)[:, -2], 0.0)
            names = [model.languages[k] if here else None for k, here in zip(best, letters, strict=True)]
            kept = letters & (top >= min_score) & (margin >= min_margin)
        else:
            top, margin, names, kept = np.zeros(len(texts)), np.zeros(len(texts)), [None] * len(texts), letters
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.round(top, 4)), pa.array(np.round(margin, 4)), pa.array(kept)], ["lang", "score", "margin", "kept"])

    return classify(F.lower("text"))


def identify(docs: DataFrame, model: Model | None = None, min_score: float = MIN_SCORE, min_margin: float = MIN_MARGIN) -> DataFrame:
    """(doc_id, lang, score, margin, kept) for every row."""
    model = model or train(docs)
    rows = docs.select("doc_id", _classify(model, min_score, min_margin).alias("r"))
    return rows.select("doc_id", "r.lang", "r.score", "r.margin", "r.kept")


def accepted(docs: DataFrame, model: Model | None = None, min_score: float = MIN_SCORE, min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows that aren't rejected; all columns stay as they are."""
    model = model or train(docs)
    return docs.where(_classify(model, min_score, min_margin)["kept"])


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
