"""Scorers: the probability that a boundary follows each character.

A scorer turns a batch of texts into float32 vectors, one value for each code point.  ``RuleScorer`` and ``HashedLinearScorer`` need
no files; ``OnnxScorer`` wraps a token classifier exported to ONNX; any object with ``scores`` will do.
"""

from __future__ import annotations

from functools import cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import PRIMES, let

SPACES = frozenset(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
SENTENCE_ENDS = ".!?…。！？"
NEWLINE_P, END_P = 0.9, 0.4
_IS_SPACE = np.zeros(0x3001, bool)
_IS_SPACE[[ord(c) for c in SPACES]] = True


class Scorer(Protocol):
    def scores(self, texts: list[str], langs: list[str | None] | None = None) -> list[np.ndarray]:
        """For each text a float32 vector as long as the text.

        A scorer can also have ``flat(cp, starts)``: the same for the code points of texts that follow each other, begun at starts.
        """


def points(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def spaces(cp: np.ndarray) -> np.ndarray:
    return _IS_SPACE[np.minimum(cp, 0x3000)] & (cp <= 0x3000)


class RuleScorer:
    """0.9 for a line break, 0.4 for a closing mark before white space or the end, else 0."""

    _table = np.zeros(0x10000, np.uint8)  # 1 for a closing mark, 2 for a line break
    _table[[ord(c) for c in SENTENCE_ENDS]] = 1
    _table[10] = 2

    def flat(self, cp: np.ndarray, starts: np.ndarray) -> np.ndarray:
        kind = np.where(cp < 0x10000, self._table[np.minimum(cp, 0xFFFF)], 0)
        p = np.zeros(len(cp), np.float32)
        p[kind == 2] = NEWLINE_P
        at = np.flatnonzero(kind == 1)
        last = np.zeros(len(cp) + 1, bool)
        last[starts] = True  # the next code point begins another text
        p[at[last[at + 1] | spaces(cp[np.minimum(at + 1, len(cp) - 1)])]] = END_P
        return p

    def scores(self, texts: list[str], langs: list[str | None] | None = None) -> list[np.ndarray]:
        return [self.flat(cp, np.array([0, len(cp)])) for cp in map(points, texts)]


class HashedLinearScorer:
    """Logistic model over hashed characters around each position; see train_linear_scorer()."""

    def __init__(self, weights: np.ndarray, intercept: float, buckets: int, reach: int = 3):
        self.weights, self.intercept, self.buckets, self.reach = weights, intercept, buckets, reach

    def scores(self, texts: list[str], langs: list[str | None] | None = None) -> list[np.ndarray]:
        out = []
        for text in texts:
            x = context_buckets(points(text), self.buckets, self.reach)
            z = self.weights[x].sum(axis=1) + self.intercept if len(x) else np.zeros(0)
            out.append(sigmoid(z))
        return out


class OnnxScorer:
    """Scores of an exported character model with inputs ``input_ids`` and ``attention_mask`` and logits of label 0 for boundaries.

    Long texts are read in overlapping windows whose logits are averaged.  The session is made once per worker.
    """

    def __init__(self, path: str, block: int = 512, stride: int = 256, providers: tuple[str, ...] = ("CPUExecutionProvider",)):
        self.path, self.block, self.stride, self.providers = path, block, stride, providers

    def scores(self, texts: list[str], langs: list[str | None] | None = None) -> list[np.ndarray]:
        from .chunk import overlap_average, windows

        session = _session(self.path, self.providers)
        out = []
        for text in texts:
            ids = points(text).astype(np.int64)
            spans = windows(len(ids), self.block, self.stride)
            parts = [session.run(None, {"input_ids": ids[None, a:b], "attention_mask": np.ones((1, b - a), np.int64)})[0][0, :, 0] for a, b in spans]
            out.append(sigmoid(overlap_average(len(ids), spans, parts)))
        return out


@cache
def _session(path: str, providers: tuple[str, ...]):
    import onnxruntime

    return onnxruntime.InferenceSession(path, providers=list(providers))


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In float32; 0 for minus infinity."""
    with np.errstate(over="ignore"):
        return (1 / (1 + np.exp(-np.asarray(x, np.float32)))).astype(np.float32)


def sigmoid_column(logits: Column) -> Column:
    return F.transform(logits, lambda x: (F.lit(1.0) / (F.lit(1.0) + F.exp(-x.cast("double")))).cast("float"))


def context_buckets(cp: np.ndarray, buckets: int, reach: int) -> np.ndarray:
    """For each position the hashed characters from reach before to reach after it: int64 [n, 2 reach + 1]."""
    padded = np.concatenate([np.zeros(reach, np.int64), cp.astype(np.int64) + 1, np.zeros(reach, np.int64)])
    width = 2 * reach + 1
    return np.stack([(padded[k : k + len(cp)] * PRIMES[k % len(PRIMES)] + k * 7919) % buckets for k in range(width)], axis=1)


def without_spaces(scorer: Scorer, texts: list[str], langs: list[str | None] | None = None) -> list[np.ndarray]:
    """Scores texts without U+0020 and gives the blanks probability 0."""
    out = []
    for text, p in zip(texts, scorer.scores([t.replace(" ", "") for t in texts], langs), strict=True):
        whole = np.zeros(len(text), np.float32)
        whole[points(text) != 32] = p
        out.append(whole)
    return out


def probabilities(scorer: Scorer, texts: list[str | None], langs: list[str | None] | None = None, remove_spaces: bool = False, blank: bool = False) -> list[np.ndarray | None]:
    """As the scorer gives them; [0] for a blank text, which isn't scored unless blank is set; None for null."""
    full = [i for i, t in enumerate(texts) if t is not None and (blank or not all(c in SPACES for c in t))]
    chosen, own = [texts[i] for i in full], [langs[i] for i in full] if langs else None
    scored = without_spaces(scorer, chosen, own) if remove_spaces else scorer.scores(chosen, own)
    out: list[np.ndarray | None] = [None if t is None else np.zeros(1, np.float32) for t in texts]
    for i, p in zip(full, scored, strict=True):
        out[i] = p
    return out


def predict_proba(df: DataFrame, scorer: Scorer | None = None, text: str = "text", lang: str | Column | None = None, out: str = "probs", remove_spaces: bool = False, style=None, both: bool = False, blank: bool = False) -> DataFrame:
    """Adds array<float>, a probability for each character.

    style: see segment.Style; its sentence probabilities.  both: struct<sentence, newline>, of which newline holds the scorer's own.
    blank: texts of nothing but white space, or of nothing, are scored like others and don't get [0].
    """
    from . import flat

    scorer = scorer or RuleScorer()
    kind = pa.list_(pa.float32())

    def newline(texts: pa.Array, langs: pa.Array) -> pa.Array:
        return pa.array(probabilities(scorer, texts.to_pylist(), langs.to_pylist(), True, blank), kind) if remove_spaces else flat.probability_lists(scorer, texts, langs, blank)

    def sentence(own: pa.Array, langs: pa.Array) -> pa.Array:
        if style is None:
            return own
        return pa.array([None if p is None else style.probabilities(np.array(p, np.float32), x) for p, x in zip(own.to_pylist(), langs.to_pylist(), strict=True)], kind)

    if both:

        @F.arrow_udf("struct<sentence:array<float>,newline:array<float>>")
        def probs(texts: pa.Array, langs: pa.Array) -> pa.Array:
            own = newline(texts, langs)
            return pa.StructArray.from_arrays([sentence(own, langs), own], ["sentence", "newline"])
    else:

        @F.arrow_udf("array<float>")
        def probs(texts: pa.Array, langs: pa.Array) -> pa.Array:
            return sentence(newline(texts, langs), langs)

    return df.withColumn(out, probs(text, F.lit(None).cast("string") if lang is None else F.col(lang) if isinstance(lang, str) else lang))


def token_probabilities(n_chars: Column, ends: Column, logits: Column) -> Column:
    """A token's sigmoid at its last character, 0 elsewhere; tokens that end at 0 are dropped."""
    at = F.map_from_entries(F.filter(F.arrays_zip(ends.alias("e"), logits.alias("x")), lambda t: t["e"] > 0))
    p = lambda x: F.coalesce(F.lit(1.0) / (F.lit(1.0) + F.exp(-x)), F.lit(0.0)).cast("float")
    found = let(at, lambda m: F.transform(F.sequence(F.lit(1), n_chars), lambda i: p(F.try_element_at(m, i))))
    return F.when(n_chars > 0, found).otherwise(F.array().cast("array<float>"))


def linear_probability(x: Column, coefficients: list[float], intercept: float) -> Column:
    """Logistic model over an array column: the style classifier."""
    weights = F.array(*[F.lit(float(c)) for c in coefficients])
    dot = F.aggregate(F.zip_with(x, weights, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(dot + F.lit(float(intercept)))))


def train_linear_scorer(docs: DataFrame, text: str = "text", buckets: int = 4096, reach: int = 3, max_rows: int = 200_000, rate: float = 0.02) -> HashedLinearScorer:
    """Learns where line breaks are from the text itself: each position's label is whether a line break follows, and line breaks are hidden.

    Fitted on a sample of positions: all before line breaks and, of the others, the given rate by hash of place.  Positions that look alike are
    counted together; of more than max_rows different ones those with the least hashes are used, whatever the partitions.
    """

    def rows(batches):
        for b in batches:
            labels, indices, keys = [], [], []
            for t in b.column(0).to_pylist():
                cp = points(t or "")
                follows = np.zeros(len(cp), bool)
                follows[:-1] = cp[1:] == 10
                keep = cp != 10
                follows, cp = follows[keep], cp[keep]
                if len(cp) == 0:
                    continue
                place = (np.arange(len(cp)) * 2654435761 + int(cp[:64].sum()) * 97) % 10_000
                take = np.flatnonzero(follows | (place < rate * 10_000))
                x = context_buckets(cp, buckets, reach)[take]
                labels += follows[take].astype(float).tolist()
                indices += x.tolist()
                keys += (_mixed(x) >> np.uint64(1)).astype(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.float64()), pa.array(indices, pa.list_(pa.int64())), pa.array(keys, pa.int64())], ["label", "at", "hash"])

    counted = docs.select(text).mapInArrow(rows, "label double, at array<long>, hash long").groupBy("label", "at", "hash").agg(F.count("*").cast("double").alias("n"))
    # places that look alike are one row with a weight; of different ones those with the least hashes count
    sample = counted.orderBy("hash", "label", "at").limit(max_rows)
    total = max(1, int(sample.agg(F.sum("n")).first()[0] or 0))
    got = sample.select("label", "n", "at").toArrow()
    x = np.array(got["at"].combine_chunks().flatten()).reshape(len(got), 2 * reach + 1)
    weights, intercept = _logistic(x, got["label"].to_numpy(), got["n"].to_numpy() / total, buckets, 1 / total)
    return HashedLinearScorer(weights, intercept, buckets, reach)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash of each row of whole numbers."""
    h = np.zeros(len(x), np.uint64)
    for c in x.T:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray, buckets: int, l2: float, steps: int = 1500) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on rows that name the places of their ones, by accelerated gradient steps; the intercept isn't penalised."""
    width = x.shape[1]
    rate = 4 / (2 * width + 1)
    w = v = np.zeros(buckets + 1)
    t = 1.0
    for _ in range(steps):
        z = v[x].sum(axis=1) + v[-1]
        r = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        gradient = np.append(np.bincount(x.ravel(), np.repeat(r, width), buckets) + l2 * v[:-1], r.sum())
        if np.abs(gradient).max() < 1e-7:
            break
        new = v - rate * gradient
        t = 1.0 if gradient @ (new - w) > 0 else t  # momentum that leads uphill is dropped
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w[:-1], float(w[-1])
