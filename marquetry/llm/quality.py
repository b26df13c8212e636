"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of each text are counted in one pass over its bytes, a batch of texts at a time.  On a bounded sample of labelled rows small regression trees are boosted; each
path from a root to an inner node or leaf is a rule, a conjunction of comparisons of statistics with thresholds.  A logistic
model over the rules is fitted with an L1 penalty, so that few rules keep a weight, and these are compiled into one Spark column
expression, which scores the rows in the JVM.  A word is a run of characters that aren't space, tab or line break.

Cases: a null text, or one without any character that isn't white space, has quality 0 and isn't kept.  Without labelled rows of both
qualities nothing can be learnt: quality is null and texts are kept.  Labels that are null, or belong to no document, are ignored; of labels that repeat a
``doc_id`` the greatest quality counts, and of rows that repeat one, all are used.  Each row is scored for itself, whole,
and a null ``doc_id`` is carried along.  A quality of just ``MIN_QUALITY`` is kept.  An empty table gives an empty result.  Further columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import _flat
from ._spark import table

SAMPLE = 8000
TREES = 24
DEPTH = 3
LEARNING_RATE = 0.3
PENALTY = 0.002
MIN_QUALITY = 0.5
_CUTS = 24

STATISTICS = ["chars", "word_length", "distinct_words", "upper", "digits", "stops", "symbols", "exclaims", "distinct_lines", "words_per_line"]


_BLANK = np.isin(np.arange(256), [ord(c) for c in " \t\r\n"])
#: Kinds of characters that are counted, by byte.
_KINDS = {name: np.isin(np.arange(256), [ord(c) for c in chars]) for name, chars in (("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digits", "0123456789"), ("stops", ".,;:?"), ("symbols", "#$%&*@|<>{}[]=~^_\\/+"), ("exclaims", "!"))}


def _of_slice(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Statistics of each text: float64 [texts, STATISTICS]."""

    def per_text(places: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(places, ends))

    first, last = ends[:-1], ends[1:]
    chars = np.maximum(np.diff(ends) - per_text(np.flatnonzero((data & 0xC0) == 0x80)), 1)
    inside = np.concatenate([~_BLANK[data], [False]])
    joined = inside[:-1] & inside[1:]  # with the next byte
    joined[last[(last > 0) & (last < len(data))] - 1] = False
    begin = np.flatnonzero(inside[:-1] & ~np.concatenate([[False], joined])[: len(data)])
    end = np.flatnonzero(inside[:-1] & ~joined) + 1
    starts = np.searchsorted(begin, ends)
    words = np.maximum(np.diff(starts), 1)
    distinct_words = np.maximum(np.diff(_flat.distinct(_flat.spans(data, begin, end), starts)[1]), 1)
    breaks = np.flatnonzero(data == 10)
    # a text has a line more than it has line breaks
    line_begin = np.sort(np.concatenate([first, breaks + 1]), kind="stable")
    line_end = np.sort(np.concatenate([last, breaks]), kind="stable")
    lines = per_text(breaks) + 1
    line_starts = np.concatenate([[0], np.cumsum(lines)])
    distinct_lines = np.diff(_flat.distinct(_flat.spans(data, line_begin, line_end), line_starts)[1])
    shares = [per_text(np.flatnonzero(kind[data])) / chars for kind in _KINDS.values()]
    return np.column_stack([np.log1p(chars), chars / words, distinct_words / words, *shares, distinct_lines / lines, words / lines])


def _of_texts(texts: pa.Array) -> np.ndarray:
    found = [_of_slice(*_flat.utf8(texts.slice(low, high - low))) for low, high in _flat.slices(texts)]
    return np.concatenate(found) if found else np.zeros((0, len(STATISTICS)))


def statistics(text: Column) -> Column:
    """A struct of STATISTICS."""

    @F.arrow_udf("struct<" + ",".join(f"{name}:double" for name in STATISTICS) + ">")
    def of(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in _of_texts(texts).T], STATISTICS)

    return of(F.coalesce(text, F.lit("")))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, whether above, threshold), all of which hold


def _tree(x: np.ndarray, gradient: np.ndarray, cuts: list[np.ndarray], depth: int, least: int, path: Rule, here: np.ndarray, rules: dict[Rule, None], out: np.ndarray) -> None:
    """Grows a regression tree on the rows here: its paths go to rules, its predictions to out."""
    if path:
        rules.setdefault(path)
    g = gradient[here]
    out[here] = g.mean()
    if len(path) == depth or len(here) < 2 * least:
        return
    best = (1e-9, -1, 0.0)
    for j, own in enumerate(cuts):
        for c in own:
            low = x[here, j] <= c
            n = int(low.sum())
            if least <= n <= len(here) - least:
                s = g[low].sum()
                gain = s * s / n + (g.sum() - s) ** 2 / (len(here) - n) - g.sum() ** 2 / len(here)
                if gain > best[0] + 1e-12:
                    best = (gain, j, float(c))
    _, j, c = best
    if j >= 0:
        low = x[here, j] <= c
        for above, part in ((False, here[low]), (True, here[~low])):
            _tree(x, gradient, cuts, depth, least, (*path, (j, above, c)), part, rules, out)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, j] > c) == above for j, above, c in rule])


def _lasso(z: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """L1-penalised logistic regression by accelerated proximal gradient steps; the intercept isn't penalised."""
    a = np.column_stack([z, np.ones(len(z))])
    rate = 4 / np.linalg.norm(a * np.sqrt(weight)[:, None], 2) ** 2
    w = v = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ v, -30, 30)))
        u = v - rate * (a.T @ (weight * (p - y)))
        u[:-1] = np.sign(u[:-1]) * np.maximum(np.abs(u[:-1]) - rate * penalty, 0)
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = u + (t - 1) / t_next * (u - w), u, t_next
    return w[:-1], float(w[-1])


class Model:
    """Rules with their weights, and the intercept; none if nothing could be learnt."""

    def __init__(self, rules: list[tuple[Rule, float]], intercept: float | None):
        self.rules, self.intercept = rules, intercept

    def column(self, s: str = "s") -> Column:
        """Quality by the struct of statistics s."""
        if self.intercept is None:
            return F.lit(None).cast("double")
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            condition = F.lit(True)
            for j, above, c in rule:
                x = F.col(f"{s}.{STATISTICS[j]}")
                condition = condition & (x > c if above else x <= c)
            total = total + F.when(condition, F.lit(weight)).otherwise(F.lit(0.0))
        return F.round(1 / (1 + F.exp(-total)), 6)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + sum((w * holds(r, x) for r, w in self.rules), np.zeros(len(x))))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> Model:
    """Fits on statistics and qualities (0 or 1); both qualities have the same total weight."""
    if len(np.unique(y)) < 2:
        return Model([], None)
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    cuts = [np.unique(np.round(np.quantile(c, np.linspace(0.02, 0.98, _CUTS)), 9)) for c in x.T]
    rng = np.random.default_rng(10)
    rules: dict[Rule, None] = {}
    f = np.zeros(len(y))
    for _ in range(trees):
        residual = (y - 1 / (1 + np.exp(-f))) * weight * len(y)
        here = np.sort(rng.permutation(len(y))[: max(2, len(y) // 2)])
        _tree(x, residual, cuts, depth, max(3, len(y) // 400), (), here, rules, np.zeros(len(y)))
        step = np.zeros(len(y))
        _tree(x, residual, cuts, depth, max(3, len(y) // 400), (), np.arange(len(y)), rules, step)
        f += LEARNING_RATE * 4 * step
    names, seen = [], set()
    for rule in rules:
        z = holds(rule, x)
        key = z.tobytes()
        if 0 < z.sum() < len(y) and key not in seen:  # rules that hold for the same rows are one
            seen.add(key)
            names.append(rule)
    if not names:
        return Model([], float(np.log(weight[y == 1].sum() / weight[y == 0].sum())))
    weights, intercept = _lasso(np.column_stack([holds(r, x) for r in names]).astype(float), y.astype(float), weight, penalty)
    return Model([(r, float(w)) for r, w in zip(names, weights, strict=True) if abs(w) > 1e-6], intercept)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options) -> Model:
    """Fits on the labelled documents with the least hashes of id, at most so many labels.

    The labels taken are broadcast, as their number is bounded.
    """
    chosen = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").alias("label_id")).agg(F.max("quality").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    rows = docs.where(~_blank(F.col("text"))).select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    got = rows.select("label_id", "label", statistics(F.col("text")).alias("s")).select("label_id", "label", "s.*").collect()
    got.sort()
    return fit(np.array([r[2:] for r in got], float).reshape(len(got), len(STATISTICS)), np.array([r[1] for r in got], np.int64), **options)


def _blank(text: Column) -> Column:
    return ~F.coalesce(text.rlike("[^ \\t\\r\\n]"), F.lit(False))


def score(docs: DataFrame, model: Model, min_quality: float = MIN_QUALITY) -> DataFrame:
    """(doc_id, quality, kept) for every row."""
    rows = docs.select("doc_id", _blank(F.col("text")).alias("blank"), statistics(F.col("text")).alias("s"))
    rows = rows.select("doc_id", F.when(F.col("blank"), F.lit(0.0)).otherwise(model.column()).alias("quality"))
    return rows.withColumn("kept", F.coalesce(F.col("quality") >= min_quality, F.lit(True)))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
