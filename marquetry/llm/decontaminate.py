"""Benchmark decontamination: SimHash windows, multi-index Hamming lookup, exact weighted-shingle verification.

1. Texts are lower-cased words (runs of letters and digits; each character of scripts without spaces); shingles are word pairs.  A shingle
   weighs ``log(1 + items / items that hold it)``, one that no item holds as much as ``log(1 + items)``.  Items are counted over the
   whole benchmark by ``WEIGHT_BITS`` bits of the shingle's hash, in a table of fixed size that every pass over the documents uses.
2. For each item size (its number of words) a window of that size slides over every word of every document; a document
   with fewer words is one window.  Each window has a 64-bit SimHash of its shingles.
3. Fingerprints within ``RADIUS`` bits agree in one of 4 blocks of 16 bits up to ``RADIUS // 4`` bits.  The index
   holds each item's 4 blocks; a window's blocks are looked up with all their neighbours within that many bits, or compared
   with all the block's values where these are fewer, which finds the same.
4. Candidates are verified by weighted Jaccard similarity of shingle sets; pairs of at least ``SIMILARITY`` are hits.

Before 2, windows are left out whose shingle weights can't reach ``SIMILARITY`` with any item: the sum over a window of
each shingle's largest share in an item's weight is an upper bound of its similarity with every item.

A pass searches items of at most ``PASS_BYTES`` bytes of text (or one longer item); larger benchmarks take more passes, with the same result.

Cases: null and empty texts, and texts without words, match nothing; nor do null items or items without words.  A text of one word
has no pair: that word is its shingle, so that an item of one word is found in documents that are this word.  Items that repeat an id keep their
texts, and a pair's best similarity is reported; of windows that are equally similar the first counts; rows that
repeat a ``doc_id`` count as one document; rows with a null ``doc_id`` are in no pair, though filtered like others.  Texts
are read whole.  An empty benchmark or table gives no pairs.  Further columns aren't read, or stay as they are in decontaminate().
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _flat
from ._spark import table

SIMILARITY = 0.6
RADIUS = 19
#: Text of the items that one pass over the documents searches; what tasks are sent is at most about 20 times as large, and the weights.
PASS_BYTES = 4 << 20
#: Weights are a table of 2 ** WEIGHT_BITS numbers of 4 bytes.
WEIGHT_BITS = 22
_BLOCKS, _WIDTH = 4, 16
_SALT = np.uint64(0xA0761D6478BD642F)
_BITS = 20


def _fingerprints(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    counts = _flat.bit_counts(_flat.mix(shingles ^ _SALT), starts)
    return np.packbits(2 * counts > np.diff(starts)[:, None], axis=1).view(np.uint64).ravel()


@cache
def _neighbours(radius: int) -> np.ndarray:
    """All 16-bit words of at most so many bits."""
    return np.array([sum(1 << b for b in c) for k in range(radius + 1) for c in itertools.combinations(range(_WIDTH), k)], np.int64)


def _block(fps: np.ndarray, b: int) -> np.ndarray:
    return (fps >> np.uint64(b * _WIDTH)).astype(np.int64) & 0xFFFF


def _grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, where each one's places begin (n + 1 indices), and these places."""
    order = np.argsort(values, kind="stable")
    distinct, first = np.unique(values[order], return_index=True)
    return distinct, np.concatenate([first, [len(values)]]), order


def _spread(groups: np.ndarray, starts: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of each of the groups, and before them the index in groups that each belongs to."""
    n = starts[groups + 1] - starts[groups]
    i = np.repeat(np.arange(len(groups)), n)
    return i, places[np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[groups], n)]


def _near(asked: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): places of distinct 16-bit words, both in order, that differ in at most so many bits."""
    around = _neighbours(radius)
    found = []
    for low in range(0, len(asked), 256):
        part = asked[low : low + 256, None]
        if len(values) <= len(around):
            i, j = np.nonzero(np.bitwise_count(part ^ values) <= radius)
        else:
            near = part ^ around
            at = np.minimum(np.searchsorted(values, near), len(values) - 1)
            i, k = np.nonzero(values[at] == near)
            j = at[i, k]
        found.append((i + low, j))
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _shingled(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of lower-case texts, where each text's begin, and each text's number of words."""
    words, first = _flat.words(*_flat.utf8(texts))
    return *_flat.shingles(words, first, 2), np.diff(first)


def _buckets(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - WEIGHT_BITS)).astype(np.int64)


def weights_of(items: DataFrame) -> np.ndarray:
    """Weight of a shingle by WEIGHT_BITS bits of its hash, from all items (text, in lower case)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(1 << WEIGHT_BITS, np.int64), 0
        for b in batches:
            for low, high in _flat.slices(b.column(0)):
                shingles, starts, _ = _shingled(b.column(0).slice(low, high - low))
                for i in np.flatnonzero(np.diff(starts)):
                    n += 1
                    counts[np.unique(_buckets(shingles[starts[i] : starts[i + 1]]))] += 1
        held = np.flatnonzero(counts)
        # a bucket of -1 stands for the items
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], held])), pa.array(np.concatenate([[n], counts[held]]))], ["bucket", "n"])

    found = items.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = found["bucket"].to_numpy(), found["n"].to_numpy()
    total = int(n[bucket < 0].sum())
    out = np.full(1 << WEIGHT_BITS, np.log1p(total), np.float32)
    out[bucket[bucket >= 0]] = np.log1p(total / n[bucket >= 0])
    return out


class Index:
    """Items of a benchmark, ready for search: arrays of a few numbers for each of their words."""

    def __init__(self, ids: list[int], texts: list[str], weights: np.ndarray, similarity: float = SIMILARITY, radius: int = RADIUS):
        self.similarity, self.radius = similarity, radius
        shingles, starts, _ = _shingled(pa.array(texts, pa.string()))
        use = np.flatnonzero(np.diff(starts))
        self.ids = [ids[i] for i in use]
        each = [shingles[starts[i] : starts[i + 1]] for i in use]
        sets = [np.unique(x) for x in each]
        #: items' shingles in order, one item after the other
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
        self.shingles = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        weight = weights[_buckets(self.shingles)].astype(np.float64)
        self.totals = np.add.reduceat(weight, self.first[:-1]) if sets else np.zeros(0)
        share = weight / np.repeat(self.totals, np.diff(self.first))
        order = np.lexsort((-share, self.shingles))
        self.known, at = np.unique(self.shingles[order], return_index=True)
        self.share = share[order][at]
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[(self.known >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        # per size in shingles: fingerprints, their items, and per block the distinct values, where each one's items begin, and these
        self.sizes: dict[int, tuple] = {}
        sizes = np.array([len(x) for x in each], np.int64)
        for size in np.unique(sizes).tolist():
            items = np.flatnonzero(sizes == size)
            fps = _fingerprints(np.concatenate([each[i] for i in items]), np.arange(len(items) + 1) * size)
            self.sizes[size] = (fps, items, [_grouped(_block(fps, b)) for b in range(_BLOCKS)])

    def _candidates(self, fps: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs whose fingerprints are within the radius."""
        own, items, blocks = self.sizes[size]
        pairs = []
        for b, (values, starts, places) in enumerate(blocks):
            asked, first, windows = _grouped(_block(fps, b))
            i, j = _near(asked, values, self.radius // _BLOCKS)
            i, window = _spread(i, first, windows)
            _, place = _spread(j[i], starts, places)
            n = np.diff(starts)[j[i]]
            pairs.append(np.repeat(window, n) * len(items) + place)
        both = np.unique(np.concatenate(pairs))
        window, place = both // len(items), both % len(items)
        near = np.bitwise_count(fps[window] ^ own[place]) <= self.radius
        return window[near], items[place[near]]

    def similarity_of(self, window: np.ndarray, item: int, weights: np.ndarray) -> float:
        """Weighted Jaccard similarity of a window's distinct shingles, in order, and an item."""
        own = self.shingles[self.first[item] : self.first[item + 1]]
        weight = weights[_buckets(window)].astype(np.float64)
        at = np.minimum(np.searchsorted(own, window), len(own) - 1)
        both = weight[own[at] == window].sum()
        return float(both / (weight.sum() + self.totals[item] - both))

    def search(self, texts: pa.Array, weights: np.ndarray) -> list[dict[int, tuple[float, int]]]:
        """For each lower-case text its hits: item's place -> (similarity, first word of the window)."""
        out: list[dict[int, tuple[float, int]]] = [{} for _ in range(len(texts))]
        if not self.sizes:
            return out
        for low, high in _flat.slices(texts):
            shingles, starts, _ = _shingled(texts.slice(low, high - low))
            self._search(shingles, starts, weights, out[low:high])
        return out

    def _search(self, shingles: np.ndarray, starts: np.ndarray, weights: np.ndarray, out: list[dict]) -> None:
        share = np.zeros(len(shingles))
        some = np.flatnonzero(self.maybe[(shingles >> np.uint64(64 - _BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.known, shingles[some]), len(self.known) - 1)
        hit = self.known[at] == shingles[some]
        share[some[hit]] = self.share[at[hit]]
        if not hit.any():
            return
        sums = np.concatenate([[0.0], np.cumsum(share)])
        least = self.similarity - 1e-9
        # a window's sum is at most that of the longest window with the same start
        ends = np.repeat(starts[1:], np.diff(starts))
        begin = np.arange(len(shingles))
        begin = begin[sums[np.minimum(begin + max(self.sizes), ends)] - sums[begin] >= least]
        ends = ends[begin]
        docs = np.searchsorted(starts, begin, "right") - 1
        counts = np.diff(starts)[docs]
        for size in self.sizes:
            whole = counts < size  # a document shorter than the window is one window
            length = np.where(whole, counts, size)
            fits = begin + length <= ends
            fits[fits] = sums[(begin + length)[fits]] - sums[begin[fits]] >= least
            for part in (np.flatnonzero(fits & ~whole), *([k] for k in np.flatnonzero(fits & whole).tolist())):
                for some_at in np.array_split(part, len(part) * size // 2_000_000 + 1) if len(part) else []:
                    self._verify(shingles, begin[some_at], docs[some_at], starts, int(length[some_at[0]]), size, weights, out)

    def _verify(self, shingles: np.ndarray, begin: np.ndarray, docs: np.ndarray, starts: np.ndarray, length: int, size: int, weights: np.ndarray, out: list[dict]) -> None:
        windows = shingles[begin[:, None] + np.arange(length)]
        window, item = self._candidates(_fingerprints(windows.ravel(), np.arange(len(begin) + 1) * length), size)
        sets = {w: np.unique(windows[w]) for w in np.unique(window).tolist()}
        for w, i in zip(window.tolist(), item.tolist(), strict=True):
            s = self.similarity_of(sets[w], i, weights)
            if s >= self.similarity:
                d = int(docs[w])
                first = int(begin[w] - starts[d])
                best = out[d].get(i)
                if best is None or (-s, first) < (-best[0], best[1]):
                    out[d][i] = (s, first)


def indexes(benchmark: DataFrame, **options) -> Iterator[tuple[Index, np.ndarray]]:
    """Indexes that together hold the benchmark (item_id, text), each of bounded size, with the weights of all shingles.

    The driver holds the items of one index at a time.
    """
    items = benchmark.where("text is not null").select(F.col("item_id"), F.lower("text").alias("text"))
    weights = weights_of(items)
    ids, texts, size = [], [], 0
    for i, text in items.orderBy("item_id", "text").toLocalIterator():
        n = len(text.encode())
        if ids and size + n > PASS_BYTES:
            yield Index(ids, texts, weights, **options), weights
            ids, texts, size = [], [], 0
        ids.append(i)
        texts.append(text)
        size += n
    if ids:
        yield Index(ids, texts, weights, **options), weights


def _shared(spark, benchmark: DataFrame, **options) -> Iterator[tuple]:
    """Broadcasts of each index, and of the weights, which are sent once."""
    sent = None
    for index, weights in indexes(benchmark, **options):
        sent = sent or spark.sparkContext.broadcast(weights)
        yield spark.sparkContext.broadcast(index), sent


def matches(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, similarity, word): document and item of each hit, the best window's similarity and first word."""
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    schema = "doc_id long, item_id long, similarity double, word long"
    found = docs.sparkSession.createDataFrame([], schema)
    for shared, weights in _shared(docs.sparkSession, benchmark, **options):

        def run(batches: Iterator[pa.RecordBatch], shared=shared, weights=weights) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                hits = [(i, index.ids[k], round(s, 6), w) for i, x in zip(b.column(0).to_pylist(), index.search(b.column(1), weights.value), strict=True) for k, (s, w) in sorted(x.items())]
                yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "item_id", "similarity", "word"), h, strict=True)) for h in hits], pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("word", pa.int64())]))

        found = found.union(rows.mapInArrow(run, schema))
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "word"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", (-F.col("b.s")).alias("similarity"), F.col("b.word").alias("word"))


def _clean(shared, weights):
    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array([not x for x in shared.value.search(texts, weights.value)], pa.bool_())

    return clean


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows without any hit; all columns stay as they are."""
    for shared, weights in _shared(docs.sparkSession, benchmark, **options):
        docs = docs.where(_clean(shared, weights)(F.coalesce(F.lower("text"), F.lit(""))))
    return docs


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
