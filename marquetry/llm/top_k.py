"""Exact top-k search by distributed histogram selection; queries are the vectors whose id is divisible by ``EVERY``, answers come from all.

Vectors are scaled to length 1 and rounded to whole multiples of 2**-26, so that products of any two are whole numbers that float64 holds
exactly: scores don't depend on the order of sums, hence on processors or retries.  A pair's score is its cosine
similarity in whole millionths, ``floor(cos * 1e6 + 0.5)``, a number of 21 bits.  Vectors are packed
into blocks, and each pair of a block of queries and a block of vectors is scored by one matrix product.  Round by round, histograms over the next 7 bits of the
scores that share the bits found so far are added up over all blocks for each query, and locate the bits of its kth
largest score.  After three rounds the kth value is known exactly; a last pass keeps the pairs above it and, of those that equal it, the
ones with the least ids.  Scores are computed anew in each pass, so that nothing quadratic is stored.

Cases: rows with a null id, or a null, empty or all-zero vector, or one with null, NaN or infinite elements, neither ask nor
answer.  Vectors are compared with those of their own length.  Rows that repeat an id count as one, with the
greatest vector in array order.  A vector isn't its own neighbour.  Ties go to the least id.  With fewer than k other vectors
all of them are returned.  An empty table gives an empty result.  Further columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ._spark import discard, table, written

K = 10
EVERY = 100
BLOCK = 2048
SCALE = 1_000_000
UNIT = 1 << 26
_BITS, _ROUNDS = 7, 3
_OFFSET = 1 << 20
_TILE = 256


def _usable(vectors: DataFrame) -> DataFrame:
    """(id, v, n): one vector of n elements for each id; written."""
    v = F.col("embedding")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(ok)
    rows = rows.groupBy(F.col("vec_id").cast("long").alias("id")).agg(F.max(v.cast("array<double>")).alias("v"))
    return written(rows.withColumn("n", F.size("v")))


def quantised(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in multiples of 1 / UNIT."""
    largest = np.abs(v).max(axis=1, keepdims=True)
    v = np.where((largest > 1e100) | (largest < 1e-100), v / largest, v)
    return np.rint(v / np.sqrt((v * v).sum(axis=1))[:, None] * UNIT).astype(np.int32)


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """(n, block, ids, vs): vectors of n elements with ids as int64 and elements as int32, packed; written."""
    sizes = rows.groupBy("n").agg(F.ceil(F.count("*") / block).alias("blocks"))
    total = sizes.agg(F.sum("blocks")).first()[0] or 1

    def pack(t: pa.Table) -> pa.Table:
        order = np.argsort(t["id"].to_numpy())
        v = np.array(t["v"].combine_chunks().flatten()).reshape(len(order), -1)[order]
        return pa.table({"n": t["n"][:1], "block": t["block"][:1], "ids": [t["id"].to_numpy()[order].tobytes()], "vs": [quantised(v).tobytes()]})

    rows = rows.join(sizes, "n").select("n", F.pmod(F.xxhash64("id"), "blocks").alias("block"), "id", "v")
    return written(rows.repartition(min(int(total), 10_000), "n", "block").groupBy("n", "block").applyInArrow(pack, "n int, block long, ids binary, vs binary"))


def _scores(ids: np.ndarray, vs: np.ndarray, other_ids: np.ndarray, others: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first query, scores + 2**20) for tiles of queries; -1 for a vector and itself."""
    for a in range(0, len(ids), _TILE):
        s = vs[a : a + _TILE] @ others.T  # whole numbers of at most 2**52, or little more
        s *= 1 / UNIT**2
        s *= SCALE
        s += _OFFSET + 0.5
        out = s.astype(np.int32)  # all are positive, so that truncation is floor
        out[ids[a : a + _TILE, None] == other_ids] = -1
        yield a, out


def _read(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, ...]:
    ids, others = (np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in ("ids", "other_ids"))
    vs, other_vs = (np.frombuffer(batch.column(c)[i].as_py(), np.int32).astype(np.float64) for c in ("vs", "other_vs"))
    return ids, vs.reshape(len(ids), -1), others, other_vs.reshape(len(others), -1)


def _round(level: int):
    """Adds histograms of one digit of the scores: (n, block, hist) per task and block of queries."""
    shift = _BITS * (_ROUNDS - 1 - level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for i in range(b.num_rows):
                ids, vs, others, other_vs = _read(b, i)
                prefix = np.frombuffer(b.column("prefix")[i].as_py(), np.int32)
                hist = sums.setdefault((b.column("n")[i].as_py(), b.column("block")[i].as_py()), np.zeros((len(ids), 1 << _BITS), np.int64))
                for a, s in _scores(ids, vs, others, other_vs):
                    digits = s >> shift
                    if level == 0:
                        at = np.flatnonzero(s.ravel() >= 0) if (s < 0).any() else slice(None)
                        keys = (digits + (np.arange(len(s), dtype=np.int32) << _BITS)[:, None]).ravel()[at]
                    else:
                        q, o = np.nonzero((digits >> _BITS) == prefix[a : a + _TILE, None])
                        keys = (q << _BITS) + (digits[q, o] & ((1 << _BITS) - 1))
                    hist[a : a + len(s)] += np.bincount(keys, minlength=len(s) << _BITS).reshape(len(s), -1)
        for (n, block), hist in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([block], pa.int64()), pa.array([hist.tobytes()], pa.binary())], ["n", "block", "hist"])

    return run


def _refine(t: pa.Table) -> pa.Table:
    """The sum of a block's histograms fixes the next digit of each query's kth score."""
    hist = sum(np.frombuffer(x.as_py(), np.int64) for x in t["hist"]).reshape(-1, 1 << _BITS)
    prefix, need = (np.frombuffer(t[c][0].as_py(), np.int32) for c in ("prefix", "need"))
    from_top = np.cumsum(hist[:, ::-1], axis=1)
    reached = from_top >= need[:, None]
    place = np.where(reached.any(axis=1), reached.argmax(axis=1), (1 << _BITS) - 1)
    above = np.where(place > 0, from_top[np.arange(len(place)), place - 1], 0)
    prefix = (prefix << _BITS) + ((1 << _BITS) - 1 - place)
    return pa.table({"n": t["n"][:1], "block": t["block"][:1], "prefix": [prefix.astype(np.int32).tobytes()], "need": [(need - above).astype(np.int32).tobytes()]})


def _select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs above the kth score, and of those that equal it as many with least ids as are needed."""
    for b in batches:
        for i in range(b.num_rows):
            ids, vs, others, other_vs = _read(b, i)
            least, need = (np.frombuffer(b.column(c)[i].as_py(), np.int32) for c in ("prefix", "need"))
            for a, s in _scores(ids, vs, others, other_vs):
                mine = least[a : a + len(s), None]
                q, o = np.nonzero((s >= mine) & (s >= 0))
                tie = s[q, o] == mine[q, 0]
                starts = np.concatenate([[0], np.cumsum(np.bincount(q[tie], minlength=len(s)))])
                rank = np.zeros(len(q), np.int64)
                rank[tie] = np.arange(tie.sum()) - starts[q[tie]]  # ids of a block are in order
                keep = rank < np.maximum(need[a : a + len(s)], 1)[q]
                q, o = q[keep], o[keep]
                yield pa.RecordBatch.from_arrays([pa.array(ids[a + q]), pa.array(others[o]), pa.array(s[q, o].astype(np.int64) - _OFFSET)], ["vec_id", "neighbor_id", "score"])


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, block: int = BLOCK) -> DataFrame:
    """(vec_id, rank, neighbor_id, score): of every vector whose id is divisible by ``every`` the k best neighbours among all; score in millionths."""
    rows = _usable(vectors)
    queries, others = _blocks(rows.where(F.col("id") % every == 0), block), _blocks(rows, block)
    discard(rows)
    others = others.select(F.col("n").alias("other_n"), F.col("ids").alias("other_ids"), F.col("vs").alias("other_vs"))
    size = F.octet_length("ids").cast("int")
    empty = F.unhex(F.repeat(F.lit("00"), (size / 2).cast("int")))
    start = F.unhex(F.repeat(F.lit(np.int32(k).tobytes().hex()), (size / 8).cast("int")))
    state = written(queries.select("n", "block", empty.alias("prefix"), start.alias("need")))
    # a difference, so that blocks meet in pairs of partitions instead of being shuffled by their one or few lengths
    meet = F.col("n") - F.col("other_n") == 0
    for level in range(_ROUNDS):
        grid = queries.join(state.drop("need"), ["n", "block"]).join(others, meet)
        hists = grid.mapInArrow(_round(level), "n int, block long, hist binary").join(state, ["n", "block"])
        last, state = state, written(hists.groupBy("n", "block").applyInArrow(_refine, "n int, block long, prefix binary, need binary"))
        discard(last)
    found = queries.join(state, ["n", "block"]).join(others, meet).mapInArrow(_select, "vec_id long, neighbor_id long, score long")
    order = Window.partitionBy("vec_id").orderBy(F.desc("score"), "neighbor_id")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("vec_id", "rank", "neighbor_id", "score")


def op2_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP2_SQL = f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT vec_id, list_transform(v, lambda x: round(x / sqrt(list_sum(list_transform(v, lambda y: y * y))) * {UNIT})) AS v FROM e),
s AS (
  SELECT a.vec_id, b.vec_id AS neighbor_id, floor(list_dot_product(a.v, b.v) / {UNIT**2} * {SCALE} + 0.5)::BIGINT AS score
  FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbor_id) AS rank FROM s)
SELECT vec_id, rank, neighbor_id, score FROM r WHERE rank <= {K}
"""
