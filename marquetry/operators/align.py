"""Alignment of altered texts with their originals, and rates of what was lost or made up."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

GAP = "@"
_MATCH, _MISMATCH, _SPACE = 1, -8, -1


def needleman_wunsch(a: str, b: str, gap: str = GAP) -> tuple[str, str]:
    """Global alignment of two strings, with gap characters; of equal alignments the one that ends in a pair, then in a gap in b."""
    x, y = (np.array([ord(c) for c in s], np.int64) for s in (a, b))
    n, m = len(x), len(y)
    score = np.zeros((n + 1, m + 1), np.int32)
    score[0] = _SPACE * np.arange(m + 1)
    column = np.arange(m + 1)
    for i in range(1, n + 1):
        best = np.empty(m + 1, np.int64)
        best[0] = _SPACE * i
        pair = score[i - 1, :-1] + np.where(y == x[i - 1], _MATCH, _MISMATCH)
        best[1:] = np.maximum(pair, score[i - 1, 1:] + _SPACE)
        score[i] = np.maximum.accumulate(best - _SPACE * column) + _SPACE * column  # gaps in a
    i, j, left, right = n, m, [], []
    while i or j:
        if i and j and score[i, j] == score[i - 1, j - 1] + (_MATCH if x[i - 1] == y[j - 1] else _MISMATCH):
            i, j = i - 1, j - 1
            left.append(a[i])
            right.append(b[j])
        elif i and score[i, j] == score[i - 1, j] + _SPACE:
            i -= 1
            left.append(a[i])
            right.append(gap)
        else:
            j -= 1
            left.append(gap)
            right.append(b[j])
    return "".join(reversed(left)), "".join(reversed(right))


def project(aligned_in: str, aligned_out: str, delimiter: str = "|", gap: str = GAP, separator: str = " ") -> tuple[str, str]:
    """Original and prediction, character by character: what was made up goes, and a delimiter in it moves to the character before.

    Where sentences have no separator, delimiters that only one side has are evened out, so that both sides stay as long.
    """
    left: list[str] = []
    right: list[str] = []
    for c, d in zip(aligned_in, aligned_out, strict=True):
        if c != gap:
            left.append(c)
            right.append(d)
        elif d == delimiter and right:
            right[-1] = delimiter
    if separator == "":
        fixed = []
        for c, d in zip(left, right, strict=True):
            if d == delimiter and c != delimiter:
                fixed.append(" ")
            if not (c == delimiter and d != delimiter):
                fixed.append(d)
        right = fixed
    return "".join(left), "".join(right)


def align_column(original: Column, output: Column, gap: str = GAP) -> Column:
    """struct<aligned_in, aligned_out>; quadratic in the length of the texts, which are chunks of a few sentences."""

    @F.arrow_udf("struct<aligned_in:string,aligned_out:string>")
    def align(a: pa.Array, b: pa.Array) -> pa.Array:
        pairs = [(None, None) if x is None or y is None else needleman_wunsch(x, y, gap) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], ["aligned_in", "aligned_out"])

    return align(original, output)


def rates(aligned_in: Column, aligned_out: Column, delimiter: str = "|", gap: str = GAP) -> Column:
    """struct<hallucinated, deleted>: shares of characters that only one side has, delimiters aside; 0 if nothing was aligned."""
    pairs = F.arrays_zip(F.split(aligned_in, "").alias("c"), F.split(aligned_out, "").alias("d"))
    n = F.length(aligned_in)
    made_up = F.size(F.filter(pairs, lambda p: (p["c"] == gap) & (p["d"] != delimiter)))
    lost = F.size(F.filter(pairs, lambda p: (p["d"] == gap) & (p["c"] != delimiter)))
    share = lambda x: F.when((n == 0) | (F.translate(aligned_out, gap, "") == ""), F.lit(0.0)).otherwise(x / n)
    return F.struct(share(made_up).alias("hallucinated"), share(lost).alias("deleted"))
