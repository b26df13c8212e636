"""Sliding windows over texts, window weights, and averages over overlaps."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F

from ..functions.text import let


def check(block: int, stride: int) -> None:
    if not 0 < stride <= block:
        raise ValueError(f"stride ({stride}) must be between 1 and the block size ({block}); else characters would be left out")


def window_count(n: Column, block: int, stride: int) -> Column:
    return (F.ceil(F.greatest(n - block, F.lit(0)) / F.lit(stride)) + 1).cast("int")


def window_spans(n: Column, block: int, stride: int) -> Column:
    """array<struct<start, end>>: windows of a block every stride characters, the last flush with the end."""
    check(block, stride)

    def spans(size: Column) -> Column:
        last = F.greatest(size - block, F.lit(0)).cast("int")

        def span(k: Column) -> Column:
            start = F.least(k * stride, last)
            return F.struct(start.alias("start"), F.least(start + block, size).cast("int").alias("end"))

        return F.transform(F.sequence(F.lit(0), window_count(size, block, stride) - 1), span)

    return let(n, spans)


def windows(n: int, block: int, stride: int) -> list[tuple[int, int]]:
    check(block, stride)
    last = max(n - block, 0)
    return [(s, min(s + block, n)) for s in (min(k * stride, last) for k in range(math.ceil(last / stride) + 1))]


def hat(block: int) -> np.ndarray:
    """Weights that fall off linearly from the middle of a window."""
    top = 1 - 1 / block
    return 1 - np.abs(np.linspace(-top, top, block))


def hat_weight(offset: Column, block: int) -> Column:
    """The same for a place in a window."""
    if block == 1:
        return F.lit(1.0)
    top = 1 - 1 / block
    return F.lit(1.0) - F.abs(F.lit(-top) + offset * F.lit(2 * top / (block - 1)))


def overlap_average(n: int, spans: list[tuple[int, int]], parts: list[np.ndarray], weighting: str = "uniform") -> np.ndarray:
    """Weighted mean, at each place, of the values of all windows that hold it."""
    total, weight = np.zeros(n), np.zeros(n)
    for (a, b), x in zip(spans, parts, strict=True):
        w = np.ones(b - a) if weighting == "uniform" else hat(max(b - a for a, b in spans))[: b - a]
        total[a:b] += w * x
        weight[a:b] += w
    return total / np.maximum(weight, 1e-300)


def effective_block(longest: int, max_block: int, limit: int | None = None, multiple: int = 1) -> int:
    """The block that a batch needs: no longer than its longest text, than the model's limit, and a multiple of its down-sampling rate."""
    block = min(longest, max_block)
    block = min(block, limit) if limit else block
    return -(-block // multiple) * multiple
