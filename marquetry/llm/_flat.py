"""Flat numpy kernels over Arrow string columns.

A batch of texts is handled as one byte array with document offsets, so that per-character and
per-word work runs in a few vectorised passes instead of Python loops.  Texts are expected in
lower case (``lower()`` runs in the JVM); words are maximal runs of ASCII letters, ASCII digits
and bytes above 0x7F, but each character of a script without spaces is a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_U = np.uint64
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_CASED_HASH = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE_HASH = _CASED_HASH[_FOLD]
_P = _U(0x9E3779B97F4A7C15)
_P_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A byte's bits, each in a byte lane of its own.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel().copy()
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n + 1 offsets of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(ends) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes that together cover the column; a longer text is a range of its own."""
    ends = utf8(column)[1]
    low = 0
    while low < len(ends) - 1:
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + size, "right")) - 1)
        yield low, high
        low = high


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        m = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _P), ("down", _P_INV)):
            steps = np.full(m, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
        if m > 64 * SLICE_BYTES:  # tables for one huge text aren't kept
            return _POWERS.pop("up"), _POWERS.pop("down")
    return _POWERS["up"], _POWERS["down"]


def _unspaced(data: np.ndarray, cut: np.ndarray) -> None:
    """Marks where characters of scripts without spaces begin and end: Han, kana, Thai, Lao, Burmese and Khmer."""
    at = np.flatnonzero(data >= 0xE0)
    lead, then = data[at], data[np.minimum(at + 1, len(data) - 1)]
    three = (lead >= 0xE3) & (lead <= 0xE9) | (lead == 0xE0) & (then >= 0xB8) & (then <= 0xBB) | (lead == 0xE1) & ((then >= 0x80) & (then <= 0x82) | (then >= 0x9E) & (then <= 0x9F))
    four = (lead == 0xF0) & (then >= 0xA0) & (then <= 0xAF)
    for size, begin in ((3, at[three]), (4, at[four])):
        cut[begin] = True
        cut[(begin + size)[begin + size < len(data)]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and for each document where its words begin (n + 1 indices)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = _WORD[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    if data.max() >= 0xE0:
        cut = np.zeros(n, bool)
        _unspaced(data, cut)
        before &= ~cut
        after[:-1] &= ~cut[1:]
    begin = np.flatnonzero(inside & ~before)
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    end = np.flatnonzero(inside & ~after) + 1
    up, down = _powers(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE_HASH[data] * up[:n], out=sums[1:])
    return mix((sums[end] - sums[begin]) * down[begin]), np.searchsorted(begin, offsets)


def spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each stretch of bytes; capital letters count as such."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CASED_HASH[data] * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[begin]) * down[begin])


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of k words within a document, and where each document's runs begin (n + 1 indices).

    A document of 1 to k - 1 words has one shingle of all its words; one without words has none.
    """
    counts = np.diff(first)
    n_shingles = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    starts = np.concatenate([[0], np.cumsum(n_shingles)])
    doc = np.repeat(np.arange(len(counts)), n_shingles)
    at = np.arange(starts[-1]) - starts[doc] + first[:-1][doc]
    left = first[1:][doc] - at
    out = np.zeros(len(at), np.uint64)
    for i in range(k):
        there = left > i
        step = hashes[np.minimum(at + i, len(hashes) - 1)] if len(hashes) else out
        out = np.where(there, mix(out * _P + step + _U(i + 1)), out)
    return out, starts


def distinct(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct hashes (their upper 44 bits, mixed again), and where each document's begin."""
    n = len(starts) - 1
    out, ends = [], [np.zeros(1, np.int64)]
    step = 1 << 20  # documents that fit beside 44 bits of hash
    for low in range(0, n, step):
        high = min(n, low + step)
        part = hashes[starts[low] : starts[high]]
        doc = np.repeat(np.arange(high - low, dtype=np.uint64), np.diff(starts[low : high + 1]))
        keys = np.sort((doc << _U(44)) | (part >> _U(20)))
        if len(keys):
            keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
        out.append(mix(keys & _U((1 << 44) - 1)))
        edges = np.searchsorted(keys, np.arange(1, high - low + 1, dtype=np.uint64) << _U(44))
        ends.append(edges + ends[-1][-1])
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate(ends)


def bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each document, how many of its hashes have each of the 64 bits set: int64 [documents, 64].

    Sums run in byte lanes over pieces of at most 255 hashes, then over the pieces of a document.
    """
    counts = np.diff(starts)
    pieces = -(-counts // 255)
    piece_doc = np.repeat(np.arange(len(counts)), pieces)
    first = np.concatenate([[0], np.cumsum(pieces)])
    cut = starts[:-1][piece_doc] + 255 * (np.arange(first[-1]) - first[piece_doc])
    out = np.zeros((len(counts), 64), np.int64)
    if len(cut) == 0:
        return out
    by_byte = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)
    lanes = np.empty((len(cut), 8), np.uint64)
    for i in range(8):
        lanes[:, i] = np.add.reduceat(_SPREAD[by_byte[:, i]], cut)
    full = np.flatnonzero(pieces)
    out[full] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 64).astype(np.int64), first[:-1][full], axis=0)
    return out
