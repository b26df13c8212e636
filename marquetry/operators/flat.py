"""Scoring and cutting of a whole batch of texts as one array of code points.

A segment is a stretch of its text, so that the result's strings are cut from the batch's bytes; no Python string is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .score import Scorer, spaces

#: Bytes of text that are worked on at a time: arrays over its places take some 50 times as much.
SLICE_BYTES = 1 << 18


class Texts:
    """Code points of texts that follow each other: cp, where each text begins (starts, n + 1), and where each code point's bytes begin (at, + 1)."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string())
        self.null = texts.is_null().to_numpy(zero_copy_only=False)
        texts = texts.fill_null("")
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
        self.cp = np.frombuffer(self.data.tobytes().decode().encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((self.data & 0xC0) != 0x80)
        self.at = np.append(lead, len(self.data))
        self.starts = np.searchsorted(lead, ends - ends[0])
        self.space = spaces(self.cp)
        solid = np.concatenate([[0], np.cumsum(~self.space)])
        #: texts without any character but white space, which aren't scored
        self.blank = solid[self.starts[1:]] == solid[self.starts[:-1]]

    def owner(self, begin: np.ndarray) -> np.ndarray:
        """The text of stretches that aren't empty."""
        return np.searchsorted(self.starts, begin, "right") - 1

    def strings(self, begin: np.ndarray, end: np.ndarray) -> pa.Array:
        """The stretches, in order, as strings."""
        low, high = self.at[begin], self.at[end]
        n = high - low
        offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        if len(low) and (low[1:] == high[:-1]).all():
            data = self.data[low[0] : high[-1]]
        else:
            data = self.data[np.arange(offsets[-1]) + np.repeat(low - offsets[:-1], n)]
        return pa.StringArray.from_buffers(len(n), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))

    def lists(self, owner: np.ndarray, values: pa.Array) -> pa.Array:
        """Lists of each text's values; null for a null text."""
        offsets = np.searchsorted(owner, np.arange(len(self.null) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(self.null))


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Parts of about SLICE_BYTES bytes, of texts or of lists of texts; a longer one is a part of its own."""
    if pa.types.is_list(texts.type):
        each = np.concatenate([[0], np.cumsum(_bytes(texts.flatten()))])
        size = each[np.concatenate([[0], np.cumsum(pc.list_value_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))])]
    else:
        size = np.concatenate([[0], np.cumsum(_bytes(texts))])
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(size, size[low] + SLICE_BYTES, "right")) - 1)
        yield texts.slice(low, high - low)
        low = high


def _bytes(texts: pa.Array) -> np.ndarray:
    return pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def joined(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    """One array of the parts that slices() led to."""
    return pa.chunked_array(parts, kind).combine_chunks() if parts else pa.array([], kind)


def probabilities(scorer: Scorer, t: Texts, texts: pa.Array, langs: pa.Array) -> np.ndarray:
    """A probability for each code point; 0 in blank texts, if t has some."""
    if hasattr(scorer, "flat"):
        p = scorer.flat(t.cp, t.starts)
        return np.where(np.repeat(t.blank, np.diff(t.starts)), np.float32(0), p) if t.blank.any() else p
    out = np.zeros(len(t.cp), np.float32)
    full = np.flatnonzero(~t.blank)
    found = texts.take(pa.array(full)).to_pylist()
    for k in range(0, len(full), 256):
        part = full[k : k + 256]
        for i, p in zip(part, scorer.scores(found[k : k + 256], langs.take(pa.array(part)).to_pylist()), strict=True):
            out[t.starts[i] : t.starts[i + 1]] = p
    return out


def cut(t: Texts, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches between places after which to cut; white space after a cut belongs to what is before it."""
    solid = np.append(np.flatnonzero(~t.space), len(t.cp))
    ends = np.minimum(solid[np.searchsorted(solid, places + 1)], t.starts[t.owner(places) + 1]) if len(places) else places
    edges = np.unique(np.concatenate([t.starts, ends]))
    return edges[:-1], edges[1:]


def trimmed(t: Texts, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without white space at both ends; what is nothing else goes."""
    solid = np.flatnonzero(~t.space)
    first, last = np.searchsorted(solid, begin), np.searchsorted(solid, end) - 1
    some = first <= last
    return solid[first[some]], solid[last[some]] + 1


def lines(t: Texts, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, text) of lines of the stretches; a line break at the end of each stretch but a text's last makes no empty line."""
    owner = t.owner(begin)
    last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
    stop = end - (~last & (t.cp[end - 1] == 10)) if len(end) else end
    breaks = np.flatnonzero(t.cp == 10)
    of = np.searchsorted(begin, breaks, "right") - 1
    inside = (of >= 0) & (breaks < stop[np.maximum(of, 0)]) if len(begin) else np.zeros(len(breaks), bool)
    breaks, of = breaks[inside], of[inside]
    starts = np.concatenate([breaks + 1, begin])
    order = np.argsort(starts, kind="stable")  # an empty line before what begins at the same place
    owners = np.concatenate([owner[of], owner])[order] if len(owner) else owner
    return starts[order], np.sort(np.concatenate([breaks, stop]), kind="stable"), owners


def segments(scorer: Scorer, texts: pa.Array, langs: pa.Array, threshold: float, strip: bool, split_lines: bool) -> pa.Array:
    """list<string> of each text's segments."""
    if isinstance(texts, pa.ChunkedArray):
        texts, langs = texts.combine_chunks(), langs.combine_chunks()
    out, row = [], 0
    for part in slices(texts):
        t = Texts(part)
        p = probabilities(scorer, t, part, langs.slice(row, len(part)))
        row += len(part)
        begin, end = cut(t, np.flatnonzero(p > threshold))
        if strip:
            begin, end = trimmed(t, begin, end)
        if split_lines:
            begin, end, owner = lines(t, begin, end)
        else:
            owner = t.owner(begin)
        out.append(t.lists(owner, t.strings(begin, end)))
    return joined(out, pa.list_(pa.string()))


def probability_lists(scorer: Scorer, texts: pa.Array, langs: pa.Array, blank: bool = False) -> pa.Array:
    """list<float> of each text's probabilities; [0] for a blank one, unless those are to be scored too."""
    out, row = [], 0
    for part in slices(texts):
        t = Texts(part)
        if blank:
            t.blank = np.diff(t.starts) == 0  # has no code points to score
        p = probabilities(scorer, t, part, langs.slice(row, len(part)))
        row += len(part)
        if blank:
            t.blank[:] = False
        sizes = np.where(t.blank, 1, np.diff(t.starts))
        if t.blank.any():
            whole = np.zeros(sizes.sum(), np.float32)
            whole[np.repeat(~t.blank, sizes)] = p[np.repeat(~t.blank, np.diff(t.starts))]
            p = whole
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(p, pa.float32()), mask=pa.array(t.null)))
    return joined(out, pa.list_(pa.float32()))
