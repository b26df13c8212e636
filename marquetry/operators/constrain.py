"""Cuts under length constraints: an optimal and a greedy search, and strict enforcement on the text."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np

from ..functions.priors import weights
from .score import SPACES

ALGORITHMS = ("viterbi", "greedy")
_NEAR = 19  # how far before the limit white space is looked for


def check(min_length: int, max_length: int | None, algorithm: str) -> None:
    if max_length is not None and min_length > max_length:
        raise ValueError(f"min_length ({min_length}) cannot be greater than max_length ({max_length})")
    for name, length in (("min_length", min_length), ("max_length", max_length)):
        if length is not None and length < 1:
            raise ValueError(f"{name} must be >= 1, got {length}")
    if algorithm not in ALGORITHMS:
        raise ValueError(f"Unknown algorithm: {algorithm}; there are {', '.join(ALGORITHMS)}")


@lru_cache(64)
def _table(name: str, longest: int, max_length: int | None, lang: str | None, target: float | None, spread: float | None) -> np.ndarray:
    return weights(name, longest, max_length, lang, target, spread)


def _repaired(ends: list[int], n: int, low: int, high: int) -> list[int]:
    """A last segment that is too short joins the one before, or takes characters from it."""
    if not ends or n - ends[-1] >= low:
        return ends
    if len(ends) == 1:
        if n <= high:
            return []
        return [n - low] if n - low >= low else ends
    before = ends[-2]
    if n - before <= high:
        return ends[:-1]
    moved = max(n - low, before + 1)
    return [*ends[:-1], moved] if moved - before <= high else ends


def _even(n: int, low: int, high: int) -> list[int]:
    """Steps of the greatest length, where no cut satisfies the prior."""
    ends, at = [], 0
    while at < n:
        step = min(at + high, n)
        if step - at >= low:
            ends.append(step)
        at = step
    return _repaired(ends, n, low, high)


def viterbi(probs: np.ndarray, prior: np.ndarray, low: int, high: int) -> list[int]:
    """Ends before n that maximise the sum of log priors and log probabilities; of equal ones the longest last segment wins.

    Only places with a probability above 0 can be reached, so that the search runs over those, and what it holds is theirs.
    """
    n = len(probs)
    found = np.flatnonzero(probs[: max(0, n - 1)] > 0)
    log_p = np.log(probs[found]).astype(np.float64)
    with np.errstate(divide="ignore"):
        log_prior = np.log(prior[: min(high, n) + 1])
    log_prior[prior[: len(log_prior)] <= 0] = -np.inf
    places = [*(found + 1).tolist(), n] if n else []
    live = np.zeros(len(places) + 1, np.int64)  # reached places in order
    best = np.zeros(len(live))  # of each of them, and from which it is reached
    source = np.zeros(len(live), np.int64)
    count, first = 1, 0
    for i, here in enumerate(places):
        while first < count and live[first] < here - high:
            first += 1
        last = int(np.searchsorted(live[first:count], here - low, "right")) + first
        if last > first:
            values = best[first:last] + log_prior[here - live[first:last]]
            if here < n:
                values = values + log_p[i]
            k = int(values.argmax())
            if values[k] > -np.inf:
                live[count], best[count], source[count] = here, values[k], first + k
                count += 1
    if live[count - 1] < n:
        return _even(n, low, high)
    ends, at = [], count - 1
    while at > 0:
        ends.append(int(live[at]))
        at = int(source[at])
    return _repaired(ends[:0:-1], n, low, high)


def greedy(probs: np.ndarray, prior: np.ndarray, low: int, high: int) -> list[int]:
    """From left to right the end with the greatest probability times prior; of equal ones the nearest.

    Only places with a probability above 0, and the end of the text, are looked at; where none is in reach, all ends are equal.
    """
    n, ends, at = len(probs), [], 0
    live = np.flatnonzero(probs[: max(0, n - 1)] > 0) + 1
    weight = probs[live - 1].astype(np.float64)
    first = np.searchsorted(live, live + low).tolist()
    last = np.searchsorted(live, live + high, "right").tolist()
    here = -1  # the place among the live ones at which a segment begins
    while at < n:
        end, best = at + low, 0.0  # the nearest, if all are 0
        if here >= 0:
            a, b = first[here], last[here]
        else:
            a, b = int(np.searchsorted(live, at + low)), int(np.searchsorted(live, at + high, "right"))
        chosen = -1
        if b > a:
            values = prior[live[a:b] - at] * weight[a:b]
            k = int(values.argmax())
            if values[k] > 0:
                end, best, chosen = int(live[a + k]), float(values[k]), a + k
        if low <= n - at <= high and prior[n - at] > best:
            end = n
        if end >= n:
            if n - at < low and ends and n - (ends[-2] if len(ends) > 1 else 0) <= high:
                ends.pop()
            break
        ends.append(end)
        at, here = end, chosen
    return ends


def boundaries(probs: np.ndarray, prior: np.ndarray | Callable[[int], float], min_length: int = 1, max_length: int | None = None, algorithm: str = "viterbi") -> list[int]:
    """1-based ends of segments, n excluded.  prior: weights of the lengths from 0, or a function of the length."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"Unknown algorithm: {algorithm}; there are {', '.join(ALGORITHMS)}")
    probs = np.asarray(probs)
    n = len(probs)
    high = n if max_length is None else max_length
    if callable(prior):
        prior = np.array([0.0, *(prior(k) for k in range(1, min(high, n) + 1))])
    return (viterbi if algorithm == "viterbi" else greedy)(probs, prior, min_length, high)


def _pieces(segment: str, high: int) -> tuple[list[str], str]:
    """Cuts of at most the greatest length, at white space if there is some near it, and what remains."""
    out = []
    while len(segment) > high:
        at = next((j + 1 for j in range(high - 1, max(0, high - 1 - _NEAR), -1) if segment[j] in SPACES), high)
        out.append(segment[:at])
        segment = segment[at:]
    return out, segment


def enforce(text: str, ends: list[int], low: int, high: int | None, strip: bool = False) -> list[str]:
    """Segments of the text that are never longer than high, and not shorter than low where that can be; ends are 1-based."""
    trim = (lambda s: s.strip(_SPACES)) if strip else (lambda s: s)
    if not text.strip(_SPACES):
        if strip or not text:
            return []
        return [text[k : k + high] for k in range(0, len(text), high)] if high else [text]
    edges, n = [0], len(text)
    for end in ends:
        while end < n and text[end] in SPACES:
            end += 1
        if end > edges[-1]:
            edges.append(end)
    if edges[-1] < n:
        edges.append(n)
    out: list[str] = []
    carried, k = "", 0
    while k < len(edges) - 1:
        segment, k = carried + text[edges[k] : edges[k + 1]], k + 1
        carried = ""
        if high is not None and len(segment) > high:
            done, rest = _pieces(segment, high)
            out += [s for s in map(trim, done) if s]
            if k < len(edges) - 1:
                carried = rest
            elif trim(rest):
                out.append(trim(rest))
            continue
        while k < len(edges) - 1 and len(trim(segment)) < low:
            longer = segment + text[edges[k] : edges[k + 1]]
            if high is not None and len(trim(longer)) > high:
                break
            segment, k = longer, k + 1
        if trim(segment):
            out.append(trim(segment))
    if len(out) > 1 and len(trim(out[-1])) < low and (high is None or len(out[-2]) + len(out[-1]) <= high):
        out[-2:] = [out[-2] + out[-1]]
    return out


_SPACES = "".join(sorted(SPACES))


def ends_of(probs: np.ndarray, min_length: int, max_length: int | None, prior: str = "uniform", prior_kwargs: dict | None = None, algorithm: str = "viterbi", lang: str | None = None) -> list[int]:
    """Ends of one text's segments by a named prior.  prior_kwargs: target_length, spread, lang_code; else the language's lengths are used."""
    own = prior_kwargs or {}
    longest = min(len(probs), max_length) if max_length is not None else len(probs)
    code = own.get("lang_code", lang if "target_length" not in own else None)
    size = 1 << max(0, longest).bit_length()  # few sizes, so that tables are found again
    table = _table(prior, size, max_length, code, own.get("target_length"), own.get("spread"))
    return boundaries(probs, table, min_length, max_length, algorithm)


def segments(text: str, probs: np.ndarray, min_length: int, max_length: int | None, prior: str = "uniform", prior_kwargs: dict | None = None, algorithm: str = "viterbi", strip: bool = False, lang: str | None = None) -> list[str]:
    """Cuts one text; see ends_of()."""
    return enforce(text, ends_of(probs, min_length, max_length, prior, prior_kwargs, algorithm, lang), min_length, max_length, strip)
