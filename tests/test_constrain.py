import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from marquetry.functions.priors import NAMES, length_defaults, weights
from marquetry.operators import constrain as C


def sizes(ends, n):
    edges = [0, *ends, n]
    return [b - a for a, b in zip(edges, edges[1:])]


def brute_viterbi(probs, prior, low, high):
    """All positions and lengths, one by one; of equal scores the earliest start stays."""
    n = len(probs)
    best, source = [-math.inf] * (n + 1), [0] * (n + 1)
    best[0] = 0.0
    with np.errstate(divide="ignore"):
        log_p = np.log(probs)
    for i in range(1, n + 1):
        for j in range(max(0, i - high), i - low + 1):
            if prior[i - j] > 0:
                s = best[j] + np.log(prior[i - j]) + (log_p[i - 1] if i < n else 0.0)
                if s > best[i]:
                    best[i], source[i] = s, j
    if best[n] == -math.inf:
        return None
    ends, at = [], n
    while at:
        ends.append(at)
        at = source[at]
    return ends[::-1][:-1]


def brute_greedy(probs, prior, low, high):
    n, at, ends = len(probs), 0, []
    while at < n:
        best, where = -math.inf, n
        for e in range(at + low, min(at + high, n) + 1):
            s = prior[e - at] * (1.0 if e == n else float(probs[e - 1]))
            if s > best:
                best, where = s, e
        if where == n:
            return ends, n - at
        ends.append(where)
        at = where
    return ends, 0


UNIFORM = np.ones(2000)


def tenths(digits):
    """Probabilities in tenths; x is 1."""
    return [1.0 if d == "x" else int(d) / 10 for d in digits]


CASES = [(tenths("135792468x"), 3, 5), (tenths("1119111919"), 4, 6), (tenths("11911119"), 3, 5), (tenths("0" * 15), 5, 5)]


@pytest.mark.parametrize(("probs", "low", "high"), CASES)
def test_lengths_of_small_cases(probs, low, high):
    assert all(low <= s <= high for s in sizes(C.boundaries(probs, UNIFORM, low, high), len(probs)))


def test_impossible_minimum():
    probs = tenths("1111919")
    got = sizes(C.boundaries(probs, UNIFORM, 4, 5), 7)
    assert sum(got) == 7 and max(got) <= 5


def test_sparse_prior_falls_back():
    probs = tenths("2839x94")
    got = sizes(C.boundaries(probs, lambda n: 0.0 if n % 3 == 1 else 1.0, 3, 5), 7)
    assert sum(got) == 7 and all(3 <= s <= 5 for s in got)


def test_more_cases():
    p = np.zeros(100)
    p[[49, 99]] = 0.99
    assert 50 in C.boundaries(p, UNIFORM, 1, 60)
    p = np.full(100, 0.1)
    p[[54, 84]] = 0.99
    assert max(sizes(C.boundaries(p, UNIFORM, 20, 40, "greedy"), 100)) <= 40
    got = C.boundaries(np.full(100, 0.5), UNIFORM, 1, 25)
    assert len(got) >= 3 and max(sizes(got, 100)) <= 25
    assert C.boundaries([], UNIFORM, 1, 10) == []
    assert len(C.boundaries([0.5] * 3, UNIFORM, 10)) <= 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.9, 1.0]), min_size=1, max_size=40), st.integers(1, 6), st.integers(0, 12), st.sampled_from(NAMES))
def test_searches_against_loops(probs, low, more, name):
    probs = np.array(probs, np.float32)
    high = low + more
    prior = weights(name, 60, high, target_length=6, spread=3)
    want = brute_viterbi(probs, prior, low, high)
    got = C.viterbi(probs, prior, low, high)
    if want is not None:
        assert got == C._repaired(want, len(probs), low, high)
    assert all(s <= high for s in sizes(got, len(probs)))
    ends, rest = brute_greedy(probs, prior, low, high)
    greedy = C.greedy(probs, prior, low, high)
    assert greedy == ends or (0 < rest < low and greedy == ends[:-1])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n　é", max_size=120), st.integers(1, 20), st.integers(0, 30), st.sampled_from(C.ALGORITHMS), st.integers(0, 2**32 - 1))
def test_segments_keep_text_and_limit(text, low, more, algorithm, seed):
    probs = np.random.default_rng(seed).random(len(text)).astype(np.float32)
    got = C.segments(text, probs, low, low + more, algorithm=algorithm)
    assert "".join(got) == text and all(len(s) <= low + more for s in got)
    stripped = C.segments(text, probs, low, low + more, algorithm=algorithm, strip=True)
    assert all(len(s) <= low + more and s.strip() for s in stripped)


def test_enforcement():
    assert C.enforce("", [], 1, 5) == [] and C.enforce("   ", [], 1, 2) == ["  ", " "] and C.enforce("  ", [], 1, 2, strip=True) == []
    assert C.enforce("aa bb cc dd", [], 1, 6) == ["aa bb ", "cc dd"]
    assert C.enforce("a. b. cccc.", [2, 5], 4, None) == ["a. b. ", "cccc."]
    assert C.enforce("aaaa. b", [5], 3, 10) == ["aaaa. b"]


@pytest.mark.parametrize(("args", "message"), [((0, 5, "viterbi"), "min_length must be >= 1"), ((6, 5, "viterbi"), "min_length.*cannot be greater than max_length"), ((-1, 0, "viterbi"), "min_length must be >= 1"), ((-2, -1, "viterbi"), ">= 1"), ((1, 5, "best"), "Unknown algorithm")])
def test_wrong_arguments(args, message):
    with pytest.raises(ValueError, match=message):
        C.check(*args)
    with pytest.raises(ValueError, match="Unknown prior_type"):
        weights("flat", 5)


def test_priors():
    assert length_defaults(None) == (70, 25) and length_defaults("de") == (111, 61) and length_defaults("zh", target_length=9) == (9, 19)
    with pytest.warns(UserWarning, match="no sentence lengths"):
        assert length_defaults("qq") == (70, 25)
    for name in ("gaussian", "clipped_polynomial", "lognormal"):
        w = weights(name, 200, 150, target_length=60, spread=20)
        assert w[1:].argmax() + 1 == 60 and (w[151:] == 0).all()
    assert weights("lognormal", 5)[0] == 0


def test_a_long_text_is_fast():
    import time

    p = np.where(np.arange(120_000) % 50 == 49, 0.4, 0).astype(np.float32)
    began = time.time()
    C.boundaries(p, np.ones(120_001), 20, None)
    assert time.time() - began < 60
