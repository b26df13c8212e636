import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from marquetry.operators import flat, segment as S
from marquetry.operators.align import needleman_wunsch, project
from marquetry.operators.chunk import check, effective_block, hat, overlap_average, windows
from marquetry.operators.score import RuleScorer, points, probabilities, sigmoid, spaces


class At:
    """Boundaries after given strings."""

    def __init__(self, *after):
        self.after = after

    def scores(self, texts, langs=None):
        out = []
        for t in texts:
            p = np.zeros(len(t), np.float32)
            for a in self.after:
                k = t.find(a)
                while k >= 0:
                    p[k + len(a) - 1] = 0.9
                    k = t.find(a, k + 1)
            out.append(p)
        return out


def split(spark, texts, scorer=None, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["segments"] for r in S.segment(df, scorer, **options).orderBy("doc_id").collect()]


def test_cuts(spark):
    a, b = "The ferry left at noon ", "Nobody waved from the pier."
    assert split(spark, [a + b], At("at noon")) == [[a, b]]
    assert split(spark, [a + b + "  "], At("at noon"), strip_whitespace=True) == [[a.strip(), b]]
    lines = "Listen\nthe ferry left at noon. " + b
    assert split(spark, [lines], At("at noon.")) == [["Listen", "the ferry left at noon. ", b]]
    assert split(spark, [lines], At("at noon."), split_on_input_newlines=False) == [["Listen\nthe ferry left at noon. ", b]]
    long = "z" * 1500 + " left at noon. " + b
    assert split(spark, [long], At("at noon.")) == [["z" * 1500 + " left at noon. ", b]]


def test_blank_texts(spark):
    assert split(spark, ["", "   ", "   \n", None]) == [[], ["   "], ["   ", ""], None]


def test_paragraphs(spark):
    got = split(spark, ["One. Two.\nThree.\n\nFour.", ""], paragraphs=True)
    assert got == [[["One. ", "Two.\n"], ["Three.\n\n"], ["Four."]], []]


def test_constrained(spark):
    (got,) = split(spark, ["Hello world. " * 15], min_length=25, max_length=65, split_on_input_newlines=False)
    assert "".join(got) == "Hello world. " * 15 and all(25 <= len(s) <= 65 for s in got)
    with pytest.warns(UserWarning, match="threshold"):
        split(spark, ["a"], threshold=0.5, max_length=5)
    with pytest.raises(ValueError, match="min_length"):
        split(spark, ["a"], min_length=7, max_length=5)
    with pytest.raises(ValueError, match="Unknown prior"):
        split(spark, ["a"], max_length=5, prior_type="none")


def test_both_ways_agree(spark):
    texts = ["A b.  C!\n\n d? e", "\n x. y", "...", "。 あ！い", "a .　b", "x.y z. ", "\n\n", "no end"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    own = S.segment(df, split_on_input_newlines=False).withColumn("r", S.rule_segments(F.col("text")))
    for r in own.collect():
        assert r["segments"] == r["r"] and "".join(r["r"]) == r["text"]


def test_a_very_long_text(spark):
    df = spark.createDataFrame([(1, "x" * 1_000_000 + ". " + "y " * 200_000)], "doc_id long, text string")
    a = df.select(F.transform(S.rule_segments(F.col("text")), lambda s: F.length(s)).alias("n")).first()["n"]
    b = S.segment(df).select(F.transform("segments", lambda s: F.length(s)).alias("n")).first()["n"]
    assert a == b == [1_000_002, 400_000]


def test_cut_against_a_loop():
    rng = np.random.default_rng(1)
    for _ in range(300):
        text = "".join(rng.choice(list("ab. \n "), rng.integers(0, 25)))
        places = np.flatnonzero(rng.random(len(text)) < 0.3)
        want, offset = [], 0
        for i in places:
            j = int(i) + 1
            while j < len(text) and text[j].isspace():
                j += 1
            if j > offset:
                want.append(text[offset:j])
            offset = max(j, offset)
        want += [text[offset:]] if offset < len(text) else []
        assert [text[a:b] for a, b in S.cut(points(text), places)] == want


def test_white_space_is_pythons():
    every = "".join(map(chr, [*range(0x3002), 0xFEFF, 0x1F600]))
    assert [c.isspace() for c in every] == spaces(points(every)).tolist()


def test_scores():
    assert RuleScorer().scores(["a. b\n."])[0].tolist() == pytest.approx([0, 0.4, 0, 0, 0.9, 0.4])
    p = probabilities(RuleScorer(), ["a b. c", " ", None, ""], remove_spaces=True)
    assert p[0].tolist() == pytest.approx([0, 0, 0, 0, 0, 0]) and p[1].tolist() == [0] and p[2] is None and p[3].tolist() == [0]
    assert sigmoid(np.array([-np.inf, 0]))[0] == 0


def test_windows():
    assert windows(10, 4, 3) == [(0, 4), (3, 7), (6, 10)] and windows(3, 4, 2) == [(0, 3)]
    with pytest.raises(ValueError, match="stride"):
        check(4, 5)
    x = np.arange(11.0)
    spans = windows(11, 4, 3)
    for how in ("uniform", "hat"):
        assert np.allclose(overlap_average(11, spans, [x[a:b] for a, b in spans], how), x)
    assert np.allclose(hat(4), [0.25, 0.75, 0.75, 0.25])
    assert effective_block(700, 512, 510, 4) == 512 and effective_block(9, 512) == 9


def test_reconstruct():
    text = " One two.  Three \n four."
    assert S.reconstruct(text, ["One two.", "Three", "four."]) == [" One two.  ", "Three \n ", "four."]
    assert S.reconstruct(text, ["One two.x", "four.!"]) == [" One two.  Three \n ", "four."]
    assert S.reconstruct("", ["a"]) == [] and S.reconstruct("abc", []) == ["abc"]


def test_thresholds_by_name():
    assert [S.default_threshold(n) for n in ("x-3l-sm", "x-3l-no-limited-lookahead", "x-3l")] == [0.25, 0.01, 0.025]
    assert S.default_threshold("x", lora=True) == 0.5
    with pytest.warns(UserWarning):
        assert S.default_threshold(object()) == 0.025
    m = {"en": {"ud": (None, None, 0.2, 0.3)}}
    assert S.style_threshold(m, "en", "ud") == 0.3 and S.style_threshold(m, "en", "ud", True) == 0.2
    with pytest.raises(ValueError):
        S.style_threshold(m, "de", "ud")


def test_alignment():
    assert needleman_wunsch("abcd", "acd") == ("abcd", "a@cd")
    assert needleman_wunsch("", "ab") == ("@@", "ab")
    rng = np.random.default_rng(0)
    for _ in range(40):
        a, b = ("".join(rng.choice(list("abc"), rng.integers(0, 9))) for _ in "ab")
        x, y = needleman_wunsch(a, b)
        assert x.replace("@", "") == a and y.replace("@", "") == b and len(x) == len(y)
    assert project("ab@c", "a||c") == ("abc", "a|c")
    assert project("ab|c", "abxc", separator="") == ("ab|c", "abc")


class Cycled:
    """Any scorer: probabilities from a cycle of numbers."""

    def scores(self, texts, langs=None):
        return [np.array([(7 * i + len(t)) % 5 / 5 for i in range(len(t))], np.float32) for t in texts]


TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aé今🙂.!\n \u3000\u00a0。", max_size=30)), max_size=12)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.booleans(), st.booleans(), st.sampled_from([-0.001, 0.0, 0.25, 0.5, 0.9, 1.0]), st.sampled_from([RuleScorer(), Cycled()]), st.integers(1, 40))
def test_batches_are_cut_like_single_texts(texts, strip, lines, threshold, scorer, size):
    column, langs = pa.array(texts, pa.string()), pa.nulls(len(texts), pa.string())
    options = S.Options(threshold=threshold, strip_whitespace=strip, split_on_input_newlines=lines)
    probs = probabilities(scorer, texts)
    want = [None if t is None else options.split(t, p, None)[0] for t, p in zip(texts, probs)]
    old, flat.SLICE_BYTES = flat.SLICE_BYTES, size
    try:
        assert flat.segments(scorer, column, langs, threshold, strip, lines).to_pylist() == want
        got = flat.probability_lists(scorer, column, langs).to_pylist()
    finally:
        flat.SLICE_BYTES = old
    assert [p if p is None else [np.float32(x) for x in p] for p in got] == [p if p is None else p.tolist() for p in probs]
