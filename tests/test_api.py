import numpy as np
import pytest

from marquetry.api import Segmenter


def test_split_and_probabilities(spark):
    s = Segmenter()
    assert s.split("A b. C d.\nE") == ["A b. ", "C d.", "E"]
    assert list(s.split(["A. B.", "", "   "])) == [["A. ", "B."], [], ["   "]]
    assert s.split("A. B.\nC.", do_paragraph_segmentation=True) == [["A. ", "B.\n"], ["C."]]
    assert s.split("A. B.", threshold=0.9) == ["A. B."]
    assert all(len(x) <= 4 for x in s.split("A. B. C. D.", max_length=4, split_on_input_newlines=False))
    assert len(s.predict_proba("A. B.")) == 5 and [len(p) for p in s.predict_proba(["ab", "c"], outer_batch_size=1)] == [2, 1]
    df = spark.createDataFrame([(1, "A. B.")], "k long, text string")
    assert s.split_frame(df).first()["segments"] == ["A. ", "B."]
    assert len(s.predict_frame(df).first()["probs"]) == 5


def test_styles():
    s = Segmenter(language="en", mixtures={"en": {"ud": (([2.0], 1.0), None, 0.6, 0.3), "plain": (None, None, 0.5, 0.2)}})
    assert s.get_threshold("en", "ud") == 0.3 and s.get_threshold("en", "ud", True) == 0.6
    own, newline = s.predict_proba("A. B.", style="ud", return_paragraph_probabilities=True)
    assert own[1] > 0.5 and np.isclose(newline[1], 0.4) and own[0] == 0
    assert s.split("A. B.", style="plain") == ["A. B."]
    with pytest.raises(ValueError):
        s.split("A", style="none")


MIXTURES = {"en": {"ud": (([2.0], 1.0), None, 0.6, 0.3), "low": (([1.0], 0.0), None, 0.1, 0.1)}, "de": {"ud": (([1.0], -5.0), None, 0.6, 0.3)}}


def test_paragraphs_with_a_style():
    s = Segmenter(language="en", mixtures=MIXTURES)
    # the style's probability of the full stop, 0.55, is above the paragraphs' threshold, the scorer's own isn't
    assert s.split("A b. C.\nD. E.", do_paragraph_segmentation=True, style="ud") == [["A b. C.\n"], ["D. E."]]
    assert s.split("A b. C.\nD. E.", do_paragraph_segmentation=True, style="low") == [["A b. ", "C.\n"], ["D. ", "E."]]
    assert s.split("A b.\nC d.", do_paragraph_segmentation=True) == [["A b.\n"], ["C d."]]


def test_frames_give_what_lists_give(spark):
    s = Segmenter(language="en", mixtures=MIXTURES)
    texts = ["A b. C.\nD. E.", "One two. Three", "", None, "  "]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    known = [t for t in texts if t is not None]
    for options in ({"style": "ud"}, {"style": "low", "do_paragraph_segmentation": True}, {"lang_code": "de", "style": "ud"}, {"lang_code": "de", "min_length": 2, "max_length": 6, "prior_type": "gaussian"}, {"threshold": 0.5, "style": "low"}, {}):
        want = list(s.split(known, **options))
        paragraphs = {"paragraphs": True} if options.get("do_paragraph_segmentation") else {}
        chosen = {k: v for k, v in options.items() if k != "do_paragraph_segmentation"} | paragraphs
        got = [r["segments"] for r in s.split_frame(df, **chosen).orderBy("k").collect()]
        assert got == [*want[:3], None, want[3]], options
    pairs = list(s.predict_proba(known, style="ud", return_paragraph_probabilities=True))
    rows = [r["probs"] for r in s.predict_frame(df, style="ud", return_paragraph_probabilities=True).orderBy("k").collect() if r["k"] != 3]
    assert all(np.allclose(r["sentence"], a) and np.allclose(r["newline"], b) for r, (a, b) in zip(rows, pairs))
    by_row = df.selectExpr("*", "if(k = 0, 'de', 'en') as l")
    got = [r["segments"] for r in s.split_frame(by_row, lang="l", style="ud").where("k < 2").orderBy("k").collect()]
    assert got == [s.split(texts[0], "de", "ud"), s.split(texts[1], "en", "ud")]
