"""What a batch takes in Python, beside the batch and its result, is bounded whatever its size."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from marquetry.functions.priors import weights
from marquetry.operators import constrain, flat, segment as S
from marquetry.operators.score import RuleScorer

TEXT = "Ein Satz mit einigen Wörtern. Noch einer!\nUnd ein dritter? " * 50
STYLE = S.Style({"de": {"own": (([2.0], 1.0), None, 0.5, 0.5)}}, "own")


def peak(f) -> float:
    """MB of Python and numpy, Arrow's own not counted."""
    f()
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def batch(mb: int, times: int = 1) -> tuple[pa.Array, pa.Array]:
    n = mb * 10**6 // len(TEXT.encode()) // times
    return pa.array([TEXT * times] * n), pa.array(["de"] * n)


def test_plain_segments():
    texts, langs = batch(2)
    assert peak(lambda: flat.segments(RuleScorer(), texts, langs, 0.25, True, False)) < 20


def test_end_tokens():
    from marquetry.queries import corpora

    lists = flat.segments(RuleScorer(), *batch(2), 0.25, True, False)
    assert peak(lambda: corpora._end_tokens(lists)) < 5
    first = corpora._end_tokens(lists[:1].slice(0, 1))[0].as_py()
    assert first[0] == len("Ein Satz mit einigen Wörtern.") and len(first) == len(lists[0])


@pytest.mark.parametrize("options", [{"style": STYLE, "paragraphs": True}, {"style": STYLE}, {"min_length": 20, "max_length": 200, "prior_type": "gaussian"}], ids=["styled_paragraphs", "evaluate_mixture", "constrained_viterbi"])
def test_segments_of_other_kinds(spark, options):
    style = options.get("style")
    run = S._udf(RuleScorer(), S.Options(split_on_input_newlines=False, **{k: v for k, v in options.items() if k != "style"}), style).func
    assert peak(lambda: run(*batch(2, times=10))) < 12


@pytest.mark.parametrize("options", [{"max_length": 200, "prior_type": "clipped_polynomial", "algorithm": "greedy"}, {}], ids=["constrained_greedy", "constrained_min_only"])
def test_constrained_whatever_the_batch(spark, options):
    run = S._udf(RuleScorer(), S.Options(split_on_input_newlines=False, min_length=20, **options), None).func
    assert peak(lambda: run(*batch(2))) < 1.2 * peak(lambda: run(*batch(1)))


def test_viterbi_holds_places_not_characters():
    """A text of any length: what the search holds is of the places it can cut at, beside a mask of a byte a character."""
    n = 200_000
    probs = np.zeros(n, np.float32)
    probs[99::100] = 0.4
    ends = []
    assert peak(lambda: ends.append(constrain.viterbi(probs, weights("gaussian", 256, 200, "de", None, None), 20, 200))) < 3 * n / 1e6
    assert ends[0][0] in (100, 200) and ends[0] == sorted(set(ends[0])) and n - ends[0][-1] in (100, 200)


@pytest.mark.parametrize("query", ["styled_paragraphs", "multi_sentence_docs", "sentence_end_labels", "constrained_segments", "viterbi_ends", "predict_hits"])
def test_texts_go_to_python_once(spark, sf_dir, query):
    """No filter that Spark infers from an explode makes the function run twice over what a scan reads."""
    from marquetry.registry import QUERIES

    plan = QUERIES[query](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == plan.count("FileScan parquet") > 0


@pytest.mark.parametrize("query", ["iou", "prf_by_doc", "exclude_every_k"])
def test_sentences_and_their_places_are_one_function(spark, sf_dir, query):
    from marquetry.registry import QUERIES

    plan = QUERIES[query](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_nonpunct_downsample_segments_once(spark, sf_dir):
    """What is left to do reads rows that are written already, with no function in Python."""
    from marquetry.registry import QUERIES

    rows = QUERIES["nonpunct_downsample"](spark, sf_dir)
    assert "EvalPython" not in rows._jdf.queryExecution().executedPlan().toString()
    assert not any("documents" in f for f in rows.inputFiles())


def test_exclude_every_k_moves_no_rows(spark, sf_dir):
    """Boundaries are compared as arrays: nothing is shuffled or joined."""
    from marquetry.registry import QUERIES

    plan = QUERIES["exclude_every_k"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
