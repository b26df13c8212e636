import numpy as np
import pytest
from pyspark.sql import functions as F

from marquetry.operators.score import train_linear_scorer
from marquetry.plans import corpus as C, evaluate as E


def test_labels(spark):
    df = spark.createDataFrame([("en", 0, 0, "ab"), ("en", 0, 1, "c"), ("zh", 1, 0, "ab"), ("zh", 1, 1, "c")], "lang string, doc_id long, sent_idx long, sentence string")
    got = sorted(tuple(r) for r in E.gold_boundaries(df, ["doc_id"]).select("doc_id", "pos").collect())
    assert got == [(0, 3), (0, 4), (1, 2), (1, 3)]
    got = sorted(tuple(r) for r in E.gold_boundaries(df, ["doc_id"], after_space=False).select("doc_id", "pos").collect())
    assert got == [(0, 1), (0, 3), (1, 1), (1, 2)]


def test_scores_without_boundaries(spark):
    counts = spark.createDataFrame([(0, 0, 0), (0, 2, 0), (3, 1, 2)], "tp long, fp long, fn long")
    got = [tuple(r)[3:] for r in E.scores(counts).orderBy("tp", "fp").collect()]
    assert got == [(0.0, 0.0, 0.0, True), (0.0, 0.0, 0.0, False), (0.75, 0.6, pytest.approx(2 / 3), False)]


def test_permutation(spark):
    rng = np.random.default_rng(0)
    same = [("same", d, *[int(x) for x in rng.integers(0, 9, 6)]) for d in range(40)]
    apart = [("apart", d, 9, 1, 1, 2, 8, 8) for d in range(40)]
    df = spark.createDataFrame(same + apart, "lang string, doc_id long, tp_a long, fp_a long, fn_a long, tp_b long, fp_b long, fn_b long")
    p = {r["lang"]: r for r in E.permutation_test(df, ["lang"], rounds=400, per_task=100).collect()}
    assert p["apart"]["p_f1"] < 0.01 and p["same"]["p_f1"] > 0.01
    table = E.latex_matrix([("a", "b", 0.5)], ["a", "b"])
    assert "0.500" in table and "-" in table


def by_character(s):
    return [ord(c) for c in s], list(range(len(s)))


def test_packing(spark, monkeypatch):
    rows = [("en", "d", i, s) for i, s in enumerate(["aaa", "bb", "", "12", "c" * 50, "dddd", "ee", "f" * 8])]
    df = spark.createDataFrame(rows, "lang string, dataset string, i long, sentence string")
    got = C.pack_sentences(df, ["lang", "dataset"], ["i"], 12, by_character).orderBy("block_id").collect()
    texts = ["".join(chr(c) for c, m in zip(r["input_ids"], r["attention_mask"]) if m)[1:-1] for r in got]
    assert texts == ["aaa bb", "dddd ee", "f" * 8]
    assert all(len(r["input_ids"]) == len(r["labels"]) == 12 for r in got)
    assert [i for i, x in enumerate(got[0]["labels"]) if x == 1] == [3, 6] and got[0]["labels"][-1] == -100
    assert [r["input_ids"][0] for r in got] == [0, 0, 0] and got[0]["input_ids"][7] == 2
    one = C.pack_sentences(df, ["lang", "dataset"], ["i"], 40, by_character, p_add=0.0).collect()
    assert sorted(sum(r["attention_mask"]) - 2 for r in one) == [2, 2, 3, 4, 8]
    dots = spark.createDataFrame([("en", "d", i, "ab.") for i in range(400)], "lang string, dataset string, i long, sentence string")
    flipped = C.pack_sentences(dots, ["lang", "dataset"], ["i"], 40, by_character, p_flip=0.5).collect()
    joined = "|".join("".join(map(chr, r["input_ids"])) for r in flipped)
    assert 100 < joined.count(".a") < 250 and 100 < joined.count(". a") < 250
    monkeypatch.setattr(C, "PACKED_TOGETHER", 3)
    parts = C.pack_sentences(df, ["lang", "dataset"], ["i"], 12, by_character).orderBy("block_id").collect()
    assert ["".join(chr(c) for c, m in zip(r["input_ids"], r["attention_mask"]) if m)[1:-1] for r in parts] == ["aaa bb", "dddd", "ee", "f" * 8]


def test_sentence_end_labels_of_words():
    def words(text):
        import re

        return [len(m.group()) for m in re.finditer(r"\S+", text)], [m.start() for m in re.finditer(r"\S+", text)]

    assert C.sentence_end_labels(["a b", "c", "d e f"], words, [" "] * 3) == ([0, 1, 1, 1, 1, 1, 1, 2], [0, 0, 1, 1, 0, 0, 1, 0])
    # a word that goes over a sentence's end ends it
    assert C.sentence_end_labels(["a b", "c d"], words, ["", ""])[1] == [0, 0, 1, 1, 0]


def test_blocks_with_overflow(spark):
    texts = ["abcdefg", "", "hijkl", "mnopqrstuvw"]
    df = spark.createDataFrame([("x", i, t) for i, t in enumerate(texts)], "lang string, i long, text string")
    whole = "".join(texts)
    for block, overflow in ((5, 0), (5, 2), (4, 4), (7, 3), (30, 0), (6, 9)):
        got = {}
        for r in C.token_blocks(df, ["lang"], ["i"], block, overflow=overflow).orderBy("block", "i").collect():
            got[r["block"]] = got.get(r["block"], "") + texts[r["i"]][r["start"] : r["start"] + r["length"]]
        want = [whole[k : k + block + overflow] for k in range(0, len(whole), block)]
        assert [got[k] for k in sorted(got)] == [w for w in want if len(w) == block + overflow]


def test_merged_indices(spark):
    schema = "lang string, dataset string, system string, doc_id long, predicted array<int>, true array<int>, length int"
    a = spark.createDataFrame([("en", "d", "a", 0, [1], [1, 3], 4)], schema)
    b = spark.createDataFrame([("en", "d", "b", 0, [3], [3, 1], 4)], schema)
    r = E.merge_indices([a, b]).first()
    assert r["predicted"] == {"a": [1], "b": [3]} and r["length"] == 4
    with pytest.raises(ValueError, match="agree"):
        E.merge_indices([a, b.withColumn("length", F.lit(5))])
    assert E.index_conflicts(a.unionByName(b.withColumn("true", F.array(F.lit(2))))).first()["true_sets"] == 2


def test_permutation_against_plain_rounds(spark):
    rng = np.random.default_rng(3)
    rows = [("x", d, *[int(x) for x in rng.integers(0, 6, 6)]) for d in range(30)]
    df = spark.createDataFrame(rows, "lang string, doc_id long, tp_a long, fp_a long, fn_a long, tp_b long, fp_b long, fn_b long")
    got = E.permutation_test(df, ["lang"], rounds=4000, per_task=7).first()

    def prf(c):
        with np.errstate(all="ignore"):
            tp, fp, fn = c
            return np.nan_to_num(np.stack([tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn)]))

    v = np.array([r[2:] for r in rows], float).T
    apart = prf(v[:3]) - prf(v[3:])
    signs = rng.choice([-1, 1], (4000, 30))
    want = [(np.abs(signs @ a) >= abs(a.sum()) - 1e-9).mean() for a in apart]
    assert np.allclose([got["p_precision"], got["p_recall"], got["p_f1"]], want, atol=0.04)
    again = E.permutation_test(df.repartition(5), ["lang"], rounds=4000).first()
    assert tuple(got) == tuple(again)


def test_corrupt_training(spark):
    df = spark.createDataFrame([(1, "Ab, c.\nD"), (2, None), (3, "")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in C.corrupt_training(df, "doc_id", newline_rate=1.0, mark_rate=1.0).collect()}
    assert rows[1]["text"] == "Ab cD" and rows[1]["labels"][1] > 1 and len(rows[1]["labels"]) == 5 and rows[2]["text"] == ""
    rows = {r["doc_id"]: r for r in C.corrupt_training(df, "doc_id", newline_rate=1.0, mark_rate=0.0, space_rate=1.0).collect()}
    assert rows[1]["text"] == "Ab, c. D" and rows[1]["labels"][5] == 1
    rows = {r["doc_id"]: r for r in C.corrupt_training(df, "doc_id", newline_rate=0.0, mark_rate=0.0).collect()}
    assert rows[1]["text"] == "Ab, c.\nD"


def test_checks(spark):
    df = spark.createDataFrame([("a",), ("b\nc",)], "sentence string")
    with pytest.raises(ValueError, match="line breaks"):
        C.require_clean(df)
    C.require_clean(df.where("sentence = 'a'"))


def test_thinning_leaves_languages_without_punctuation(spark):
    df = spark.createDataFrame([(i, "th" if i < 10 else "en", i % 2 == 0) for i in range(40)], "k long, lang string, p boolean")
    got = C.thin_unpunctuated(df, "p", 0.25, ["k"]).groupBy("lang", "p").count().collect()
    assert {(r["lang"], r["p"]): r["count"] for r in got} == {("th", True): 5, ("th", False): 5, ("en", True): 15, ("en", False): 5}


def test_mixture(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = x @ [2.0, -1.0, 0.5] + rng.normal(size=400) * 0.1 > 0
    df = spark.createDataFrame([(v.tolist(), bool(b), float(round(v[0], 2))) for v, b in zip(x, y)], "x array<double>, y boolean, s double")
    m = E.fit_mixture(df, "x", "y", "s")
    assert m["coefficients"][0] > 0 > m["coefficients"][1] and 0 < m["punctuation"] < 1
    assert E.fit_mixture(df, "x", "y", "s", skip_punctuation=True)["coefficients"] is None


def test_linear_scorer_learns_line_ends(spark):
    docs = spark.createDataFrame([(i, "\n".join(f"word{i % 7} goes on {j} end;" for j in range(30))) for i in range(20)], "doc_id long, text string")
    scorer = train_linear_scorer(docs, rate=0.3)
    p = scorer.scores(["it goes on 3 end; and more"])[0]
    assert p.argmax() == "it goes on 3 end; and more".index(";")


def test_sampling_does_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = {r["k"] for r in C.take(df, ["k"], share=0.2).collect()}
    assert a == {r["k"] for r in C.take(df.repartition(9), ["k"], share=0.2).collect()} and 140 < len(a) < 260
    assert {r["k"] for r in C.take(df, ["k"], n=10).collect()} == {r["k"] for r in C.take(df.repartition(5), ["k"], n=10).collect()}


def test_statistics_skip_nulls(spark):
    df = spark.createDataFrame([("d", "a", 1.0), ("d", "b", None), ("d", "c", 3.0)], "g string, n string, v double")
    r = E.statistics(df, "v", "n", ["g"]).first()
    assert (r["mean"], r["median"], r["std"], r["min_name"], r["max_name"]) == (2.0, 2.0, 1.0, "a", "c")
    assert E.statistics(df.where(F.lit(False)), "v", "n", ["g"]).count() == 0


def test_tolerances(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 1.0)], "k long, v double")
    b = spark.createDataFrame([(1, 1.00005), (2, 1.1)], "k long, v double")
    assert {r["k"] for r in E.far_apart(a, b, ["k"], "v").collect()} == {2, 3}
    assert E.logit(0.5) == 0 and E.logit(0.9) == pytest.approx(2.19722, abs=1e-4)


def test_blocks_go_on_across_stretches(spark, monkeypatch):
    """What is packed doesn't depend on how many sentences a task packs at a time."""
    rows = [("en", i, "." if i % 11 == 0 else "7" if i % 13 == 0 else "x" * (i * 7919 % 13 + 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "lang string, i long, sentence string")
    found = []
    for stretch in (1000, 7):
        monkeypatch.setattr(C, "STRETCH", stretch, raising=False)
        monkeypatch.setattr(C, "PACKED_TOGETHER", stretch if C.PACKED_TOGETHER else None)
        got = C.pack_sentences(df, ["lang"], ["i"], 16, by_character).orderBy("block_id").collect()
        found.append([(r["block_id"], r["input_ids"], r["labels"]) for r in got])
    assert found[0] == found[1] and len(found[0]) > 50


def test_kmer_scores_by_batch(spark):
    """All k-mers as one array give what each gives by itself, for any probabilities; sentences are scored in one function."""
    rng = np.random.default_rng(3)
    for _ in range(50):
        size = rng.integers(1, 30, 7)
        starts = np.concatenate([[0], np.cumsum(size)])
        p = rng.choice(np.array([0, 0, 0.1, 0.3, 0.4, 0.9], np.float32), starts[-1])
        true = rng.random(starts[-1]) < 0.2
        true[starts[1:] - 1] = True
        got = E._kmer_scores(p, starts, true, 0.25).to_pylist()
        for a, b, row in zip(starts, starts[1:], got, strict=False):
            q, y = p[a:b], true[a:b]
            area, f1s, before = 0.0, [], (0.0, 1.0)
            for t in sorted(set(q.tolist()), reverse=True):
                pr, re = y[q >= t].sum() / (q >= t).sum(), y[q >= t].sum() / y.sum()
                area, before = area + (re - before[0]) * (pr + before[1]) / 2, (re, pr)
                f1s.append((2 * pr * re / (pr + re + 1e-6), -t))
            top, t = max(f1s)
            want = area, top, -t, (q[:-1] > 0.25).any(), ((q[:-1] > 0.25) == y[:-1]).all(), ((q[:-1] > -t) == y[:-1]).all()
            assert list(row.values()) == pytest.approx(list(want))
    docs = spark.createDataFrame([(1, ["A.", "B", "C!"]), (2, ["x"]), (3, []), (4, None), (5, ["a b.", "c. d"])], "id int, s array<string>")
    each = E.kmer_scores_of(docs, ["id"], "s", 2, 0.25)
    assert sorted((r["id"], r["found"], r["correct"]) for r in each.collect()) == [(1, True, True), (5, True, False)]


@pytest.mark.parametrize("name", ["pair_evaluation", "kmer_evaluation"])
def test_kmers_stay_in_python(spark, sf_dir, name):
    from marquetry.registry import QUERIES

    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 2
