import math
import re

import numpy as np
import pyarrow as pa

from marquetry.llm import quality as Q


def test_rules_become_the_same_column(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = Q.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), trees=6)
    rows = docs.select(Q.statistics(docs["text"]).alias("s")).select("s.*", model.column().alias("q")).collect()
    x = np.array([r[:-1] for r in rows], float)
    assert np.allclose(model.predict(x), [r["q"] for r in rows], atol=2e-6)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = Q.train(docs, labels.where("doc_id % 2 = 0"))
    got = Q.score(docs, model).withColumnRenamed("quality", "p").join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good, bad = [r["kept"] for r in got if r["quality"] == 1], [r["kept"] for r in got if r["quality"] == 0]
    assert np.mean(good) >= 0.97 and np.mean(bad) <= 0.1


def test_lasso_keeps_few_rules_and_finds_them():
    rng = np.random.default_rng(0)
    x = rng.random((1500, len(Q.STATISTICS)))
    y = ((x[:, 2] > 0.5) & (x[:, 5] <= 0.4)).astype(int)
    model = Q.fit(x, y)
    assert ((model.predict(x) > 0.5) == y).mean() > 0.95
    assert len(model.rules) < 120


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 1), (6, 1, 0), (8, 0, 0), (None, 1, 0), (77, 1, 0), (3, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = Q.train(odd, labels)
    rows = Q.score(odd, model).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows if r["doc_id"]}
    assert all(by[k]["quality"] == 0.0 and not by[k]["kept"] for k in (3, 4, 5))
    none = Q.train(odd, labels.where("quality = 1"))
    rows = {r["doc_id"]: r for r in Q.score(odd, none).collect()}
    assert rows[1]["quality"] is None and rows[1]["kept"] and not rows[3]["kept"]
    assert Q.score(empty, none).collect() == [] and Q.train(empty, labels).intercept is None


def test_statistics_against_loops():
    rng = np.random.default_rng(3)
    parts = ["word", "Word", "é", "今天", " ", "\t", "\n", "\r\n", "!", "?", "12", "#", "\\", " the ", "\n\n", "."]
    texts = ["", " ", "\n", "a", "\n\n a", None] + ["".join(rng.choice(parts, int(rng.integers(0, 60)))) for _ in range(200)]
    got = Q._of_texts(pa.array(texts, pa.string()))
    for t, row in zip(texts, got):
        t = t or ""
        n, words, lines = max(len(t), 1), re.findall(r"[^ \t\r\n]+", t) or [""], t.split("\n")
        share = lambda chars, t=t, n=n: sum(c in chars for c in t) / n
        want = [math.log1p(n), n / len(words), len(set(words)) / len(words), share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("0123456789"), share(".,;:?"), share("#$%&*@|<>{}[]=~^_\\/+"), share("!"), len(set(lines)) / len(lines), len(words) / len(lines)]
        assert np.allclose(row, want), t
    assert np.array_equal(Q._of_texts(pa.array(texts)), np.concatenate([Q._of_texts(pa.array(texts[:90])), Q._of_texts(pa.array(texts[90:]))]))


def brute_tree(x, g, cuts, depth, least):
    """Leaves' mean of g for each row, and the paths, by trying every split."""
    rules, out = [], np.zeros(len(x))

    def grow(path, here):
        if path:
            rules.append(path)
        out[here] = g[here].mean()
        best, gain = None, 1e-9
        if len(path) < depth and len(here) >= 2 * least:
            for j in range(x.shape[1]):
                for c in cuts[j]:
                    low, high = [i for i in here if x[i, j] <= c], [i for i in here if x[i, j] > c]
                    if min(len(low), len(high)) >= least:
                        gone = sum((g[here] - g[here].mean()) ** 2) - sum(sum((g[p] - g[p].mean()) ** 2) for p in (low, high))
                        if gone > gain + 1e-12:
                            best, gain = (j, float(c), low, high), gone
        if best:
            j, c, low, high = best
            grow((*path, (j, False, c)), np.array(low))
            grow((*path, (j, True, c)), np.array(high))

    grow((), np.arange(len(x)))
    return rules, out


def test_trees_against_all_splits():
    rng = np.random.default_rng(5)
    for _ in range(5):
        x, g = rng.random((40, 4)), rng.normal(size=40)
        cuts = [np.quantile(c, [0.2, 0.4, 0.6, 0.8]) for c in x.T]
        rules, out = {}, np.zeros(40)
        Q._tree(x, g, cuts, 3, 4, (), np.arange(40), rules, out)
        want, values = brute_tree(x, g, cuts, 3, 4)
        assert list(rules) == want and np.allclose(out, values)


def test_lasso_against_coordinate_search():
    rng = np.random.default_rng(6)
    z = (rng.random((60, 4)) > 0.5).astype(float)
    y = (z[:, 0] + 0.3 * rng.normal(size=60) > 0.5).astype(float)
    weight, penalty = np.full(60, 1 / 60), 0.02

    def loss(w):
        m = z @ w[:-1] + w[-1]
        return float((weight * (np.logaddexp(0, m) - y * m)).sum() + penalty * np.abs(w[:-1]).sum())

    best = np.zeros(5)
    for step in [1.0, 0.1, 0.01, 0.001, 0.0001] * 6:
        moved = True
        while moved:
            moved = False
            for k in range(5):
                for d in (-step, step):
                    other = best.copy()
                    other[k] += d
                    if loss(other) < loss(best) - 1e-13:
                        best, moved = other, True
    w, intercept = Q._lasso(z, y, weight, penalty, steps=4000)
    assert abs(loss(np.append(w, intercept)) - loss(best)) < 1e-6 and np.allclose(np.append(w, intercept), best, atol=5e-3)


def test_clashing_columns_and_repeats(spark, odd):
    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "x")], "doc_id long, quality int, label string")
    model = Q.train(odd, labels)
    rows = Q.score(odd.unionAll(odd), model).where("doc_id = 1").collect()
    assert len(rows) == 4 and len({r["quality"] for r in rows}) == 1
