import math
import re

import numpy as np

from marquetry.llm import decontaminate as D

WORDS = [f"{a}{b}" for a in "bcdfghjklm" for b in ("a", "ero", "int", "olus", "ut")]


def pairs(words):
    return set(zip(words, words[1:]))


def brute(docs, items, similarity):
    items = {i: re.findall(r"[a-z0-9]+", t.lower()) for i, t in items}
    df = {}
    for w in items.values():
        for s in pairs(w):
            df[s] = df.get(s, 0) + 1
    weight = lambda s: math.log1p(len(items) / df[s]) if s in df else math.log1p(len(items))
    out = {}
    for d, t in docs:
        w = re.findall(r"[a-z0-9]+", t.lower())
        for i, own in items.items():
            own_pairs = pairs(own)
            n = len(own)
            for at in range(max(1, len(w) - n + 1)):
                p = pairs(w[at : at + n])
                both = sum(map(weight, p & own_pairs))
                s = both / sum(map(weight, p | own_pairs)) if p | own_pairs else 0
                if s >= similarity and s > out.get((d, i), 0):
                    out[d, i] = s
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    items = [(k, " ".join(rng.choice(WORDS, int(rng.integers(8, 40))))) for k in range(25)] + [(99, "too short")]
    docs = []
    for d in range(120):
        words = rng.choice(WORDS, int(rng.integers(5, 200))).tolist()
        if d % 3 == 0:
            own = items[int(rng.integers(0, 25))][1].split()
            for i in np.flatnonzero(rng.random(len(own)) < 0.06):
                own[i] = "edited"
            at = int(rng.integers(0, len(words)))
            words[at:at] = [w.upper() for w in own]
        docs.append((d, ", ".join(words)))
    want = brute(docs, items, D.SIMILARITY)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in D.matches(d, b).collect()}
    assert set(got) <= set(want)
    assert len(got) >= 0.95 * len(want) and len(want) > 20
    assert all(abs(got[k] - want[k]) < 1e-5 for k in got if want[k] > 0.9)
    clean = {r["doc_id"] for r in D.decontaminate(d, b).collect()}
    assert clean == {i for i, _ in docs} - {i for i, _ in got}


def index_of(items, **options):
    return D.Index(list(range(len(items))), items, np.ones(1 << D.WEIGHT_BITS, np.float32), **options)


def test_all_fingerprints_within_the_radius_are_candidates():
    rng = np.random.default_rng(5)
    index = index_of([" ".join(rng.choice(WORDS, 20)) for _ in range(30)])
    (size,) = index.sizes
    own, items, _ = index.sizes[size]
    near = []
    for k, fp in enumerate(own):
        for bits in (0, 5, D.RADIUS):
            x = int(fp)
            for b in rng.permutation(64)[:bits]:
                x ^= 1 << int(b)
            near.append((x, k))
    window, item = index._candidates(np.array([x for x, _ in near], np.uint64), size)
    found = set(zip(window.tolist(), item.tolist()))
    for w, (x, _) in enumerate(near):
        want = {(w, int(items[k])) for k in np.flatnonzero(np.bitwise_count(own ^ np.uint64(x)) <= D.RADIUS)}
        assert want == {p for p in found if p[0] == w}


def test_odd_rows(spark, odd, empty):
    item = "the river runs past the old mill and the people of the town walk there"
    b = spark.createDataFrame([(1, item), (1, None), (None, item), (2, ""), (3, "quick brown fox")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["similarity"]) for r in D.matches(odd, b).collect()}
    assert got == {(6, 1, 1.0), (6, None, 1.0), (1, 3, 1.0)}
    clean = D.decontaminate(odd, b)
    assert clean.columns == odd.columns and clean.count() == odd.count() - 3
    assert D.matches(odd, b.where("item_id > 5")).collect() == [] and D.matches(empty, b).collect() == []
    assert D.decontaminate(odd, b.where("item_id > 5")).count() == odd.count()


def test_a_benchmark_in_several_parts(spark, monkeypatch):
    monkeypatch.setattr(D, "PASS_BYTES", 1)
    items = [(k, f"alpha{k} beta gamma{k} delta epsilon{k} zeta eta{k} theta iota{k}") for k in range(3)]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame([(k, "so " + t + " it is") for k, t in items] + [(9, "nothing")], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in D.matches(d, b).collect()} == {(0, 0), (1, 1), (2, 2)}
    assert [r["doc_id"] for r in D.decontaminate(d, b).collect()] == [9]


def test_passes_do_not_change_results(spark, monkeypatch):
    rng = np.random.default_rng(8)
    phrase = "in which of the following cases would one say that".split()
    items, docs = [], []
    for k in range(40):
        own = [*phrase, *rng.choice(WORDS, 12).tolist()]
        items.append((k, " ".join(own)))
        for edits in range(1, 8):  # similarities around the threshold
            words = list(own)
            for i in rng.permutation(len(words))[:edits]:
                words[i] = "edited"
            docs.append((len(docs), " ".join([*rng.choice(WORDS, 30), *words, *rng.choice(WORDS, 30)])))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(tuple, D.matches(d, b).collect()))
    clean = sorted(r["doc_id"] for r in D.decontaminate(d, b).collect())
    monkeypatch.setattr(D, "PASS_BYTES", 1500)
    assert sorted(map(tuple, D.matches(d, b).collect())) == want and 20 < len(want) < len(docs)
    assert sorted(r["doc_id"] for r in D.decontaminate(d, b).collect()) == clean


def test_neighbours_are_the_same_either_way(monkeypatch):
    rng = np.random.default_rng(1)
    asked, values = np.unique(rng.integers(0, 1 << 16, 600)), np.unique(rng.integers(0, 1 << 16, 4000))
    want = {(i, j) for i, a in enumerate(asked.tolist()) for j, v in enumerate(values.tolist()) if (a ^ v).bit_count() <= 4}
    assert len(values) > len(D._neighbours(4))
    assert set(zip(*(x.tolist() for x in D._near(asked, values, 4)))) == want
    few = values[:2000]
    assert set(zip(*(x.tolist() for x in D._near(asked, few, 4)))) == {(i, j) for i, j in want if j < 2000}


def test_short_items(spark):
    items = [(1, "What is the capital of France?"), (2, "two words"), (3, "one"), (4, "今天天气很好我们去公园散步")]
    docs = [(1, "so: what is the capital of france"), (2, "These two words."), (3, "one"), (4, "only one of them"), (5, "他说今天天气很好我们去公园散步吧"), (6, "the capital of Italy is what"), (7, "two, many words")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.matches(d, b).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (5, 4)}
    assert sorted(r["doc_id"] for r in D.decontaminate(d, b).collect()) == [4, 6, 7]


def test_items_that_share_most_of_their_words(spark, monkeypatch):
    items = [(k, f"which of these seven words is number {k}x") for k in range(6)]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame([(0, "well, which of these seven words is number 9x then")], "doc_id long, text string")
    want = D.matches(d, b).collect()
    monkeypatch.setattr(D, "PASS_BYTES", 1)
    assert D.matches(d, b).collect() == want


def test_an_index_is_small():
    import pickle

    rng = np.random.default_rng(4)
    words = np.array([f"w{i}" for i in range(5000)])
    index = index_of([" ".join(rng.choice(words, int(n))) for n in rng.integers(10, 100, 2000)])
    assert len(pickle.dumps(index)) < 10_000 * 2000
