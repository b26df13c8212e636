import os
import random
import time

import pytest

from marquetry.llm import token_counts as C

pytestmark = pytest.mark.skipif(not os.path.exists(C.VOCABULARY), reason="no vocabulary here")


def test_against_direct_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    encode = C.encoder(C.VOCABULARY).encode_ordinary
    lengths = sorted(len(encode(r["text"])) for r in docs.collect())
    hist = C.histogram(docs).persist()
    rows = C.summary(hist).collect()
    assert sum(r["docs"] for r in rows) == len(lengths) and sum(r["tokens"] for r in rows) == sum(lengths)
    for r in rows:
        n = r["length"]
        assert r["docs_at_least"] == sum(x >= n for x in lengths)
        assert r["tokens_at_least"] == sum(x for x in lengths if x >= n)
        assert r["truncated_total"] == sum(min(x, n) for x in lengths)
        assert abs(r["share_up_to"] - sum(x <= n for x in lengths) / len(lengths)) < 1e-8
    got = {r["context"]: (r["total"], r["truncated_docs"]) for r in C.truncated_totals(hist, [0, 7, 512, 10**6]).collect()}
    assert got == {c: (sum(min(x, c) for x in lengths), sum(x > c for x in lengths)) for c in (0, 7, 512, 10**6)}
    q = {r["share"]: r["length"] for r in C.quantiles(hist, [0.25, 0.5, 1.0]).collect()}
    for share, n in q.items():
        assert sum(x <= n for x in lengths) >= share * len(lengths) - 1e-6 > sum(x < n for x in lengths) - 1e-3


def test_odd_rows(spark, odd, empty):
    rows = {r["length"]: r["docs"] for r in C.histogram(odd).collect()}
    assert sum(rows.values()) == odd.where("text is not null").count() and rows[0] == 1
    assert C.summary(C.histogram(empty)).collect() == []
    assert [tuple(r) for r in C.truncated_totals(C.histogram(empty), [5]).collect()] == [(5, 0, 0)]
    assert [tuple(r) for r in C.quantiles(C.histogram(empty), [0.5]).collect()] == [(0.5, None)]


def test_long_runs_change_nothing():
    encoding, rng = C.encoder(C.VOCABULARY), random.Random(1)
    parts = ["a", " b", "  ", "x" * 3, "\n", ".", " " * 1500, "\t" * 1200 + " ", "\n" * 1100, "1", "\x1c" * 1300, "\u3000" * 1050, " " * C.LONG_RUN]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(12))
        assert C.length(encoding, text) == len(encoding.encode_ordinary(text))


@pytest.mark.parametrize("text", [" " * 10_000_000, "a" + "\n" * 5_000_000 + "b", "x" * 3_000_000, "." * 3_000_000, "ab " * 1_000_000])
def test_very_long_texts(text):
    began = time.process_time()
    assert C.length(C.encoder(C.VOCABULARY), text) > 0
    assert time.process_time() - began < 30


def test_quantiles_compare_whole_numbers(spark):
    hist = spark.createDataFrame([(1, 10**10 - 1), (2, 1), (3, 10**10)], "length long, docs long")
    assert {r["share"]: r["length"] for r in C.quantiles(hist, [0.5, 0.5 - 1e-9, 1.0, 0.0]).collect()} == {0.5: 2, 0.5 - 1e-9: 1, 1.0: 3, 0.0: 1}
