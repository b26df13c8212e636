import hashlib
import re

import numpy as np

from marquetry.llm import mixing as M


def brute(rows, weights, default, share, seed):
    by = {}
    for i, t, s in rows:
        by.setdefault(s, []).append((hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), i, len(re.findall(r"[^ \t\r\n]+", t or ""))))
    out = []
    for s, docs in by.items():
        total, w = 0, weights.get(s, default)
        if w <= 0:
            continue
        for key, i, n in sorted(docs, key=lambda d: (d[0], d[1] is not None, d[1] or 0, d[2])):
            total += n
            out.append((total / w, key, s or "", i, n, s))
    out.sort(key=lambda r: (r[0], r[1], r[2], -1 if r[3] is None else r[3], r[4]))
    budget, run, kept = int(sum(r[4] for r in out) * share), 0, []
    for f, _, _, i, n, s in out:
        run += n
        if run <= budget:
            kept.append((i, s, n, f, run))
    return kept


def test_against_a_loop(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), "w " * int(rng.integers(0, 30)), str(rng.choice(["a", "b", "c", "d"], p=[0.7, 0.1, 0.1, 0.1]))) for i in rng.permutation(400)]
    rows += rows[:5] + [(None, "x y", None), (900, None, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {"a": 1.0, "b": 3.0, "d": 0.0}
    got = M.mix(df, weights, 2.0, 0.5, "s").collect()
    want = brute(rows, weights, 2.0, 0.5, "s")
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_shares_follow_weights(spark):
    rows = [(i, "w " * 10, "ab"[i % 2]) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    tokens = {r["source"]: r["t"] for r in M.mix(df, {"a": 3.0, "b": 1.0}, budget_share=0.4).groupBy("source").agg({"tokens": "sum"}).withColumnRenamed("sum(tokens)", "t").collect()}
    assert abs(tokens["a"] / tokens["b"] - 3) < 0.1


def test_documents_carry_their_places(spark, odd, empty):
    out = M.mixed_documents(odd, budget_share=1.0)
    assert set(out.columns) == set(odd.columns) | {"mix_tokens", "mix_finish", "mix_total"}
    rows = out.collect()
    assert len(rows) == odd.count()
    places = sorted((r["mix_total"], r["mix_tokens"]) for r in rows)
    assert places[-1][0] == sum(t for _, t in places)
    assert sorted(r["mix_total"] for r in rows) == sorted(r["total"] for r in M.mix(odd, budget_share=1.0).collect())
    assert M.mix(empty).collect() == [] and M.mixed_documents(empty).collect() == []
    assert M.mix(odd, budget_share=0.0).where("tokens > 0").collect() == []


def test_against_sql(spark, sf_dir):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = sorted(c.sql(M.OP8_SQL).fetchall())
    assert sorted(tuple(r) for r in M.op8_mixing(spark, sf_dir).select("doc_id", "source", "tokens", "finish", "total").collect()) == want
