import numpy as np

from marquetry.llm import top_k as T


def brute(ids, v, k, every=1):
    u = [[int(x) for x in row] for row in T.quantised(v)]
    assert np.abs(np.array(u) / T.UNIT - v / np.linalg.norm(v, axis=1)[:, None]).max() <= 0.5 / T.UNIT
    s = np.array([[(sum(x * y for x, y in zip(a, b)) * 2_000_000 + T.UNIT**2) // (2 * T.UNIT**2) for b in u] for a in u])
    out = set()
    for i in range(len(ids)):
        if ids[i] % every:
            continue
        best = sorted((-s[i, j], ids[j]) for j in range(len(ids)) if j != i)[:k]
        out |= {(ids[i], r + 1, n, -x) for r, (x, n) in enumerate(best)}
    return out


def rows(df, every=1, **kw):
    return {(r["vec_id"], r["rank"], r["neighbor_id"], r["score"]) for r in T.top_k(df, every=every, **kw).collect()}


def test_against_brute_force_with_ties(spark):
    rng = np.random.default_rng(0)
    v = rng.integers(-2, 3, (90, 3)).astype(float)
    v[~v.any(axis=1)] = 1
    v[40:70] = v[3]  # many equal vectors
    ids = rng.permutation(1000)[:90].tolist()
    df = spark.createDataFrame(list(zip(ids, v.tolist())), "vec_id long, embedding array<double>")
    assert rows(df, k=5, block=16) == brute(ids, v, 5)
    assert rows(df, every=7, k=5, block=16) == brute(ids, v, 5, 7)


def test_k_above_the_number_of_rows(spark):
    v = np.array([[1.0, 0], [0, 1], [1, 1]])
    df = spark.createDataFrame(list(zip([3, 1, 2], v.tolist())), "vec_id long, embedding array<double>")
    assert rows(df, k=10, block=2) == brute([3, 1, 2], v, 10)


def test_odd_rows(spark):
    nan = float("nan")
    data = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, None), (None, [1.0, 2.0]), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [1.0]), (7, []), (8, [None, 1.0]), (9, [0.5, 0.5])]
    df = spark.createDataFrame([(*d, "x", 1) for d in data], "vec_id long, embedding array<float>, id string, block int")
    got = rows(df, k=3, block=2)
    assert {r[0] for r in got} == {1, 2, 9} and {r[2] for r in got} == {1, 2, 9}  # 6 has no other vector of its length
    assert (2, 1, 9, 1_000_000) in got
    assert T.top_k(df.where("vec_id > 100")).collect() == []
    assert T.top_k(df.where("vec_id = 2"), every=1).collect() == []


def test_lengths_are_searched_apart(spark):
    rng = np.random.default_rng(3)
    want, data = set(), []
    for n, first in ((4, 0), (3, 100), (700, 200)):
        v = rng.normal(size=(25, n)) * (1e200 if n == 3 else 1)
        ids = list(range(first, first + 25))
        data += list(zip(ids, v.tolist()))
        want |= brute(ids, v / (1e200 if n == 3 else 1), 4, 5)
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    assert rows(df, every=5, k=4, block=10) == want


def test_against_sql(spark, sf_dir):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    want = sorted(c.sql(T.OP2_SQL).fetchall())
    assert sorted(tuple(r) for r in T.op2_exact_top_k(spark, sf_dir).collect()) == want and want
