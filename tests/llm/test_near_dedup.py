import re

import numpy as np
import pytest

from marquetry.llm import near_dedup as N

WORDS = [f"{a}{b}" for a in "bcdfghjklm" for b in ("a", "ero", "int", "olus", "ut")]


def text(rng, n):
    return " ".join(rng.choice(WORDS, n))


def changed(rng, t, share):
    w = t.split()
    for i in np.flatnonzero(rng.random(len(w)) < share):
        w[i] = "changed" + str(i)
    return " ".join(w)


def test_copies_go_and_others_stay(spark):
    rng = np.random.default_rng(1)
    rows, group = [], {}
    for g in range(60):
        base = text(rng, int(rng.integers(80, 300)))
        for c in range(int(rng.integers(1, 6))):
            group[len(rows)] = g
            rows.append((len(rows), base if c == 0 else changed(rng, base, 0.03)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {r["doc_id"]: r["duplicate_of"] for r in N.duplicates(df).collect()}
    assert all(group[a] == group[b] and b < a for a, b in gone.items())
    want = len(rows) - 60
    assert len(gone) >= 0.95 * want
    left = N.drop_duplicates(df).collect()
    assert {r["doc_id"] for r in left} == {i for i, _ in rows} - set(gone)


def test_recall_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fps = {r["doc_id"]: np.frombuffer(r["fp"], np.uint64) for r in N.with_fingerprints(docs).collect()}
    ids = sorted(fps)
    m = np.stack([fps[i] for i in ids])
    near = [(ids[i], ids[j]) for i in range(len(ids)) for j in np.flatnonzero(np.bitwise_count(m[i] ^ m[i + 1 :]).sum(axis=1) <= N.RADIUS) + i + 1]
    gone = {r["doc_id"]: r["duplicate_of"] for r in N.duplicates(docs).collect()}
    root = lambda x: gone.get(x, x)
    assert near and np.mean([root(a) == root(b) for a, b in near]) >= 0.9


def test_large_lists_are_searched_whole():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 2**63, (300, 4)).astype(np.uint64)
    fps[200:280] = fps[7]
    fps[201, 0] ^= np.uint64(5)
    a, b = N.near_edges(fps, np.arange(300), np.array([0, 300]), 10)
    reached = {7}
    while more := ({int(y) for x, y in zip(a, b) if x in reached} | {int(x) for x, y in zip(a, b) if y in reached}) - reached:
        reached |= more
    assert reached == {7, *range(200, 280)}


def pairs_at_the_radius(rng, n):
    """2 n random fingerprints (bytes), of which n follow each other at RADIUS bits from the first n."""
    bits = rng.integers(0, 2, (n, N.BITS)).astype(np.uint8)
    flips = np.zeros((n, N.BITS), np.uint8)
    for k in range(n):
        flips[k, rng.permutation(N.BITS)[: N.RADIUS]] = 1
    return np.packbits(bits, axis=1), np.packbits(bits ^ flips, axis=1)


@pytest.mark.parametrize("nodes, strips", [(1000, 1), (N.LIST_SIZE << 11, 1), (N.LIST_SIZE << 12, 2), (N.LIST_SIZE << 14, 4), (N.LIST_SIZE << 15, 2), (N.LIST_SIZE << 17, 4)])
def test_recall_at_the_radius(nodes, strips):
    a, b = pairs_at_the_radius(np.random.default_rng(strips), 400)
    checks, repetitions = N.plan(nodes)
    assert len(checks) == strips and nodes / 2 ** sum(2**c - 1 - c for c in checks) <= N.LIST_SIZE
    found = np.zeros(400, bool)
    for r in range(repetitions):
        found |= N.filter_keys(a, checks, r) == N.filter_keys(b, checks, r)
    assert found.mean() >= 0.94


def test_plan_has_room_for_keys():
    checks, repetitions = N.plan(10**15)
    assert sum(2**c - 1 - c for c in checks) + repetitions.bit_length() < 63


@pytest.mark.parametrize("large", [3, 40, 1000])
def test_large_lists_are_searched_in_blocks(spark, large):
    rng = np.random.default_rng(6)
    near = np.repeat(rng.integers(0, 2, (30, N.BITS)).astype(np.uint8), 6, axis=0)
    for row in near:
        row[rng.permutation(N.BITS)[:25]] ^= 1
    bits = np.concatenate([near, rng.integers(0, 2, (20, N.BITS)).astype(np.uint8)])
    fps = np.packbits(bits, axis=1)
    distance = np.bitwise_count(fps[:, None] ^ fps).sum(axis=2, dtype=int)
    nodes = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(fps)], "id long, fp binary")
    lists = nodes.selectExpr("cast(id % 2 as long) as key", "id", "fp").union(nodes.selectExpr("7L", "id", "fp"))
    found = N.written(N._searched(lists, 58, large))
    hot = found.where("key is not null").select("key", "id", "fp")
    assert (hot.count() > 0) == (large < 1000)
    edges = found.where("key is null").select("id", "other").union(N._searched(N._in_blocks(hot, large), 58, None).select("id", "other"))
    roots = {r["id"]: r["root"] for r in N.components(edges.selectExpr("id as a", "other as b").distinct()).collect()}
    want = list(range(len(fps)))
    for i in range(len(fps)):
        for j in np.flatnonzero(distance[i] <= 58):
            old, new = max(want[i], want[j]), min(want[i], want[j])
            want = [new if w == old else w for w in want]
    assert [roots.get(i, i) for i in range(len(fps))] == want


def test_fingerprints_follow_words():
    import pyarrow as pa

    a, b, c, d, e = N.fingerprints(pa.array(["one two three", "one  two,\nthree!", "", None, "..."]))
    assert a == b and c is None and d is None and e is None


def test_odd_rows(odd, empty):
    # two rows of document 1 are equal
    assert [tuple(r) for r in N.duplicates(odd).collect()] == [(1, 1)]
    left = N.drop_duplicates(odd)
    assert left.columns == odd.columns and left.count() == odd.count() - 1 and left.where("doc_id = 1").count() == 1
    assert left.where("doc_id is null").count() == 2
    assert N.duplicates(empty).collect() == [] and N.drop_duplicates(empty).collect() == []


def test_equal_texts(spark):
    df = spark.createDataFrame([(i, "a few equal words here") for i in (9, 4, 7, 4)], "doc_id long, text string")
    assert {(r["doc_id"], r["duplicate_of"]) for r in N.duplicates(df).collect()} == {(4, 4), (7, 4), (9, 4)}
    assert [r["doc_id"] for r in N.drop_duplicates(df).collect()] == [4]


def test_an_id_with_several_texts(spark):
    one, two, three = (" ".join(f"{x}{i}" for i in range(40)) for x in ("apple", "pear", "plum"))
    rows = [(1, one, "a"), (1, two, "b"), (2, one, "c"), (1, one, "d"), (3, three, "e"), (3, three, "e"), (3, three, "e"), (4, one + " more", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, own_id string")
    left = [(r["doc_id"], r["text"]) for r in N.drop_duplicates(df).collect()]
    assert sorted(left) == sorted([(1, one), (1, two), (3, three)])
    assert {(r["doc_id"], r["duplicate_of"]) for r in N.duplicates(df).collect()} == {(1, 1), (2, 1), (3, 3), (4, 1)}


def test_words_match_a_regular_expression():
    import pyarrow as pa

    from marquetry.llm import _flat

    texts = ["Ab, cd-é 12", "", " x", "y"]
    hashes, first = _flat.words(*_flat.utf8(pa.array(texts)))
    assert np.diff(first).tolist() == [len(re.findall(r"\w+", t)) for t in texts]
    assert len(set(hashes.tolist())) == 6


def test_characters_of_scripts_without_spaces_are_words():
    import pyarrow as pa

    from marquetry.llm import _flat

    def n(*texts):
        return np.diff(_flat.words(*_flat.utf8(pa.array(texts)))[1]).tolist()

    assert n("今天天气", "ab今c", "ไทย", "နေ", "𠀀𠀁", "한국 말", "日", "naïve 今", "日本") == [4, 3, 3, 2, 2, 2, 1, 2, 2]
    a, b = (_flat.words(*_flat.utf8(pa.array([t])))[0].tolist() for t in ("今 天", "今天"))
    assert a == b
