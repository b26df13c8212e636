import numpy as np
import pytest

import corpus_pipeline as C
from marquetry.llm import pii


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, sf_dir):
    """Real documents with a few planted ones and odd rows."""
    out = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first()["text"]
    base = docs.where("n_chars between 900 and 1500 and lang = 'en'").orderBy("doc_id").collect()
    clean = base[0]["text"]
    rows = [
        (100_001, base[1]["text"] + " One more.", "en", "src1", None),
        (100_002, clean[:400] + " " + item + " " + clean[400:], "en", "src1", None),
        (100_003, "Completely separate words about gardens, boats and trains; mail me at some.one@mail.example.com if you like " + clean[::-1].lower(), "en", "src2", None),
        (100_004, "今天天气很好我们去公园散步然后回家吃饭", "en", "src2", None),
        (100_005, None, None, None, None),
        (100_006, "", "en", None, 0),
        (None, "Some words of a document without an id that nothing else has said before at all.", "en", "src1", None),
    ]
    extra = spark.createDataFrame(rows, docs.schema)
    docs.unionByName(extra).write.parquet(f"{out}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{out}/benchmark.parquet")
    return out, base[1]["doc_id"]


def test_stages(spark, folder):
    out, twin = folder
    docs = spark.read.parquet(f"{out}/documents.parquet")
    ids = {}
    for k, (name, stage) in enumerate(C.STAGES):
        before = docs
        docs = C.written(stage(spark, before, out))
        ids[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if k < len(C.STAGES) - 1:
            assert docs.columns == before.columns
    assert not ids["language_id"] & {100_004, 100_005, 100_006}
    assert {100_001, 100_002, 100_003, None} <= ids["language_id"]
    assert len(ids["near_dedup"] & {100_001, twin}) == 1 and 100_003 in ids["near_dedup"]
    assert 100_002 not in ids["decontamination"] and {100_003, None} <= ids["decontamination"]
    assert ids["pii"] == ids["decontamination"]
    assert ids["mixing"] < ids["pii"]
    assert all(pii.spans(r["text"]) == [] for r in docs.select("text").collect())


def brute_kept(rows, items):
    """Ids of planted rows (id, text) that the first three stages keep, by definition: letters there, no earlier copy, no item."""
    import re

    kept, seen = set(), []
    pairs = lambda t: set(zip(w := re.findall(r"\w+", t.lower()), w[1:]))
    for i, t in rows:
        own = pairs(t or "")
        if not re.search(r"[A-Za-z]", t or "") or any(len(own & o) / (len(own) * len(o)) ** 0.5 > 0.9 for o in seen if own and o):
            continue
        seen.append(own)
        if not any(len(own & pairs(x)) >= 0.9 * len(pairs(x)) for x in items):
            kept.add(i)
    return kept


def test_run_against_brute_force(spark, tmp_path, sf_dir):
    """A small table of rows whose fate is plain, with repeats, an id with two texts, a long text and clashing columns."""
    rng = np.random.default_rng(1)
    words = [f"{a}{b}{c}" for a in "bcdfghklmnprst" for b in ("a", "er", "in", "olu") for c in ("k", "sta", "m", "t", "rn", "ve", "l", "d", "nge", "ss")]
    make = lambda n: " ".join(rng.choice(words, n))
    items = [make(25) for _ in range(3)]
    texts = [make(120) for _ in range(12)]
    rows = list(enumerate(texts)) + [(20, texts[3]), (21, texts[4] + " extra"), (22, make(60) + " " + items[1] + " " + make(60)), (23, "12 34 !"), (24, None), (25, ""), (26, make(6_000))]
    want = brute_kept(rows, items)
    assert want == {*range(12), 26}
    rows += [rows[0], rows[0], (5, make(130))]
    names = ["gone_id", "own_h", "kept", "h", "n", "mixed_hash", "own_hash", "__row", "__hash", "mix_total", "group", "part", "tokens", "r"]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t or ""), *["x"] * len(names)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = C.run(spark, str(tmp_path)).collect()
    left = docs
    for _, stage in C.STAGES[:-1]:
        left = C.written(stage(spark, left, str(tmp_path)))
        assert left.columns == docs.columns
    ids = sorted(r["doc_id"] for r in left.collect())
    assert ids == sorted([*want, 5])
    # the last stage's running totals, by a loop over all that is left
    by = {}
    for r in left.collect():
        by.setdefault(r["source"], []).append(r)
    import hashlib

    key = lambda r: hashlib.md5(f"{C.mixing.SEED}:{r['doc_id']}".encode()).hexdigest()
    n = lambda r: len((r["text"] or "").split())
    total, mixed = 0, []
    for r in sorted(by["src0"], key=lambda r: (key(r), r["doc_id"], n(r))):
        total += n(r)
        mixed.append((r["doc_id"], total))
    budget = int(total * C.mixing.BUDGET_SHARE)
    assert sorted((r["doc_id"], int(r["mix_total"])) for r in got) == sorted(x for x in mixed if x[1] <= budget)
    assert all(r["gone_id"] == "x" and r["tokens"] == "x" for r in got)


def test_mixing_budget(spark, folder):
    out, _ = folder
    rows = C.run(spark, out).collect()
    totals = np.array(sorted((r["mix_total"], r["mix_tokens"]) for r in rows))
    assert (np.cumsum(totals[:, 1])[-1] == totals[-1, 0]) and len(rows)


def test_empty_documents(spark, tmp_path, sf_dir):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert C.run(spark, str(tmp_path)).collect() == []
