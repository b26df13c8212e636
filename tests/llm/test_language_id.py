import numpy as np
import pyarrow as pa

from marquetry.llm import language_id as L


def test_scores_are_the_kernel_expansion():
    texts = ["the cat sat on the mat", "the dog and the house", "le chat est sur la table", "la maison et le chien", "der hund und das haus", "die katze ist im haus"]
    langs = ["en", "en", "fr", "fr", "de", "de"]
    m = L.fit(texts, langs, landmarks=6, ridge=1e-2)
    p = [set(np.flatnonzero(L.presence(*L._flat.utf8(pa.array([t])))[0])) for t in texts]
    k = np.array([[len(a & b) / (len(a) * len(b)) ** 0.5 for b in p] for a in p])
    order = sorted(range(6), key=lambda i: (i % 2, sorted(set(langs)).index(langs[i])))
    km = k[np.ix_(order, order)]
    w, v = np.linalg.eigh(km)
    root = v @ np.diag(1 / np.sqrt(w)) @ v.T
    phi = k[:, order] @ root
    y = np.where(np.array(langs)[:, None] == np.array(sorted(set(langs))), 1.0, -1.0)
    beta = np.linalg.solve(phi.T @ phi / 2 + 1e-2 * np.eye(6), phi.T @ y / 2)
    assert np.allclose(m.scores(pa.array(texts)), phi @ beta, atol=1e-3)


def test_presence_counts_distinct_ngrams():
    p = L.presence(*L._flat.utf8(pa.array(["ab ab", "", "!!", "ab"])))
    assert p[0, :256].sum() == 3 and p[1].sum() == 0 and p[2].sum() == 1
    assert p[3].sum() == 2 + 1 and p.max() == 1


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    train, rest = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1 and n_chars > 40")
    got = L.identify(rest, L.train(train)).withColumnRenamed("lang", "found").join(rest.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["found"] == r["lang"] for r in got]) >= 0.98
    assert np.mean([r["kept"] for r in got]) >= 0.98


def test_odd_rows(spark, odd, empty, sf_dir):
    model = L.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = L.identify(odd, model).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows if r["doc_id"]}
    assert not any(by[k]["kept"] or by[k]["lang"] for k in (3, 4, 5, 8))
    assert by[1]["kept"] and by[1]["lang"] == "en" and by[6]["kept"]
    kept = L.accepted(odd, model)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} >= {1, 2, 6, None}
    assert L.identify(empty).collect() == [] and L.accepted(empty).collect() == []
    only = L.identify(odd.where("doc_id = 1")).collect()
    assert [(r["lang"], r["kept"]) for r in only] == [(None, True)] * 2


def test_a_script_never_seen_is_rejected(spark, sf_dir):
    model = L.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    df = spark.createDataFrame([(1, "今天天气很好我们去公园散步然后回家吃饭")], "doc_id long, text string")
    assert not L.identify(df, model).first()["kept"]


def test_every_language_has_landmarks():
    rng = np.random.default_rng(2)
    texts, langs = [], []
    for k in range(170):  # a language of syllables of its own
        syllables = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 3)) for _ in range(12)]
        texts += [" ".join(rng.choice(syllables, 40)) for _ in range(10)]
        langs += [f"l{k:03}"] * 10
    m = L.fit(texts[::2], langs[::2])
    found = [m.languages[i] for i in m.scores(pa.array(texts[1::2])).argmax(axis=1)]
    assert np.mean([a == b for a, b in zip(found, langs[1::2])]) > 0.98


def test_training_texts_stay_on_workers(spark):
    rows = [(i, ("the cat sat on the mat " if i % 2 else "le chat est sur la table ") * 20_000, "en" if i % 2 else "fr") for i in range(6)]
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["en", "fr"]
    assert model.scores(pa.array(["the cat", "le chat"])).argmax(axis=1).tolist() == [0, 1]
