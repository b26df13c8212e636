import numpy as np
import pyarrow as pa

from marquetry.llm import secrets as S


def test_held_out_accuracy():
    model = S.train()
    held = S.samples(200, seed=77)
    hit = {k for k, *_ in model.scan(pa.array([t for t, _ in held]))}
    random = [i for i, (_, label) in enumerate(held) if label != S.ORDINARY]
    plain = [i for i, (_, label) in enumerate(held) if label == S.ORDINARY]
    assert sum(i in hit for i in random) >= 0.98 * len(random)
    assert sum(i in hit for i in plain) <= 0.01 * len(plain)


def test_against_a_loop_over_characters():
    import math

    model = S.train()
    text = "naïve key=9f86d081884c7d659a2feaa0c55ad015a3bf4f1b and getUserAccountByName, donaudampfschifffahrtsgesellschaft"
    found = model.scan(pa.array([None, text, "", text]))
    assert [(k, text[a:b]) for k, a, b, *_ in found] == [(k, "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b") for k in (1, 3)]
    s = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    best = max(sum(r[S._INDEX[ord(p)] if p else len(S._ALPHABET), S._INDEX[ord(c)]] for p, c in zip([None, *s], s)) for r in model.ratios)
    assert math.isclose(found[0][4], best, abs_tol=1e-3)


def test_secrets_joined_to_names():
    model = S.train()
    random = [t for t, label in S.samples(150, seed=78) if label != S.ORDINARY and len(t) <= 24]
    for name in ("DATABASE_PASSWORD=", "client_secret=", "aws_secret_access_key=", "/services/hooks/webhook/incoming/"):
        texts = [name + t for t in random]
        hit = {k for k, a, b, *_ in model.scan(pa.array(texts)) if b == len(texts[k]) and abs(a - len(name)) <= 4}
        assert len(hit) >= 0.95 * len(random), name
    a, b = "9f86d081884c7d65", "Zk3vQ9xT1bW7pLr5"
    text = f"é /services/hooks/webhook/incoming/{a}/configuration/environment/password_directory/{b}/settings/default"
    assert [text[x:y] for _, x, y, *_ in model.scan(pa.array([text]))] == [a, b]
    assert model.scan(pa.array(["/services/hooks/webhook/incoming/settings_default-value=document", "-" * 300_000 + "x", "word-" * 50_000])) == []


def test_stretches_against_all_pairs():
    import itertools

    model, rng = S.train(), np.random.default_rng(9)
    hits = 0
    for _ in range(60):
        pieces = ["".join(rng.choice(list("abcdef0123456789"), rng.integers(3, 14))) if rng.random() < 0.4 else str(rng.choice(["password", "index", "get", "", "server"])) for _ in range(7)]
        text = "".join(p + str(rng.choice(list("+/_-="))) for p in pieces)
        run = np.frombuffer(text.encode(), np.uint8)
        starts = [i for i in range(len(text)) if i == 0 or text[i - 1] in "+/_-="]
        ends = [i for i in range(1, len(text) + 1) if i == len(text) or text[i] in "+/_-="]
        all_pairs = [(x, y) for x, y in itertools.product(starts, ends) if y - x >= S.MIN_LENGTH]
        scores = [model.score(run, np.array([x]), np.array([y - x]))[0][0] for x, y in all_pairs]
        want = max((r - S.MIN_PER_CHAR * (y - x) for (x, y), r in zip(all_pairs, scores) if r >= max(S.MIN_RATIO, S.MIN_PER_CHAR * (y - x))), default=None)
        got = model.stretch(run, S.MIN_LENGTH, S.MIN_RATIO, S.MIN_PER_CHAR)
        assert (got is None) == (want is None)
        if got:
            assert abs(got[2] - S.MIN_PER_CHAR * (got[1] - got[0]) - want) < 1e-6
            hits += 1
    assert 5 < hits


def test_runs_end_with_texts():
    half = "9f86d081884c7d"
    assert S.train().scan(pa.array([half, half])) == []


def test_planted_tokens(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"] for r in S.scan(docs).collect()}
    planted = {r["doc_id"] for r in docs.where("text rlike 'token = \"[0-9a-f]{40}'").collect()}
    assert planted <= rows and len(rows - planted) <= 0.02 * docs.count()


def test_odd_rows(odd, empty):
    assert {r["doc_id"] for r in S.scan(odd).collect()} <= {7}
    assert S.scan(empty).collect() == []
