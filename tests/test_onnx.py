"""The ONNX scorer with a model that is written here byte by byte: logit 1 for a full stop, else 0."""

import struct

import numpy as np
import pytest

from marquetry.operators.score import OnnxScorer
from marquetry.operators.segment import segment

pytest.importorskip("onnxruntime")


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def number(field, n):
    return varint(field << 3) + varint(n)


def block(field, data):
    data = data.encode() if isinstance(data, str) else data
    return varint(field << 3 | 2) + varint(len(data)) + data


def node(kind, inputs, outputs, *attributes):
    return block(1, b"".join(block(1, x) for x in inputs) + b"".join(block(2, x) for x in outputs) + block(4, kind) + b"".join(block(5, a) for a in attributes))


def tensor(name, values, dims):
    return block(5, b"".join(number(1, d) for d in dims) + number(2, 7) + block(8, name) + block(9, struct.pack(f"<{len(values)}q", *values)))


def value(field, name, kind, axes):
    shape = b"".join(block(1, block(2, a)) for a in axes)
    return block(field, block(1, name) + block(2, block(1, number(1, kind) + block(2, shape))))


def model():
    graph = node("Equal", ["input_ids", "stop"], ["same"]) + node("Cast", ["same"], ["one"], block(1, "to") + number(3, 1) + number(20, 2)) + node("Unsqueeze", ["one", "axis"], ["logits"])
    graph += block(2, "g") + tensor("stop", [46], []) + tensor("axis", [2], [1])
    graph += value(11, "input_ids", 7, "bn") + value(11, "attention_mask", 7, "bn") + value(12, "logits", 1, "bno")
    return number(1, 8) + block(7, graph) + block(8, block(1, "") + number(2, 13))


def test_scores(spark, tmp_path):
    path = tmp_path / "m.onnx"
    path.write_bytes(model())
    scorer = OnnxScorer(str(path), block=8, stride=4)
    text = "One here. Two there. And three"
    (p,) = scorer.scores([text])
    want = np.where(np.array(list(text)) == ".", 1 / (1 + np.exp(-1)), 0.5)
    assert np.allclose(p, want, atol=1e-6)
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "k long, text string")
    got = [r["segments"] for r in segment(df, scorer, threshold=0.6).orderBy("k").collect()]
    assert got == [["One here. ", "Two there. ", "And three"], [], None]


def test_windows_batches_and_adapters(tmp_path):
    from marquetry.operators import model as M
    from marquetry.operators.chunk import windows

    table = [((k * 29) % 17 - 8) / 8 for k in range(64)]
    M.write_lookup_model(str(tmp_path / "h"), {"kind": "hashed", "hashes": 2, "buckets": 64, "block": 12, "downsampling": 4}, table, {"en": 1.0, "de": -1.0}, styles={"en": {"ud": [[[2.0], 1.0], None, 0.5, 0.4]}})
    texts = ["a short text", "x", "", "a much longer text that needs several windows, as it is long"]
    with pytest.raises(ValueError, match="language"):
        M.ModelScorer(str(tmp_path / "h")).scores(texts)
    for options in ({}, {"batch_size": 1}, {"batch_size": 3, "pad_last_batch": True}, {"weighting": "hat", "stride": 5}):
        got = M.ModelScorer(str(tmp_path / "h"), **{"stride": 5} | options).scores(texts, ["en", "de", "de", "de"])
        for text, lang, p in zip(texts, ("en", "de", "de", "de"), got):
            want = [sum(table[(ord(c) + 1) * q % 64] for q in (31, 43)) + (1 if lang == "en" else -1) for c in text]
            assert np.allclose(p, 1 / (1 + np.exp(-np.array(want))), atol=1e-5)
    assert [len(x) for x in M.ModelScorer(str(tmp_path / "h")).first_block(texts, ["en"] * 4)] == [12, 1, 0, 12]
    assert len(windows(60, 12, 5)) > 8
    assert M.mixtures(str(tmp_path / "h"))["en"]["ud"][0] == [[2.0], 1.0] and M.mixtures(str(tmp_path)) == {}


def test_subwords(tmp_path):
    from marquetry.operators import model as M

    tokenizer = M.word_tokenizer([".", "good"])
    # special tokens have great logits, which mustn't show
    M.write_lookup_model(str(tmp_path), {"kind": "subword", "cls": 1, "sep": 2, "pad": 3, "block": 4}, [-2.0, 50.0, 50.0, 50.0, 1.0, 0.5], tokenizer=tokenizer)
    text = "All is good . It is, in all good."
    (p, empty) = M.ModelScorer(str(tmp_path), stride=2).scores([text, "  "])
    want = np.zeros(len(text))
    for end, logit in ((3, -2), (6, -2), (11, 0.5), (13, 1), (16, -2), (19, -2), (20, -2), (23, -2), (27, -2), (32, 0.5), (33, 1)):
        want[end - 1] = 1 / (1 + np.exp(-logit))
    assert np.allclose(p, want, atol=1e-6) and not empty.any()
    assert M.mark_tokens(tokenizer, [".", "!"]) == [("\n", 1, 0, False), (".", 2, 4, True), ("!", 3, 0, False)]
