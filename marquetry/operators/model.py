"""Token classifiers as exported models: subwords with special tokens, or hashed characters, in padded batches of windows.

A model's folder has ``model.onnx`` (or ``model_optimized.onnx``) and ``config.json``; models of subwords also ``tokenizer.json``; styles, if any, are in
``mixtures.json``.  The model is loaded once in each worker.
"""

from __future__ import annotations

import json
import shutil
import struct
import tempfile
from functools import cache
from pathlib import Path

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import SparkSession

from ..functions.text import PRIMES
from .chunk import effective_block, hat, windows
from .score import _session, points, sigmoid

#: Subwords of a window, beside the two special tokens.
MOST_SUBWORDS = 510
_SHIPPED = "shipped:"


def ship(spark: SparkSession, folder: str) -> str:
    """Sends a model's folder to all workers, and returns the name under which they find it.

    A folder of this machine goes as an archive, which is unpacked where it arrives: Spark sends no local folders on a cluster.
    """
    path = Path(folder.removeprefix("file://"))
    if path.is_dir():
        archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="ship-")) / path.name), "zip", path)
        spark.sparkContext.addArchive(f"{archive}#{path.name}")
    else:
        spark.sparkContext.addFile(folder, recursive=True)
    return _SHIPPED + path.name


def _here(folder: str) -> Path:
    return Path(SparkFiles.get(folder.removeprefix(_SHIPPED)) if folder.startswith(_SHIPPED) else folder)


@cache
def _config(folder: str) -> dict:
    return json.loads((_here(folder) / "config.json").read_text())


@cache
def _tokenizer(folder: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(str(_here(folder) / "tokenizer.json"))


def mixtures(folder: str) -> dict:
    """Styles of a model: language -> style -> (classifier, features, punctuation's threshold, newline's threshold)."""
    path = _here(folder) / "mixtures.json"
    stored = json.loads(path.read_text()) if path.exists() else {}
    return {lang: {style: tuple(x) for style, x in own.items()} for lang, own in stored.items()}


class ModelScorer:
    """Scores by the model of a folder.

    config.json: ``kind`` (subword or hashed), ``block``; for subwords ``cls`` and ``sep``; for hashed characters ``hashes`` and ``buckets``; ``pad``
    (0), ``downsampling`` (1), ``label`` (0), and ``languages``, the order of language adapters, if the model has some: texts then need a language.
    weighting: how overlapping windows are averaged, uniform or hat.
    """

    def __init__(self, folder: str, batch_size: int = 32, stride: int = 256, weighting: str = "uniform", pad_last_batch: bool = False, providers: tuple[str, ...] = ("CPUExecutionProvider",)):
        self.folder, self.batch_size, self.stride, self.weighting, self.pad_last_batch, self.providers = folder, batch_size, stride, weighting, pad_last_batch, providers

    def _units(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray] | None]:
        """Ids of each text's units, and where subwords end."""
        config = _config(self.folder)
        if config["kind"] == "subword":
            found = _tokenizer(self.folder).encode_batch(texts, add_special_tokens=False)
            return [np.array(x.ids, np.int64) for x in found], [np.array([b for _, b in x.offsets], np.int64) for x in found]
        primes = np.array(PRIMES[: config["hashes"]], np.int64)
        return [(points(t).astype(np.int64)[:, None] + 1) * primes % config["buckets"] for t in texts], None

    def _run(self, units: list[np.ndarray], langs: list[str | None] | None, block: int) -> list[np.ndarray]:
        """Logits of units that fit into a block each, in batches."""
        config = _config(self.folder)
        subword, adapters = config["kind"] == "subword", config.get("languages")
        if adapters and (langs is None or any(x is None for x in langs)):
            raise ValueError("a model with language adapters needs a language for each text")
        name = next(n for n in ("model.onnx", "model_optimized.onnx") if (_here(self.folder) / n).exists())
        session = _session(str(_here(self.folder) / name), self.providers)
        kinds = {x.name: np.float32 if "float" in x.type else np.int64 for x in session.get_inputs()}
        extra = 2 if subword else 0
        out: list[np.ndarray] = []
        for k in range(0, len(units), self.batch_size):
            part = units[k : k + self.batch_size]
            n = self.batch_size if self.pad_last_batch else len(part)
            ids = np.full((n, block + extra, *part[0].shape[1:]), config.get("pad", 0) if subword else 0, np.int64)
            mask = np.zeros((n, block + extra), kinds["attention_mask"])
            for row, own, m in zip(ids, part, mask, strict=False):
                own = np.concatenate([[config["cls"]], own, [config["sep"]]]) if subword else own
                row[: len(own)] = own
                m[: len(own)] = 1
            inputs = {"input_ids" if subword else "hashed_ids": ids, "attention_mask": mask}
            if adapters:
                inputs["language_ids"] = np.array([adapters.index(x) for x in langs[k : k + self.batch_size]] + [0] * (n - len(part)), np.int64)
            logits = session.run(None, inputs)[0][:, :, config.get("label", 0)]
            out += [x[extra // 2 : extra // 2 + len(own)] for x, own in zip(logits, part, strict=False)]
        return out

    def logits(self, texts: list[str], langs: list[str | None] | None = None) -> tuple[list[np.ndarray], list[np.ndarray] | None]:
        """Logits of each text's units, averaged over windows, and where subwords end."""
        config = _config(self.folder)
        units, ends = self._units(texts)
        longest = max(map(len, units), default=0)
        if longest == 0:
            return [np.zeros(0) for _ in units], ends
        block = effective_block(longest, config["block"], MOST_SUBWORDS if config["kind"] == "subword" else None, config.get("downsampling", 1))
        spans = [(i, a, b) for i, x in enumerate(units) if len(x) for a, b in windows(len(x), block, min(self.stride, block))]
        found = self._run([units[i][a:b] for i, a, b in spans], [langs[i] for i, _, _ in spans] if langs else None, block)
        weights = hat(block) if self.weighting == "hat" else np.ones(block)
        total, weight = [np.zeros(len(x)) for x in units], [np.zeros(len(x)) for x in units]
        for (i, a, b), x in zip(spans, found, strict=True):
            total[i][a:b] += weights[: b - a] * x
            weight[i][a:b] += weights[: b - a]
        return [t / np.maximum(w, 1e-300) for t, w in zip(total, weight, strict=True)], ends

    def first_block(self, texts: list[str], langs: list[str | None] | None = None) -> list[np.ndarray]:
        """Logits of the units of each text's first block: short texts in one pass, without windows; what is longer is cut off."""
        config = _config(self.folder)
        block = effective_block(config["block"], config["block"], MOST_SUBWORDS if config["kind"] == "subword" else None, config.get("downsampling", 1))
        return self._run([x[:block] for x in self._units(texts)[0]], langs, block)

    def scores(self, texts: list[str], langs: list[str | None] | None = None) -> list[np.ndarray]:
        found, ends = self.logits(texts, langs)
        if ends is None:
            return [sigmoid(x) for x in found]
        out = []
        for text, x, end in zip(texts, found, ends, strict=True):
            p = np.zeros(len(text), np.float32)
            p[end[end > 0] - 1] = sigmoid(x)[end > 0]  # a subword's probability belongs to its last character
            out.append(p)
        return out


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, data: bytes | str) -> bytes:
    data = data.encode() if isinstance(data, str) else data
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _node(kind: str, inputs: list[str], output: str, *attributes: bytes) -> bytes:
    return _bytes(1, b"".join(_bytes(1, x) for x in inputs) + _bytes(2, output) + _bytes(4, kind) + b"".join(_bytes(5, a) for a in attributes))


def _tensor(name: str, values: list, kind: int, dims: list[int]) -> bytes:
    raw = struct.pack(f"<{len(values)}{'f' if kind == 1 else 'q'}", *values)
    return _bytes(5, b"".join(_number(1, d) for d in dims) + _number(2, kind) + _bytes(8, name) + _bytes(9, raw))


def _value(field: int, name: str, kind: int, axes: str) -> bytes:
    shape = b"".join(_bytes(1, _bytes(2, a)) for a in axes)
    return _bytes(field, _bytes(1, name) + _bytes(2, _bytes(1, _number(1, kind) + _bytes(2, shape))))


def write_lookup_model(folder: str, config: dict, table: list[float], languages: dict[str, float] | None = None, tokenizer=None, styles: dict | None = None) -> None:
    """Writes a model whose logit of a unit is the sum of the table's values for its ids, and of its language's value: ONNX and all that goes with it."""
    subword = config["kind"] == "subword"
    ids = "input_ids" if subword else "hashed_ids"
    graph = _node("Gather", ["table", ids], "found")
    last = "found"
    if not subword:
        graph += _node("ReduceSum", ["found", "last"], "sum", _bytes(1, "keepdims") + _number(3, 0) + _number(20, 2)) + _tensor("last", [2], 7, [1])
        last = "sum"
    if languages:
        graph += _node("Gather", ["offsets", "language_ids"], "offset") + _node("Unsqueeze", ["offset", "one"], "column") + _node("Add", [last, "column"], "moved")
        graph += _tensor("offsets", list(languages.values()), 1, [len(languages)]) + _tensor("one", [1], 7, [1]) + _value(11, "language_ids", 7, "b")
        last, config = "moved", config | {"languages": list(languages)}
    graph += _node("Unsqueeze", [last, "axis"], "logits") + _bytes(2, "lookup") + _tensor("table", table, 1, [len(table)]) + _tensor("axis", [2], 7, [1])
    graph += _value(11, ids, 7, "bn" if subword else "bnh") + _value(11, "attention_mask", 1, "bn") + _value(12, "logits", 1, "bno")
    path = Path(folder)
    path.mkdir(parents=True, exist_ok=True)
    (path / "model.onnx").write_bytes(_number(1, 8) + _bytes(7, graph) + _bytes(8, _bytes(1, "") + _number(2, 13)))
    (path / "config.json").write_text(json.dumps(config))
    if tokenizer is not None:
        tokenizer.save(str(path / "tokenizer.json"))
    if styles:
        (path / "mixtures.json").write_text(json.dumps(styles))


def word_tokenizer(words: list[str]):
    """A tokenizer of words and of runs of marks, with ids for the given ones after <unk>, <s>, </s> and <pad>."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    names = ["<unk>", "<s>", "</s>", "<pad>", *words]
    found = Tokenizer(models.WordLevel({w: i for i, w in enumerate(names)}, unk_token="<unk>"))
    found.pre_tokenizer = pre_tokenizers.Whitespace()
    return found


def mark_tokens(tokenizer, marks: list[str], unknown: str = "<unk>") -> list[tuple[str, int, int, bool]]:
    """(mark, label, token id, whether the tokenizer knows it): labels of auxiliary marks, and 1 for the line break."""
    none = tokenizer.token_to_id(unknown)
    rows = []
    for label, mark in enumerate(["\n", *marks], 1):
        own = tokenizer.token_to_id(mark)
        rows.append((mark, label, none if own is None else own, own is not None and own != none))
    return rows
