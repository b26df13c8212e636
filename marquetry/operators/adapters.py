"""Low-rank adapters: their product is added to a model's weights once, so that scoring knows nothing of them."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, functions as F


def read_adapter(folder: str) -> tuple[dict[str, np.ndarray], float]:
    """Matrices (adapter.npz: ``<layer>.lora_A`` and ``<layer>.lora_B``) and their scale, alpha / r of adapter_config.json."""
    path = Path(folder)
    try:
        config = json.loads((path / "adapter_config.json").read_text())["config"]
        rank, alpha = config["r"], config["alpha"]
    except (KeyError, TypeError) as e:
        raise ValueError(f"the adapter's configuration in {folder} must have config with r and alpha") from e
    if not rank:
        raise ValueError(f"the adapter's rank in {folder} is 0")
    with np.load(path / "adapter.npz") as stored:
        return dict(stored), alpha / rank


def merge(weights: dict[str, np.ndarray], adapter: dict[str, np.ndarray], scale: float) -> dict[str, np.ndarray]:
    """Weights with scale B A added to each layer's; further entries of the adapter, such as a head, replace or join the weights."""
    out = dict(weights)
    for name, matrix in adapter.items():
        layer, _, part = name.rpartition(".")
        if part not in ("lora_A", "lora_B"):
            out[name] = matrix
            continue
        other = adapter.get(f"{layer}.{'lora_B' if part == 'lora_A' else 'lora_A'}")
        if other is None:
            raise ValueError(f"the adapter has only one of the two matrices of {layer}")
        if f"{layer}.weight" not in weights:
            raise ValueError(f"the model has no layer {layer}")
        if part == "lora_A":
            base = weights[f"{layer}.weight"]
            out[f"{layer}.weight"] = (base + scale * (other.astype(np.float64) @ matrix)).astype(base.dtype)
    return out


def merge_tables(weights: DataFrame, a: DataFrame, b: DataFrame, scale: float) -> DataFrame:
    """(layer, row, col, value): the same for weights that are stored by element: a (layer, k, col, value), b (layer, row, k, value).

    The matrices meet on their short side; products are added up before they are shuffled.
    """
    left, right = b.select("layer", "row", "k", F.col("value").alias("y")), a.select("layer", "k", "col", F.col("value").alias("x"))
    added = left.join(right, ["layer", "k"]).select("layer", "row", "col", (F.col("y") * F.col("x") * scale).alias("value"))
    both = weights.select("layer", "row", "col", "value").unionByName(added)
    return both.groupBy("layer", "row", "col").agg(F.sum("value").alias("value"))
