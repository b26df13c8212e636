import json

import numpy as np
import pytest

from marquetry.operators.adapters import merge, merge_tables, read_adapter


def test_merged_weights(tmp_path, spark):
    rng = np.random.default_rng(0)
    weights = {"layer.0.weight": rng.normal(size=(5, 3)).astype(np.float32), "layer.1.weight": np.ones((2, 2), np.float32), "head": np.zeros(2)}
    a, b = rng.normal(size=(2, 3)), rng.normal(size=(5, 2))
    np.savez(tmp_path / "adapter.npz", **{"layer.0.lora_A": a, "layer.0.lora_B": b, "head": np.ones(2)})
    (tmp_path / "adapter_config.json").write_text(json.dumps({"config": {"r": 2, "alpha": 3}}))
    adapter, scale = read_adapter(str(tmp_path))
    assert scale == 1.5
    got = merge(weights, adapter, scale)
    want = weights["layer.0.weight"] + 1.5 * b @ a
    assert np.allclose(got["layer.0.weight"], want, atol=1e-6) and got["layer.0.weight"].dtype == np.float32
    assert got["layer.1.weight"] is weights["layer.1.weight"] and got["head"].tolist() == [1, 1] and weights["head"].tolist() == [0, 0]
    cells = lambda m, r, c: spark.createDataFrame([("x", i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])], f"layer string, {r} int, {c} int, value double")
    table = merge_tables(cells(weights["layer.0.weight"], "row", "col"), cells(a, "k", "col"), cells(b, "row", "k"), 1.5).collect()
    assert len(table) == 15 and all(abs(r["value"] - want[r["row"], r["col"]]) < 1e-5 for r in table)


def test_adapters_that_do_not_fit(tmp_path):
    with pytest.raises(ValueError, match="only one"):
        merge({"l.weight": np.ones((1, 1))}, {"l.lora_A": np.ones((1, 1))}, 1.0)
    with pytest.raises(ValueError, match="no layer"):
        merge({}, {"l.lora_A": np.ones((1, 1)), "l.lora_B": np.ones((1, 1))}, 1.0)
    for config in ({}, {"config": 3}, {"config": {"r": 0, "alpha": 1}}, {"config": {"r": 1}}):
        (tmp_path / "adapter_config.json").write_text(json.dumps(config))
        with pytest.raises(ValueError):
            read_adapter(str(tmp_path))
