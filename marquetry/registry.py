"""All queries of the engine by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .queries import chunks, corpora, evaluation, files, lengths, models, segmentation, streams, texts  # noqa: F401  (they register their queries)
from .queries.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
