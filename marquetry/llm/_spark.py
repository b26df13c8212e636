"""Small helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..folders import discard, fresh, written

__all__ = ["discard", "fresh", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
