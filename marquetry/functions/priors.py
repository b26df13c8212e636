"""Length priors, as Spark columns and as tables of weights for dynamic programming."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..resources import DEFAULT_LENGTH, SENTENCE_LENGTHS, length_table

NAMES = ("uniform", "gaussian", "clipped_polynomial", "lognormal")


def check_prior(name: str) -> None:
    if name not in NAMES:
        raise ValueError(f"Unknown prior_type: {name}; there are {', '.join(NAMES)}")


def length_defaults(lang: str | None, target_length: float | None = None, spread: float | None = None) -> tuple[float, float]:
    """Target and spread: given ones win, then the language's, then the defaults."""
    if lang is not None and lang not in SENTENCE_LENGTHS and (target_length is None or spread is None):
        warnings.warn(f"no sentence lengths are known for language {lang!r}; defaults are used", stacklevel=2)
    known = SENTENCE_LENGTHS.get(lang, DEFAULT_LENGTH)
    return known[0] if target_length is None else target_length, known[1] if spread is None else spread


def prior(name: str, length: Column, target: Column | float, spread: Column | float, max_length: int | None = None) -> Column:
    """Weight of a segment's length; 0 above max_length."""
    check_prior(name)
    target, spread = (x if isinstance(x, Column) else F.lit(float(x)) for x in (target, spread))
    n = length.cast("double")
    if name == "uniform":
        weight = F.lit(1.0)
    elif name == "gaussian":
        z = (n - target) / spread
        weight = F.exp(F.lit(-0.5) * z * z)
    elif name == "clipped_polynomial":
        d = n - target
        weight = F.greatest(F.lit(1.0) - d * d / (spread * spread), F.lit(0.0))
    else:
        sigma = spread / target
        z = (F.log(n) - (F.log(target) + sigma * sigma)) / sigma
        weight = F.when(n > 0, F.exp(F.lit(-0.5) * z * z) / n).otherwise(F.lit(0.0))
    return weight if max_length is None else F.when(n > max_length, F.lit(0.0)).otherwise(weight)


def weights(name: str, longest: int, max_length: int | None = None, lang: str | None = None, target_length: float | None = None, spread: float | None = None) -> np.ndarray:
    """Weights of the lengths 0 to longest."""
    check_prior(name)
    target, width = length_defaults(lang, target_length, spread)
    n = np.arange(longest + 1, dtype=np.float64)
    with np.errstate(all="ignore"):
        if name == "uniform":
            w = np.ones(len(n))
        elif name == "gaussian":
            w = np.exp(-0.5 * ((n - target) / width) ** 2)
        elif name == "clipped_polynomial":
            w = np.maximum(1 - (n - target) ** 2 / width**2, 0.0)
        else:
            sigma = width / target
            w = np.exp(-0.5 * ((np.log(n) - (np.log(target) + sigma**2)) / sigma) ** 2) / n
            w[0] = 0.0
    if max_length is not None:
        w[n > max_length] = 0.0
    return w


def with_length_defaults(df: DataFrame, target_length: float | None = None, spread: float | None = None) -> DataFrame:
    """Adds target_length and spread by language.  The table of lengths has one row a language and is broadcast."""
    known = length_table(df.sparkSession).select(F.col("lang").alias("__l"), F.col("target_length").alias("__t"), F.col("spread").alias("__s"))
    df = df.join(F.broadcast(known), F.col("lang") == F.col("__l"), "left")
    pick = lambda own, column, default: F.lit(own) if own is not None else F.coalesce(F.col(column), F.lit(default))
    return df.withColumn("target_length", pick(target_length, "__t", DEFAULT_LENGTH[0])).withColumn("spread", pick(spread, "__s", DEFAULT_LENGTH[1])).drop("__l", "__t", "__s")
