"""Scalar functions on text, as Spark columns."""
