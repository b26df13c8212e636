"""Relational plans over corpora: evaluation, sampling, packing, statistics."""
