"""Segmentation, scoring, chunking and alignment of texts."""
