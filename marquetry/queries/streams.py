"""Segmentation of a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..folders import shared_folder
from ..streaming.segments import read_texts, segment_stream, write_segments
from .common import query, sql_segments, table


@query(f"WITH {sql_segments()} SELECT doc_id, seg_idx, segment FROM segs")
def stream_segments(spark, sf_dir):
    """All documents as a stream of files, cut, written exactly once, and read again."""
    folder = shared_folder(spark)
    stream = read_texts(spark, f"{sf_dir}/documents.parque[t]", table(spark, sf_dir, "documents").schema).select("doc_id", "text")
    write_segments(segment_stream(stream).drop("text"), f"{folder}/out", f"{folder}/state")
    out = spark.read.parquet(f"{folder}/out")
    return out.withColumn("seg_idx", F.col("seg_idx").cast("long"))
