"""Segmentation of streams.  It is a projection of single rows, so that it needs neither state nor watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators.score import Scorer
from ..operators.segment import each_of, rule_segments, segment


def read_texts(spark: SparkSession, path: str, schema: StructType | str, per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder, or of those that a pattern names."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(path)


def segment_stream(stream: DataFrame, scorer: Scorer | None = None, text: str = "text", **options) -> DataFrame:
    """(…, seg_idx, segment): a row for each segment; by the rule scorer in the JVM if no scorer and no option is given."""
    found = segment(stream, scorer, text, out="__s", **options) if scorer or options else stream.withColumn("__s", rule_segments(F.col(text)))
    return each_of(found, "__s", stream.columns, "segment", "seg_idx")


def write_segments(segments: DataFrame, path: str, checkpoint: str):
    """Writes all that is there now, exactly once across restarts, and returns the query when it has ended."""
    query = segments.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
