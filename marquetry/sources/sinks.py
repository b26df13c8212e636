"""Writers: corpora by language, metrics, labelled words, and results that are added to without doing work twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..folders import discard, written


def write_corpus(rows: DataFrame, path: str, by: tuple[str, ...] = ("lang",), mode: str = "overwrite") -> None:
    rows.write.mode(mode).partitionBy(*by).parquet(path)


def write_json(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).json(path)


def write_csv(rows: DataFrame, path: str, header: bool = True, separator: str = ",", mode: str = "overwrite") -> None:
    rows.write.mode(mode).csv(path, header=header, sep=separator)


def write_labelled_words(rows: DataFrame, path: str, word: str = "word", label: str = "label", file: str | None = None, order: list[str] | None = None) -> None:
    """Lines ``word<TAB>label`` in order, a folder for each file: its files, in the order of their names, are what write_lines() makes."""
    out = rows.select(*([file] if file else []), *(order or []), F.concat_ws("\t", F.col(word), F.col(label).cast("string")).alias("value"))
    if file:
        write_lines(out, path, file, order or [])
    else:
        out.orderBy(*(order or [])).select("value").write.mode("overwrite").text(path)


def write_lines(rows: DataFrame, path: str, by: str, order: list[str], **options) -> None:
    """Text files of the column value, a folder for each value of by, with lines in the given order; a list is as many lines.

    A folder has as many files as tasks wrote to it, in the order of their names, so that no task has to hold a folder.  Rows are written
    first, as the range partitioner reads them twice.
    """
    listed = rows.schema["value"].dataType.typeName() == "array"
    stored = written(rows.select(by, *order, "value"))
    ranged = stored.repartitionByRange(by, *order).sortWithinPartitions(by, *order)
    ranged.select(by, F.explode("value").alias("value") if listed else "value").write.mode("overwrite").partitionBy(by).text(path, **options)
    discard(stored)


def append_missing(rows: DataFrame, path: str, key: list[str]) -> int:
    """Adds rows whose key isn't stored yet, and returns how many there were."""
    spark = rows.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        rows = rows.join(spark.read.parquet(path).select(*key).distinct(), key, "left_anti")
    rows = rows.persist()
    try:
        n = rows.count()
        if n:
            rows.write.mode("append").parquet(path)
        return n
    finally:
        rows.unpersist()
