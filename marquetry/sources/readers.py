"""Readers for the formats in which sentence corpora come; each gives a DataFrame with a stated order column.

Text files are read in splits, so that their size doesn't matter; what goes on across lines (documents, sentences, places) is a running
total over the lines.  With folders=True the files of a folder are one, in the order of their names, as Spark writes large files; ``file`` is then the
folder.  Only nested JSON is read a file at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..plans.running import running_total


def texts(spark: SparkSession, values: list[str | None]) -> DataFrame:
    """(doc_id, text) of texts in memory."""
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")


def _raw(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, split, line): lines with the split that they are in, and its hash, which is what goes to Python."""
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.rtrim("value", F.lit("\r")).alias("line"))
    return raw.withColumn("split", F.xxhash64("file", "block"))


def _file(folders: bool) -> Column:
    return F.regexp_replace("file", "/[^/]*$", "") if folders else F.col("file")


def _carried(lines: DataFrame, raw: DataFrame, value: Column, folders: bool) -> DataFrame:
    """Adds file, block and before: the total of value over all splits that come before a row's.  A row for each split goes to all executors."""
    sizes = raw.groupBy("split", "file", "block").agg(F.sum(value).alias("n"))
    before = F.sum("n").over(Window.partitionBy(_file(folders)).orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))
    return lines.join(F.broadcast(sizes.select("split", "file", "block", F.coalesce(before, F.lit(0)).alias("before"))), "split")


def numbered_lines(spark: SparkSession, path: str, folders: bool = False) -> DataFrame:
    """(file, line_no, line) of text files, gzip too.

    Lines are counted within each split of a file as they stream by, and the lines of the splits before it are added.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for b in batches:
            if b.num_rows == 0:
                continue
            splits = b.column(0).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(splits[1:] != splits[:-1]) + 1])
            place = np.arange(b.num_rows) - np.repeat(starts, np.diff(np.append(starts, b.num_rows)))
            if splits[0] == last:
                place[: starts[1] if len(starts) > 1 else b.num_rows] += count
            last, count = splits[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(place), b.column(1)], ["split", "place", "line"])

    raw = _raw(spark, path)
    lines = raw.select("split", "line").mapInArrow(number, "split long, place long, line string")
    return _carried(lines, raw, F.lit(1), folders).select(_file(folders).alias("file"), (F.col("place") + F.col("before")).alias("line_no"), "line")


def sentence_lines(spark: SparkSession, path: str, limit: int | None = None, folders: bool = False) -> DataFrame:
    """(file, sent_idx, sentence): a sentence a line, blank ones left out; limit keeps a file's first lines."""
    rows = numbered_lines(spark, path, folders).where(~T.is_blank(F.col("line")))
    rows = rows.where(F.col("line_no") < limit) if limit is not None else rows
    return rows.select("file", F.col("line_no").alias("sent_idx"), T.strip(F.col("line")).alias("sentence"))


def conllu(spark: SparkSession, path: str, documents: bool = False, folders: bool = False) -> DataFrame:
    """(file, doc_id, sent_idx, sentence) from the ``# text =`` lines of CoNLL-U files; documents begin at ``# newdoc``."""
    lines = numbered_lines(spark, path, folders).where(F.col("line").rlike("^# (?:text = |newdoc)"))
    if documents:
        lines = running_total(lines, ["file"], ["line_no"], F.col("line").startswith("# newdoc").cast("long"), "doc_id")
    else:
        lines = lines.withColumn("doc_id", F.lit(0).cast("long"))
    return lines.where(F.col("line").startswith("# text = ")).select("file", "doc_id", F.col("line_no").alias("sent_idx"), F.substring("line", 10, 2**31 - 1).alias("sentence"))


def parallel(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs whose sides differ when stripped."""
    return rows.where(T.strip(F.col(left)) != T.strip(F.col(right)))


def jsonl_spans(spark: SparkSession, path: str, folders: bool = False) -> DataFrame:
    """(file, doc_id, sent_idx, sentence) of JSON lines with text and spans of code points; doc_id is the line's number."""
    raw = numbered_lines(spark, path, folders).select("file", F.col("line_no").alias("doc_id"), F.from_json("line", "text string, spans array<struct<start:int,end:int>>").alias("r"))
    rows = raw.select("file", "doc_id", "r.text", F.posexplode("r.spans").alias("sent_idx", "s"))
    sentence = F.substring(F.col("text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    return rows.select("file", "doc_id", "sent_idx", sentence.alias("sentence"))


def boundary_words(spark: SparkSession, path: str, folders: bool = False) -> DataFrame:
    """(file, sent_idx, sentence) of lines ``word<TAB>boundary``; words after the last boundary are dropped.

    Words are joined within each split as they stream by; only sentences are shuffled, of which one can go on in the next batch or split.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ended, pieces = None, 0, 0  # of the split that the last batch ended in: its boundaries and pieces so far
        for b in batches:
            n = b.num_rows
            if n == 0:
                continue
            splits, ends = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            new = np.append(splits[1:] != splits[:-1], True)  # whether a split ends with a row, or the batch does
            stop = np.flatnonzero(new | (ends == 1))
            low = np.concatenate([[0], stop[:-1] + 1])
            split = np.concatenate([[0], np.cumsum(new[stop[:-1]])])
            first = np.flatnonzero(np.concatenate([[True], split[1:] != split[:-1]]))  # a split's first piece in the batch
            before = np.concatenate([[0], np.cumsum(ends[stop])])[:-1]
            k, piece = before - before[first][split], np.arange(len(stop)) - first[split]
            if splits[0] == last:
                k, piece = k + ended * (split == 0), piece + pieces * (split == 0)
            last, ended, pieces = splits[-1], int(k[-1] + ends[stop[-1]]), int(piece[-1]) + 1
            words = pa.ListArray.from_arrays(pa.array(np.append(low, n), pa.int32()), b.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(splits[low]), pa.array(k, pa.int64()), pa.array(piece, pa.int64()), pc.binary_join(words, " "), pa.array(ends[stop], pa.int64())], ["split", "k", "piece", "text", "done"])

    parts = F.split("line", "\t")
    rows = _raw(spark, path).where(F.size(parts) >= 2).select("file", "block", "split", parts[0].alias("word"), (parts[1] == "1").cast("long").alias("ends"))
    found = _carried(rows.select("split", "word", "ends").mapInArrow(join, "split long, k long, piece long, text string, done long"), rows, F.col("ends"), folders)
    found = found.select(_file(folders).alias("whole"), (F.col("k") + F.col("before")).alias("sent_idx"), "done", F.struct("file", "block", "piece", "text").alias("p"))
    groups = found.groupBy("whole", "sent_idx").agg(F.max("done").alias("done"), F.array_sort(F.collect_list("p")).alias("p"))
    return groups.where("done = 1").select(F.col("whole").alias("file"), "sent_idx", F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("sentence"))


MARKS = {"COMMA": ",", "PERIOD": ".", "QUESTION": "?"}


def punctuated_tokens(spark: SparkSession, path: str, separator: str = " ", folders: bool = False) -> DataFrame:
    """(file, line_no, token, label, start, end): tokens with their places in the text that they make; a label belongs to the last character."""
    parts = F.split("line", "\t")
    rows = numbered_lines(spark, path, folders).where(F.size(parts) >= 2).select("file", "line_no", parts[0].alias("token"), parts[1].alias("label"))
    rows = running_total(rows, ["file"], ["line_no"], F.length("token") + len(separator), "end").withColumn("end", F.col("end") - len(separator))
    return rows.withColumn("start", F.col("end") - F.length("token"))


def paired_files(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Lines of two folders joined by file name and line: (file, line_no, gold, predicted)."""
    name = F.element_at(F.split("file", "/"), -1)
    left = gold.select(name.alias("file"), "line_no", F.col("line").alias("gold"))
    return left.join(predicted.select(name.alias("file"), "line_no", F.col("line").alias("predicted")), ["file", "line_no"])


def language_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True)


def lengths_json(spark: SparkSession, path: str) -> DataFrame:
    """(lang, target_length, spread) of a JSON file {"stats": {lang: {target_length, spread}}}."""
    raw = spark.read.schema("stats map<string, struct<target_length:int,spread:int>>").json(path, multiLine=True)
    return raw.select(F.explode("stats").alias("lang", "s")).select("lang", "s.target_length", "s.spread")


def boundary_indices(spark: SparkSession, path: str) -> DataFrame:
    """(lang, dataset, system, doc_id, predicted, true, length) of JSON {lang: {dataset: {system: [{...}, ...]}}}."""
    leaf = "array<struct<predicted_indices:array<int>,true_indices:array<int>,length:int>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,map<string,map<string,{leaf}>>>").alias("m"))
    rows = raw.select(F.explode("m").alias("lang", "d")).select("lang", F.explode("d").alias("dataset", "s")).select("lang", "dataset", F.explode("s").alias("system", "x"))
    return rows.select("lang", "dataset", "system", F.posexplode("x").alias("doc_id", "r")).select("lang", "dataset", "system", "doc_id", F.col("r.predicted_indices").alias("predicted"), F.col("r.true_indices").alias("true"), F.col("r.length").alias("length"))


def mixtures(spark: SparkSession, path: str) -> DataFrame:
    """(lang, style, coefficients, intercept, punctuation, newline): stored style classifiers and thresholds."""
    return spark.read.schema("lang string, style string, coefficients array<double>, intercept double, punctuation double, newline double").json(path)


def corpus(spark: SparkSession, path: str, langs: list[str] | None = None) -> DataFrame:
    """A stored corpus (lang, dataset, split, doc_id, sent_idx, sentence); languages prune partitions."""
    rows = spark.read.parquet(path)
    return rows.where(F.col("lang").isin(*langs)) if langs else rows
