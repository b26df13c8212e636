"""Token counts by an exact length histogram.

Each text is encoded with a public byte-level BPE vocabulary, and documents are aggregated by encoded length: per task first, then
over all.  The histogram has as many rows as there are lengths, however many documents there are.  Prefix and suffix sums over it
answer, for every context limit, how many documents and tokens there are, how many reach the limit, and how many
tokens are left if texts are truncated to it; quantiles are the first length whose share of documents is large enough.

Cases: a null text has no length and isn't counted; an empty one has length 0.  Texts are encoded whole; around runs of more than
``LONG_RUN`` blanks they are cut where the encoding cuts them anyway, as its expression can't match such runs.  Repeated rows each
count.  Only ``text`` is read.  An empty table gives an empty histogram, total 0 for every limit, and null quantiles.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator
from decimal import Decimal
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ._spark import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: A run of white space that is longer than this is encoded apart from what is around it.
LONG_RUN = 1000
_LONG = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % (LONG_RUN + 1))


@cache
def encoder(vocabulary: str):
    """The encoding of a rank file, which is loaded once per worker."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def length(encoding, text: str) -> int:
    """Number of tokens."""
    if len(text) <= LONG_RUN or not (run := _LONG.search(text)):
        return len(encoding.encode_ordinary(text))
    total, at = 0, 0
    while run:
        # all of a run but its last character is one piece, and so is a run at the end; the last one belongs to what follows
        end = run.end() if run.end() == len(text) else run.end() - 1
        total += len(encoding.encode_ordinary(text[at : run.start()])) + len(encoding._encode_single_piece(text[run.start() : end]))
        at = end
        run = _LONG.search(text, at)
    return total + len(encoding.encode_ordinary(text[at:]))


def histogram(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(length, docs): how many texts have each encoded length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(vocabulary)
        counts: Counter[int] = Counter()
        for b in batches:
            counts.update(length(encoding, t) for t in map(pa.StringScalar.as_py, b.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())], ["length", "docs"])

    partial = docs.where("text is not null").select(F.col("text").cast("string")).mapInArrow(run, "length long, docs long")
    return partial.groupBy("length").agg(F.sum("docs").alias("docs"))


def _sums(hist: DataFrame) -> DataFrame:
    """Adds tokens, documents and tokens up to each length (d, t), and all of them (dd, tt).  The windows run over lengths, not documents."""
    up = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    h = hist.withColumn("tokens", F.col("length") * F.col("docs"))
    return h.select("*", F.sum("docs").over(up).alias("d"), F.sum("tokens").over(up).alias("t"), F.sum("docs").over(every).alias("dd"), F.sum("tokens").over(every).alias("tt"))


def summary(hist: DataFrame) -> DataFrame:
    """Adds to each length: tokens of its documents, documents and tokens at least as long, the total if all texts are
    truncated to this length, and the share of documents that are no longer, rounded."""
    longer = F.col("dd") - F.col("d")
    return _sums(hist).select(
        "length", "docs", "tokens", (longer + F.col("docs")).alias("docs_at_least"), (F.col("tt") - F.col("t") + F.col("tokens")).alias("tokens_at_least"),
        (F.col("t") + F.col("length") * longer).alias("truncated_total"), F.round(F.col("d") / F.col("dd"), 9).alias("share_up_to"),
    )


def truncated_totals(hist: DataFrame, limits: list[int]) -> DataFrame:
    """(context, total, truncated_docs): tokens left and documents cut for any context limits, whether a text has that length or not."""
    spark = hist.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context long")
    cut = F.least("length", "context") * F.col("docs")
    got = asked.join(hist, F.lit(True), "left").groupBy("context").agg(F.coalesce(F.sum(cut), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("length") > F.col("context"), F.col("docs"))), F.lit(0)).alias("truncated_docs"))
    return got


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the least length that at least this share of documents doesn't exceed; whole numbers are compared, with shares of up to 9 decimals."""
    asked = hist.sparkSession.createDataFrame([(float(x), round(Decimal(str(x)) * 10**9)) for x in shares], "share double, billionths long")
    enough = F.col("d").cast("decimal(28,0)") * F.lit(10**9) >= F.col("dd").cast("decimal(28,0)") * F.col("billionths")
    return asked.join(_sums(hist), enough, "left").groupBy("share").agg(F.min("length").alias("length"))


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    return summary(histogram(table(spark, sf_dir, "documents")))
