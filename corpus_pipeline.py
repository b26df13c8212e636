"""From raw documents to a training mixture: language ID, near-dedup, decontamination, PII redaction, mixing.

Each stage reads what the one before has written.  Rows whose language is rejected, all but one of each group of near
copies, and rows that hold a benchmark item go; personal data is replaced by its kind; then sources are mixed to their
weights up to the token budget.  All stages but the last return the columns of documents; the last adds tokens, virtual
finish time and running total.  A stage's input is deleted when its output is written.

Cases: rows with a null, empty or blank text, or one without letters, go in the first stage.  Rows with a null ``doc_id`` are
never near copies, and are filtered, redacted and mixed like others.  Of rows that are equal, or share an id and are near copies, one
stays; rows that share an id with different texts are judged each for itself.  Ties are settled as the stages' operators say.  Texts are read
whole, however long.  A null lang or source is carried along (a null source is a source of its own).  Further columns, whatever their
names, stay as they are, but for columns with the names of the three that the last stage adds, which are replaced.  Empty documents, or an
empty benchmark, are no error; without documents there are no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marquetry.llm import decontaminate, language_id, mixing, near_dedup, pii
from marquetry.llm._spark import discard, table, written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

#: Classifiers, SimHash search and check digits aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents."""
    docs, read = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        if read is not None:
            discard(read)
        read = docs
    return STAGES[-1][1](spark, docs, sf_dir)
