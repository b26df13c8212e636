import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls everywhere, empty, blank and very long texts, repeated rows, and columns with names that operators use."""
    long_text = "The river runs past the old mill and the people of the town walk there in the evening. " * 4000
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank.", "en", "a"),
        (1, "The quick brown fox jumps over the lazy dog near the river bank.", "en", "a"),
        (2, "Le petit chat est assis sur la table et regarde par la fenêtre ouverte.", "fr", None),
        (3, None, "en", "b"),
        (4, "", None, "b"),
        (5, " \n\t ", "en", None),
        (None, "Der alte Mann geht mit seinem Hund durch den dunklen Wald nach Hause.", None, None),
        (6, long_text, "en", "a"),
        (7, "x" * 300_000, "en", "a"),
        (8, "?!… 12 🙂", "en", "b"),
        (None, None, None, None),
    ]
    df = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], SCHEMA)
    for name in ("score", "kept", "margin", "key", "finish", "total", "tokens", "id", "fp", "block", "rank", "start", "end", "row", "quality", "mix_total", "chars", "hash", "word", "m", "root", "a", "b", "h", "n", "kept_id", "kept_h", "own_id", "own_h", "gone_id", "gone_h", "own_hash", "mixed_id", "mixed_hash", "mixed_places", "group", "part", "amount", "queued", "weight", "places", "result", "__id", "__r", "__n", "__text", "__quality", "__words", "__lines", "__hash", "__row", "__places", "__doc_id", "__gone", "__part", "__place"):
        df = df.withColumn(name, F.lit("clash"))
    return df.withColumn("m2", F.create_map(F.lit("k"), F.lit(1)))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
