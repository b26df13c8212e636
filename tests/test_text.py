from pyspark.sql import functions as F

from marquetry.functions import text as T
from marquetry.resources import LANGUAGES, PUNCTUATION, SENTENCE_LENGTHS, language_table, length_table, punctuation_table


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first()["x"]


def test_scalars(spark):
    t = F.col("t")
    assert one(spark, "‏--　A  b  ﬁ ", T.preprocess(t)) == "A b fi"
    assert one(spark, " -a", T.preprocess(t)) == "-a"
    assert one(spark, "Hi, You!", T.corrupt(t)) == "hi you"
    assert one(spark, "Hi, You!\nA.", T.corrupt_asr(t)) == ["hi you", "a"]
    assert one(spark, "so #tag @me http://x.y good :-) day 😀🎉", T.clean_tweet(t)) == "so good day"
    assert one(spark, "end… ", T.ends_with_punctuation(t)) and one(spark, "5 €", T.ends_with_punctuation(t)) and not one(spark, "end", T.ends_with_punctuation(t))
    assert one(spark, "a b", T.whitespace_ratio(t)) == 0.5
    assert one(spark, "a\n \nb", T.paragraphs(t)) == ["a", "b"]
    assert one(spark, "@a@ b\n\n c ", T.clean_answer(t, delimiter="|")) == "a b|c"
    assert one(spark, "@@@", T.is_refusal(t)) and not one(spark, "@a", T.is_refusal(t))
    assert one(spark, "a😀", T.code_points(t)) == [97, 0x1F600]
    assert one(spark, "a", T.hash_codes(t, 2)) == [[98 * 31 % 8192, 98 * 43 % 8192]]
    assert one(spark, "a.\n", T.next_labels(t)) == [2 + PUNCTUATION.index("."), 1, 0]
    assert one(spark, "abcdefg", T.equal_split_chars(t, F.lit(3))) == ["ab", "cd", "efg"]
    assert one(spark, "a b c", T.equal_split_words(t, F.lit(2))) == ["a", "b c"]
    assert one(spark, None, T.preprocess(t)) is None


def test_social_noise_depends_on_key_only(spark):
    df = spark.createDataFrame([(i, "Hello, World! How, are. You?") for i in range(200)], "k long, t string")
    a = {r["k"]: r["x"] for r in df.select("k", T.corrupt_social_media(F.col("t"), F.col("k")).alias("x")).collect()}
    b = {r["k"]: r["x"] for r in df.repartition(7).select("k", T.corrupt_social_media(F.col("t"), F.col("k")).alias("x")).collect()}
    assert a == b
    low = sum(x == x.lower() for x in a.values())
    bare = sum(not set(x) & set(",.!?") for x in a.values())
    assert 60 < low < 140 and 60 < bare < 150


def test_tables(spark):
    assert len(LANGUAGES) == language_table(spark).count() == 85 and len(SENTENCE_LENGTHS) == length_table(spark).count() == 142
    assert len(PUNCTUATION) == len(set(PUNCTUATION)) == punctuation_table(spark).count()
    row = {r["lang"]: r for r in language_table(spark).collect()}
    assert row["zh"]["separator"] == "" and row["de"]["separator"] == " " and row["th"]["no_punctuation"]
    assert not row["am"]["ud"] and row["de"]["ersatz"] and not row["am"]["ersatz"] and not row["la"]["opus100"]
