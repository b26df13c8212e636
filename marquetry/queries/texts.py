"""Normalisation, noise, cleaning and labels of texts."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import align as A
from ..plans.corpus import corrupt_training as corrupt
from ..resources import LANGUAGE_NAMES, PUNCTUATION
from .common import MARKS_SQL, SENT_SQL, STRIP_RE, WS, query, sentences, sql_strip, table


@query(f"WITH {SENT_SQL} SELECT doc_id, sent_idx, regexp_replace(nfc_normalize({sql_strip('regexp_replace(sentence, ' + chr(39) + '^-+' + chr(39) + ', ' + chr(39) * 2 + ')')}), '{WS}+', ' ', 'g') AS sentence FROM sent")
def preprocess_sentence(spark, sf_dir):
    """SQL has no NFKC; on these texts it changes nothing, which the comparison also shows."""
    return sentences(spark, sf_dir).select("doc_id", "sent_idx", T.preprocess(F.col("sentence")).alias("sentence"))


@query(f"SELECT doc_id, md5(translate(lower(text), '{MARKS_SQL}', '')) AS text FROM documents")
def corrupt_lower_punct(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.corrupt(F.col("text"))).alias("text"))


def _held_sql(text: str) -> str:
    """Marks within words become private characters; RE2 has no look-around, so that each is replaced twice."""
    for mark, held in zip(T._JOINERS, T._HELD, strict=True):
        char = r"[\p{N}]" if mark == "," else T._CHAR
        for _ in range(2):
            text = f"regexp_replace({text}, '({char}){re.escape(mark).replace(chr(39), chr(39) * 2)}({char})', '\\1{held}\\2', 'g')"
    return text


_MARKS = MARKS_SQL.replace("''", "'")
_BLANKED = f"translate({_held_sql('x')}, '{MARKS_SQL}', '{' ' * len(_MARKS)}')"
_HELD_BACK = ", ".join(f"'{c}'" for c in (T._HELD, T._JOINERS.replace("'", "''")))


@query(f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'zh' ELSE lang END AS lang, string_split(text || CASE WHEN doc_id % 4 = 0 THEN ' don''t, 3.50 well-known e.g. a,b 1,000!' ELSE '' END, chr(10)) AS l FROM documents),
l AS (SELECT doc_id, lang, generate_subscripts(l, 1) - 1 AS line, unnest(l) AS x FROM d)
SELECT doc_id, line, lower(CASE WHEN lang = 'zh' THEN translate(x, '{MARKS_SQL}', '') ELSE translate(regexp_replace(regexp_replace({_BLANKED}, '{WS}+', ' ', 'g'), '{STRIP_RE}', '', 'g'), {_HELD_BACK}) END) AS text FROM l""")
def corrupt_asr_lines(spark, sf_dir):
    """Lines as recognised speech, in a language without blanks too."""
    noisy = F.concat("text", F.when(F.col("doc_id") % 4 == 0, " don't, 3.50 well-known e.g. a,b 1,000!").otherwise(""))
    lang = F.when(F.col("doc_id") % 6 == 0, "zh").otherwise(F.col("lang"))
    rows = table(spark, sf_dir, "documents").select("doc_id", noisy.alias("t"), lang.alias("lang"))
    rows = rows.select("doc_id", F.posexplode(T.corrupt_asr(F.col("t"), F.col("lang"))).alias("line", "text"))
    return rows.withColumn("line", F.col("line").cast("long"))


_QUOTED = f"'{MARKS_SQL}'"


@query(f"""WITH c AS (SELECT doc_id, generate_subscripts(string_split(text, ''), 1) - 1 AS i, unnest(string_split(text, '')) AS c FROM documents),
r AS (SELECT doc_id, string_agg(CASE WHEN contains({_QUOTED}, c) THEN repeat(c, length(regexp_extract(md5('0:' || doc_id || ':' || i), '^[0-7]*'))) ELSE c END, '' ORDER BY i) AS t FROM c GROUP BY doc_id),
n AS (SELECT doc_id, CASE WHEN md5('0:' || doc_id)[1] < '8' THEN translate(text, {_QUOTED}, '') ELSE coalesce(t, text) END AS t FROM documents LEFT JOIN r USING (doc_id)),
l AS (SELECT doc_id, CASE WHEN md5('0:' || doc_id)[2] < '8' THEN lower(t) ELSE t END AS t FROM n)
SELECT doc_id, regexp_replace(nfc_normalize({sql_strip("regexp_replace(t, '^-+', '')")}), '{WS}+', ' ', 'g') AS text FROM l""")
def corrupt_social(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.corrupt_social_media(F.col("text"), F.col("doc_id")).alias("text"))


@query(f"WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda p: regexp_matches(p, '[^{T.WS_CLASS}]')) AS l FROM documents) SELECT doc_id, generate_subscripts(l, 1) - 1 AS par_idx, unnest(l) AS par FROM l")
def paragraph_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("par_idx", "par"))
    return rows.withColumn("par_idx", F.col("par_idx").cast("long"))


_EMOTICON_SQL = T.EMOTICON.replace("'", "''")


@query(f"""WITH t AS (SELECT conv_id, turn, list_filter(string_split(text || CASE WHEN turn % 2 = 0 THEN ' #tag @you http://x.y :-) ok 😀' ELSE '' END, ' '), lambda w: NOT regexp_matches(w, '^(?:http|#|@)') AND NOT regexp_matches(w, '^{_EMOTICON_SQL}\\z')) AS w FROM conversations)
SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(array_to_string(w, ' '), '{T.EMOJI}', '', 'g'), '{WS}+', ' ', 'g'), '{STRIP_RE}', '', 'g') AS text FROM t""")
def tweet_clean(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    noisy = F.concat("text", F.when(F.col("turn") % 2 == 0, " #tag @you http://x.y :-) ok 😀").otherwise(""))
    return rows.select("conv_id", "turn", T.clean_tweet(noisy).alias("text"))


@query(f"""WITH t AS (SELECT conv_id, turn, list_filter(string_split(CASE WHEN turn % 3 = 2 THEN '#only @tags' ELSE text || ' :-) 😀' END, ' '), lambda w: NOT regexp_matches(w, '^(?:http|#|@)') AND NOT regexp_matches(w, '^{_EMOTICON_SQL}\\z')) AS w FROM conversations),
c AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(array_to_string(w, ' '), '{T.EMOJI}', '', 'g'), '{WS}+', ' ', 'g'), '{STRIP_RE}', '', 'g') AS text FROM t)
SELECT conv_id, string_agg(text, '|' ORDER BY turn) AS texts FROM c WHERE text <> '' GROUP BY conv_id HAVING count(*) <= 5""")
def tweet_sets(spark, sf_dir):
    """Turns of conversations as tweets: cleaned, empty ones left out, and only lists of one to five."""
    noisy = F.when(F.col("turn") % 3 == 2, "#only @tags").otherwise(F.concat("text", F.lit(" :-) 😀")))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", noisy.alias("t")))).alias("l"))
    rows = rows.select("conv_id", F.transform("l", lambda x: x["t"]).alias("texts")).select("conv_id", T.clean_tweets(F.col("texts")).alias("texts"))
    return rows.where("texts is not null").select("conv_id", F.array_join("texts", "|").alias("texts"))


@query(f"""WITH l AS (SELECT conv_id, turn, list_transform(string_split(translate({sql_strip('text')}, '@', ' '), chr(10)), lambda x: regexp_replace(regexp_replace(x, '{WS}+', ' ', 'g'), '{STRIP_RE}', '', 'g')) AS l FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter(l, lambda x: x <> ''), '|') AS text FROM l""")
def answer_clean(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.clean_answer(F.col("text"), delimiter="|").alias("text"))


def _aligned(spark, sf_dir):
    """Alignments as if the model had dropped every e and put a z for every q that isn't there."""
    t = F.col("text")
    return table(spark, sf_dir, "benchmark").select("item_id", F.concat(t, F.lit("@@")).alias("i"), F.concat(F.when(F.col("item_id") % 9 == 0, F.regexp_replace(t, "(?s).", "@")).otherwise(F.translate(t, "e", "@")), F.when(F.col("item_id") % 9 == 0, "@@").otherwise("zz")).alias("o"))


_ALIGNED_SQL = "a AS (SELECT item_id, text || '@@' AS i, CASE WHEN item_id % 9 = 0 THEN repeat('@', length(text) + 2) ELSE translate(text, 'e', '@') || 'zz' END AS o FROM benchmark)"


@query(f"""WITH {_ALIGNED_SQL} SELECT item_id, round(CASE WHEN item_id % 9 = 0 THEN 0.0 ELSE 2 / length(i) END, 9) AS hallucinated, round(CASE WHEN item_id % 9 = 0 THEN 0.0 ELSE (length(o) - length(replace(o, '@', ''))) / length(i) END, 9) AS deleted FROM a""")
def hallucination_rates(spark, sf_dir):
    r = A.rates(F.col("i"), F.col("o"))
    return _aligned(spark, sf_dir).select("item_id", F.round(r["hallucinated"], 9).alias("hallucinated"), F.round(r["deleted"], 9).alias("deleted"))


@query("SELECT item_id, item_id % 9 = 0 AS refused FROM benchmark")
def refusals(spark, sf_dir):
    return _aligned(spark, sf_dir).select("item_id", T.is_refusal(F.col("o")).alias("refused"))


@query("SELECT item_id, true AS same_in, true AS same_out FROM benchmark")
def alignment(spark, sf_dir):
    """Each item aligned with itself after every e is dropped; without gaps both sides must read as before."""
    rows = table(spark, sf_dir, "benchmark").withColumn("out", F.translate("text", "e", "")).withColumn("a", A.align_column(F.col("text"), F.col("out")))
    return rows.select("item_id", (F.translate("a.aligned_in", "@", "") == F.col("text")).alias("same_in"), (F.translate("a.aligned_out", "@", "") == F.col("out")).alias("same_out"))


def _parts_sql(n: str, part: str) -> str:
    return f"WITH k AS (SELECT item_id, text, {n} AS n, unnest(range(5)) AS i FROM benchmark), p AS (SELECT item_id, i, text, (i * n // 5)::BIGINT AS a, ((i + 1) * n // 5)::BIGINT AS b FROM k) SELECT item_id, i AS part, {part} AS text FROM p"


@query(_parts_sql("length(text)", "substr(text, a + 1, b - a)"))
def equal_split_chars(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.equal_split_chars(F.col("text"), F.lit(5))).alias("part", "text"))
    return rows.withColumn("part", F.col("part").cast("long"))


@query(_parts_sql("len(string_split(text, ' '))", "array_to_string(string_split(text, ' ')[a + 1:b], ' ')"))
def equal_split_words(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.equal_split_words(F.col("text"), F.lit(5))).alias("part", "text"))
    return rows.withColumn("part", F.col("part").cast("long"))


_NAMES_SQL = ", ".join(f"('{k}', '{v}')" for k, v in LANGUAGE_NAMES.items())


@query(f"""SELECT d.doc_id, d.lang, CASE WHEN d.lang IN ('ja', 'km', 'my', 'zh') THEN '' ELSE ' ' END AS separator, n.name FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'zh' WHEN 1 THEN 'xx' ELSE lang END AS lang FROM documents) d LEFT JOIN (VALUES {_NAMES_SQL}) n(lang, name) USING (lang)""")
def separators(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "zh").when(F.col("doc_id") % 5 == 1, "xx").otherwise(F.col("lang")).alias("lang"))
    return docs.select("doc_id", "lang", T.separator(F.col("lang")).alias("separator"), T.language_name(F.col("lang")).alias("name"))


_CLASSES_SQL = ", ".join(f"(chr({ord(c)}), {i + 1})" for i, c in enumerate(["\n", *PUNCTUATION]))


@query(f"""WITH c AS (SELECT doc_id, generate_subscripts(string_split(text, ''), 1) - 1 AS pos, unnest(string_split(text, '')) AS ch FROM documents), n AS (SELECT doc_id, pos, lead(ch) OVER (PARTITION BY doc_id ORDER BY pos) AS nx FROM c)
SELECT doc_id, pos, label FROM n JOIN (VALUES {_CLASSES_SQL}) v(ch, label) ON nx = ch""")
def selfsup_labels(spark, sf_dir):
    """Places with a label: the next character is a line break or a mark."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.next_labels(F.col("text"))).alias("pos", "label")).where("label > 0")
    return rows.withColumn("pos", F.col("pos").cast("long"))


@query(f"""WITH c AS (SELECT doc_id, generate_subscripts(string_split(text, ''), 1) - 1 AS i, unnest(string_split(text, '')) AS ch FROM documents),
k AS (SELECT c.doc_id, c.i, c.ch, coalesce(v.label, 0) AS label, ('0x' || md5('0:' || c.doc_id || ':' || c.i)[1:8])::BIGINT AS draw FROM c LEFT JOIN (VALUES {_CLASSES_SQL}) v(ch, label) ON v.ch = c.ch),
s AS (SELECT *, NOT (label = 1 OR (label > 1 AND draw < 2147483648 AND coalesce(bool_or(label <> 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false))) AS stays FROM k),
g AS (SELECT *, sum(stays::INT) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM s),
f AS (SELECT doc_id, i, grp, ch, stays, label FROM g),
t AS (SELECT doc_id, string_agg(ch, '' ORDER BY i) FILTER (WHERE stays) AS text FROM f GROUP BY doc_id),
l AS (SELECT a.doc_id, a.grp, min_by(b.label, b.i) AS label FROM f a JOIN f b ON a.doc_id = b.doc_id AND b.label > 0 AND b.i > a.i AND ((b.grp = a.grp AND NOT b.stays) OR (b.grp = a.grp + 1 AND b.stays)) WHERE a.stays GROUP BY a.doc_id, a.grp)
SELECT doc_id, md5(coalesce(any_value(t.text), '')) AS text, count(*) FILTER (WHERE l.label = 1) AS newlines, count(*) FILTER (WHERE l.label > 1) AS marks, coalesce(sum(l.label * (l.grp % 97)), 0)::BIGINT AS places
FROM (SELECT doc_id FROM documents) d LEFT JOIN t USING (doc_id) LEFT JOIN l USING (doc_id) GROUP BY doc_id""")
def corrupt_training(spark, sf_dir):
    """Line breaks hidden, and half of the marks, with labels where they were."""
    rows = corrupt(table(spark, sf_dir, "documents"), "doc_id")
    places = F.aggregate(F.transform("labels", lambda x, i: x * ((i + 1) % 97)), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select("doc_id", F.md5("text").alias("text"), F.size(F.filter("labels", lambda x: x == 1)).cast("long").alias("newlines"), F.size(F.filter("labels", lambda x: x > 1)).cast("long").alias("marks"), places.alias("places"))
