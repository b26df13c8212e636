"""Sliding windows, blocks, and encodings of characters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.chunk import hat_weight, window_spans
from ..operators.score import linear_probability, sigmoid_column, token_probabilities, train_linear_scorer
from ..operators.segment import segment
from ..plans.corpus import token_blocks, windows_of
from .common import SENT_SQL, query, sentences, table

_SPANS = "generate_series(0, ceil(greatest(n - {b}, 0) / {s}::DOUBLE)::BIGINT)"


@query(f"""WITH d AS (SELECT doc_id, length(text)::BIGINT AS n FROM documents WHERE text IS NOT NULL), k AS (SELECT doc_id, n, unnest({_SPANS.format(b=512, s=256)}) AS chunk FROM d)
SELECT doc_id, chunk, least(chunk * 256, greatest(n - 512, 0)) AS "start", least(least(chunk * 256, greatest(n - 512, 0)) + 512, n) AS "end" FROM k""")
def chunk_windows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(window_spans(F.length("text"), 512, 256)).alias("chunk", "w"))
    return docs.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.col("w.start").cast("long").alias("start"), F.col("w.end").cast("long").alias("end"))


@query("SELECT k AS \"offset\", round(1 - abs(-(1 - 1/512.0::DOUBLE) + k * (2 * (1 - 1/512.0::DOUBLE) / 511)), 9) AS weight FROM (SELECT unnest(range(512)) AS k)")
def hat_weights(spark, sf_dir):
    return spark.range(512).select(F.col("id").alias("offset"), F.round(hat_weight(F.col("id"), 512), 9).alias("weight"))


@query(f"""WITH d AS (SELECT item_id, text, length(text)::BIGINT AS n FROM benchmark), k AS (SELECT item_id, text, n, unnest({_SPANS.format(b=64, s=32)}) AS chunk FROM d),
w AS (SELECT item_id, text, chunk, least(chunk * 32, greatest(n - 64, 0)) AS a, least(64, n) AS m FROM k),
c AS (SELECT item_id, chunk, a, m, unnest(range(m)) AS o, text FROM w),
v AS (SELECT item_id, a + o AS pos, (unicode(substr(text, (a + o + 1)::BIGINT, 1)) % 7 + chunk)::DOUBLE AS x, 1 - abs(-(1 - 1/64.0::DOUBLE) + o * (2 * (1 - 1/64.0::DOUBLE) / 63)) AS w FROM c)
SELECT item_id, pos, round(sum(w * x) / sum(w), 6) AS mean FROM v GROUP BY item_id, pos""")
def overlap_average(spark, sf_dir):
    """Values of overlapping windows, averaged for each character with hat weights."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text", F.posexplode(window_spans(F.length("text"), 64, 32)).alias("chunk", "w"))
    codes = T.code_points(F.substring(F.col("text"), F.col("w.start") + 1, F.col("w.end") - F.col("w.start")))
    chars = items.select("item_id", "chunk", F.col("w.start").alias("a"), F.posexplode(codes).alias("o", "c"))
    w = hat_weight(F.col("o"), 64)
    x = (F.col("c") % 7 + F.col("chunk")).cast("double")
    return chars.groupBy("item_id", (F.col("a") + F.col("o")).cast("long").alias("pos")).agg(F.round(F.sum(w * x) / F.sum(w), 6).alias("mean"))


@query("""WITH p AS (SELECT lang, doc_id, length(text)::BIGINT AS n, (sum(length(text)) OVER (PARTITION BY lang ORDER BY doc_id))::BIGINT - length(text) AS begin, (sum(length(text)) OVER (PARTITION BY lang))::BIGINT AS total FROM documents),
b AS (SELECT *, unnest(generate_series(begin // 4096, (begin + n - 1) // 4096)) AS block FROM p WHERE n > 0)
SELECT lang, doc_id, block, greatest(block * 4096 - begin, 0) AS "start", least((block + 1) * 4096 - begin, n) - greatest(block * 4096 - begin, 0) AS "length" FROM b WHERE (block + 1) * 4096 <= total""")
def training_blocks(spark, sf_dir):
    return token_blocks(table(spark, sf_dir, "documents"), ["lang"], ["doc_id"], 4096)


@query("""WITH p AS (SELECT lang, doc_id, length(text)::BIGINT AS n, (sum(length(text)) OVER (PARTITION BY lang ORDER BY doc_id))::BIGINT - length(text) AS begin, (sum(length(text)) OVER (PARTITION BY lang))::BIGINT AS total FROM documents),
b AS (SELECT *, unnest(generate_series(greatest((begin - 512) // 2048 - 1, 0), (begin + n - 1) // 2048)) AS block FROM p WHERE n > 0), c AS (SELECT lang, doc_id, block, greatest(block * 2048 - begin, 0) AS a, least(block * 2048 + 2560 - begin, n) AS e FROM b WHERE block * 2048 + 2560 <= total)
SELECT lang, doc_id, block, a AS "start", e - a AS "length" FROM c WHERE e > a""")
def overflowing_blocks(spark, sf_dir):
    """Blocks of 2048 characters that each go on for 512."""
    return token_blocks(table(spark, sf_dir, "documents"), ["lang"], ["doc_id"], 2048, overflow=512)


@query("""WITH p AS (SELECT lang, source, doc_id, length(text)::BIGINT AS n, (sum(length(text)) OVER (PARTITION BY lang ORDER BY doc_id))::BIGINT - length(text) AS begin, (sum(length(text)) OVER (PARTITION BY lang))::BIGINT AS total FROM documents),
b AS (SELECT *, unnest(generate_series(begin // 4096, (begin + n - 1) // 4096)) AS block FROM p WHERE n > 0)
SELECT lang, block, source, count(*) AS pieces FROM b WHERE (block + 1) * 4096 <= total GROUP BY lang, block, source""")
def block_sources(spark, sf_dir):
    """How many pieces of each source a block has."""
    docs = table(spark, sf_dir, "documents")
    blocks = token_blocks(docs, ["lang"], ["doc_id", "source"], 4096)
    return blocks.groupBy("lang", "block", "source").agg(F.count("*").alias("pieces"))


@query(f"""WITH {SENT_SQL}, c AS (SELECT doc_id, sent_idx // 5 AS chunk, string_agg(sentence, '|' ORDER BY sent_idx) AS t, count(*) AS n FROM sent GROUP BY doc_id, sent_idx // 5)
SELECT doc_id, chunk, t || repeat('|', 5 - n) AS sentences FROM c""")
def count_windows(spark, sf_dir):
    w = windows_of(sentences(spark, sf_dir), ["doc_id"], 5)
    return w.select("doc_id", "chunk", F.array_join("sentences", "|").alias("sentences"))


@query("SELECT item_id, generate_subscripts(string_split(text, ''), 1) - 1 AS pos, unicode(unnest(string_split(text, '')))::INT AS code FROM benchmark")
def codepoints(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.code_points(F.col("text"))).alias("pos", "code"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


@query("""WITH c AS (SELECT item_id, generate_subscripts(string_split(text, ''), 1) - 1 AS pos, unicode(unnest(string_split(text, ''))) AS u FROM benchmark),
p AS (SELECT unnest([%s]) AS prime, unnest(range(8)) AS k)
SELECT item_id, pos, k, (((u + 1) * prime) %% 8192)::INT AS code FROM c, p""" % ", ".join(map(str, T.PRIMES[:8])))
def hash_encode(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.hash_codes(F.col("text"))).alias("pos", "h"))
    rows = rows.select("item_id", F.col("pos").cast("long").alias("pos"), F.posexplode("h").alias("k", "code"))
    return rows.withColumn("k", F.col("k").cast("long"))


@query("SELECT event_id, round((1 / (1 + exp(-(value - 50) / 25)))::FLOAT::DOUBLE, 5) AS p FROM events")
def sigmoid_scores(spark, sf_dir):
    p = sigmoid_column(F.array((F.col("value") - 50) / 25))[0]
    return table(spark, sf_dir, "events").select("event_id", F.round(p.cast("double"), 5).alias("p"))


_COEF = [round(((k * 37) % 19 - 9) / 10, 1) for k in range(64)]


@query(f"SELECT vec_id, round(1 / (1 + exp(-(list_dot_product(embedding::DOUBLE[], {_COEF}::DOUBLE[]) + 0.25))), 6) AS p FROM embeddings")
def style_classifier(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(linear_probability(F.col("embedding"), _COEF, 0.25), 6).alias("p"))


@query("""WITH w AS (SELECT item_id, generate_subscripts(string_split(text, ' '), 1) AS k, unnest(string_split(text, ' ')) AS w FROM benchmark),
e AS (SELECT item_id, w, (sum(length(w) + 1) OVER (PARTITION BY item_id ORDER BY k) - 1)::BIGINT AS pos FROM w)
SELECT item_id, pos - 1 AS pos, round((1 / (1 + exp(-(length(w) - 5)::DOUBLE)))::FLOAT::DOUBLE, 5) AS p FROM e WHERE length(w) > 0""")
def token_char_probs(spark, sf_dir):
    """Logits of words, put at their last characters."""
    words = F.split("text", " ")
    rows = table(spark, sf_dir, "benchmark").select("item_id", "text", F.filter(words, lambda w: w != "").alias("w"), words.alias("all"))
    ends = F.aggregate("all", F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("e")),
                       lambda a, w: F.struct((a["at"] + F.length(w) + 1).alias("at"), F.when(w != "", F.concat(a["e"], F.array(a["at"] + F.length(w)))).otherwise(a["e"]).alias("e")))["e"]
    logits = F.transform("w", lambda w: (F.length(w) - 5).cast("double"))
    probs = token_probabilities(F.length("text"), ends, logits)
    out = rows.select("item_id", F.posexplode(probs).alias("pos", "p")).where("p > 0")
    return out.select("item_id", F.col("pos").cast("long").alias("pos"), F.round(F.col("p").cast("double"), 5).alias("p"))


@query()
def linear_scorer(spark, sf_dir):
    """A scorer that is trained on the line breaks of the documents themselves, then cuts them."""
    docs = table(spark, sf_dir, "documents")
    found = segment(docs, train_linear_scorer(docs), threshold=0.5, split_on_input_newlines=False)
    return found.select("doc_id", F.size("segments").alias("segments"))
