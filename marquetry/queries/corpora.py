"""Sampling, splitting, balancing and grouping of corpora."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.score import points
from ..operators.segment import each_of
from ..plans import corpus as C
from .common import SENT_SQL, query, sentences, table, with_sentences


def _kmers(k: int):
    sql = f"""WITH {SENT_SQL}, g AS (SELECT doc_id, sent_idx // {k} AS kmer_idx, string_agg(sentence, ' ' ORDER BY sent_idx) AS text, count(*) AS n FROM sent GROUP BY doc_id, sent_idx // {k})
SELECT doc_id, kmer_idx, text FROM g WHERE n = {k} AND length(text) > 20"""

    @query(sql, f"kmers_k{k}")
    def run(spark, sf_dir):
        return C.kmers(sentences(spark, sf_dir), ["doc_id"], k, longer_than=20)


_kmers(2)
_kmers(3)


@query(f"""WITH {SENT_SQL}, r AS (SELECT doc_id, lang, sent_idx, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id || ':' || sent_idx)) AS rank, count(*) OVER (PARTITION BY lang) AS n FROM sent)
SELECT lang, doc_id, sent_idx FROM r WHERE rank <= least(round(n * 0.05::DOUBLE), 500)""")
def kmer_sample(spark, sf_dir):
    rows = sentences(spark, sf_dir).select("lang", "doc_id", "sent_idx")
    return C.sample_kmers(rows, ["doc_id", "sent_idx"], 0.05, 500, ["lang"])


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def concat_chunks(spark, sf_dir):
    return C.concatenate(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text", "\n")


@query("SELECT doc_id, lang, source FROM documents WHERE lang IN ('de', 'fr') AND NOT contains(source, '1')")
def filter_langs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return docs.where(F.col("lang").isin("de", "fr") & ~F.col("source").contains("1"))


@query("SELECT doc_id, lang FROM documents ORDER BY md5('s:' || doc_id), doc_id LIMIT 100")
def hash_sample(spark, sf_dir):
    """A sampling operator: the limit is what it does."""
    return C.take(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["doc_id"], n=100, seed="s")


@query("SELECT doc_id, lang FROM documents WHERE ('0x' || md5('f:' || doc_id)[1:8])::BIGINT < 429496729")
def fraction_sample(spark, sf_dir):
    return C.take(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["doc_id"], share=0.1, seed="f")


@query("SELECT doc_id, CASE WHEN ('0x' || md5('v:' || doc_id)[1:8])::BIGINT % 1000 < 50 THEN 'valid' ELSE 'train' END AS split FROM documents")
def valid_split(spark, sf_dir):
    return C.split_off(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 50, seed="v")


@query("SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= count(*) OVER (PARTITION BY lang) // 2 THEN 'train' ELSE 'test' END AS split FROM documents")
def half_split(spark, sf_dir):
    return C.half_split(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], ["doc_id"])


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 20")
def first_per_source(spark, sf_dir):
    return C.first_rows(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], ["doc_id"], 20)


@query(f"""WITH {SENT_SQL}, f AS (SELECT lang, doc_id, sent_idx, regexp_matches(sentence, '[\\p{{P}}\\p{{S}}]\\z') AS p FROM sent),
r AS (SELECT *, floor((count(*) OVER (PARTITION BY lang) - count_if(NOT p) OVER (PARTITION BY lang)) * 0.01::DOUBLE / (1 - 0.01::DOUBLE)) AS keep, row_number() OVER (PARTITION BY lang, p ORDER BY md5('n:' || doc_id || ':' || sent_idx), doc_id, sent_idx) AS rank FROM f)
SELECT lang, doc_id, sent_idx, p FROM r WHERE lang = 'th' OR p OR rank <= keep""")
def nonpunct_downsample(spark, sf_dir):
    rows = sentences(spark, sf_dir).select("lang", "doc_id", "sent_idx", T.ends_with_punctuation(F.col("sentence")).alias("p"))
    return C.thin_unpunctuated(rows, "p", 0.01, ["doc_id", "sent_idx"], seed="n")


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents")
def round_robin(spark, sf_dir):
    return C.interleave(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", ["doc_id"])


@query("""WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn, count(*) OVER (PARTITION BY lang) AS n FROM documents), m AS (SELECT max(n) AS longest FROM r)
SELECT lang, doc_id, turn + n * unnest(range(0, (longest - turn) // n + 1)) AS turn FROM r, m""")
def round_robin_restart(spark, sf_dir):
    return C.interleave(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", ["doc_id"], restart=True)


@query("""WITH n AS (SELECT lang, source, doc_id, count(*) OVER (PARTITION BY lang, source) AS n FROM documents)
SELECT lang, source, doc_id, unnest(range(1, CASE WHEN n < 40 THEN 40 // n + 1 ELSE 1 END + 1))::INT AS copy FROM n""")
def upsample(spark, sf_dir):
    return C.upsample(table(spark, sf_dir, "documents").select("lang", "source", "doc_id"), ["lang", "source"], 40)


@query("SELECT doc_id, l AS lang, unnest(range(1, CASE WHEN l IN ('ja', 'km', 'my', 'zh') THEN 4 ELSE 2 END))::INT AS copy FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'ja' ELSE lang END AS l FROM documents)")
def oversample_unspaced(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "ja").otherwise(F.col("lang")).alias("lang"))
    return C.oversample_unspaced(docs, 3)


@query("""WITH r AS (SELECT lang, doc_id, source, coalesce(list_position(['src7', 'src3', 'src0'], source), 4) AS rank FROM documents), b AS (SELECT *, min(rank) OVER (PARTITION BY lang) AS best FROM r)
SELECT lang, doc_id, source FROM b WHERE rank = best""")
def source_precedence(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", "source")
    return C.prefer(docs, ["lang"], "source", ["src7", "src3", "src0"])


@query("""WITH m AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN lang || '-en' ELSE lang END AS lang FROM documents)
SELECT doc_id, unnest(CASE WHEN contains(lang, '-') THEN list_transform(string_split(lang, '-'), lambda p: lang || '_' || upper(p)) ELSE [lang] END) AS lang FROM m""")
def codeswitch(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, F.concat("lang", F.lit("-en"))).otherwise(F.col("lang")).alias("lang"))
    return C.expand_mixed(docs)


@query(f"WITH {SENT_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM sent) SELECT doc_id, sent_idx FROM n WHERE n >= 2")
def multi_sentence_docs(spark, sf_dir):
    return C.with_several(sentences(spark, sf_dir).select("doc_id", "sent_idx"), ["doc_id"])


@query("""WITH b AS (SELECT lang, doc_id, coalesce(sum(length(text)) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)
SELECT lang, doc_id FROM b WHERE before < 100000""")
def char_budget(spark, sf_dir):
    return C.char_budget(table(spark, sf_dir, "documents").select("lang", "doc_id", "text"), ["lang"], ["doc_id"], 100_000).select("lang", "doc_id")


@query(f"""WITH {SENT_SQL}, r AS (SELECT lang, sentence, row_number() OVER (PARTITION BY lang ORDER BY doc_id, sent_idx) AS k FROM sent)
SELECT lang, 'Separate the sentences:' || chr(10) || string_agg('# ' || k || chr(10) || sentence, chr(10) ORDER BY k) AS prompt FROM r WHERE k <= 3 GROUP BY lang""")
def few_shot_prompt(spark, sf_dir):
    return C.few_shot_prompt(sentences(spark, sf_dir), ["lang"], ["doc_id", "sent_idx"], 3)


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def incremental_missing(spark, sf_dir):
    return C.missing(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("""WITH w AS (SELECT item_id, generate_subscripts(string_split(text, ' '), 1) AS k, unnest(string_split(text, ' ')) AS w FROM benchmark),
p AS (SELECT item_id, k, w, (sum(length(w) + 1) OVER (PARTITION BY item_id ORDER BY k))::BIGINT - length(w) - 1 AS a FROM w),
t AS (SELECT item_id, text, unnest(generate_series(0, (length(text) - 1) // 7)) AS j FROM benchmark),
u AS (SELECT item_id, j * 7 AS ta, least(j * 7 + 7, length(text)) AS tb, contains(substr(text, (j * 7 + 1)::BIGINT, 7), '.') AS y FROM t),
l AS (SELECT p.item_id, p.k, max(CASE WHEN u.y THEN 1 ELSE 0 END) AS y FROM p JOIN u ON p.item_id = u.item_id AND u.ta < p.a + length(p.w) AND p.a < u.tb GROUP BY p.item_id, p.k)
SELECT item_id, k, CASE WHEN k = max(k) OVER (PARTITION BY item_id) THEN 1 ELSE y END AS label FROM l""")
def token_word_projection(spark, sf_dir):
    """Labels of tokens (7 characters each) carried over to the words they overlap; the last word always ends a sentence."""
    from pyspark.sql import Window

    items = table(spark, sf_dir, "benchmark")
    w = Window.partitionBy("item_id").orderBy("k")
    words = items.select("item_id", F.posexplode(F.split("text", " ")).alias("k", "w")).withColumn("a", F.sum(F.length("w") + 1).over(w) - F.length("w") - 1)
    words = words.withColumn("b", F.col("a") + F.length("w"))
    tokens = items.select("item_id", "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 7).cast("int"))).alias("j"))
    tokens = tokens.select("item_id", (F.col("j") * 7).alias("ta"), F.least(F.col("j") * 7 + 7, F.length("text")).alias("tb"), F.substring("text", F.col("j") * 7 + 1, F.lit(7)).contains(".").cast("int").alias("y"))
    labels = words.join(tokens, "item_id").where("ta < b and a < tb").groupBy("item_id", "k").agg(F.max("y").alias("y"))
    last = F.max("k").over(Window.partitionBy("item_id"))
    return labels.select("item_id", (F.col("k") + 1).cast("long").alias("k"), F.when(F.col("k") == last, 1).otherwise(F.col("y")).alias("label"))


@query("SELECT doc_id FROM documents WHERE contains(text, chr(10))")
def sentences_with_newline(spark, sf_dir):
    """What the check of adaptation data would report."""
    return C.check_sentences(table(spark, sf_dir, "documents"), "text").select("doc_id")


def _by_character(text: str) -> tuple[np.ndarray, np.ndarray]:
    return points(text), np.arange(len(text))


_ROOM = 252


@query(f"""WITH RECURSIVE {SENT_SQL}, sent_ok AS (SELECT lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id, sent_idx) AS i, length(sentence)::BIGINT AS n FROM sent WHERE NOT regexp_matches(sentence, '^[0-9]+\\z')),
r AS (SELECT DISTINCT lang, source, 0::BIGINT AS i, 0::BIGINT AS n, 0::BIGINT AS count, 0::BIGINT AS block, false AS placed FROM sent_ok
  UNION ALL SELECT o.lang, o.source, o.i, o.n, CASE WHEN r.count + o.n + (r.count > 0)::INT < {_ROOM} THEN r.count + o.n + (r.count > 0)::INT WHEN o.n > {_ROOM} THEN 0 ELSE o.n END,
    r.block + CASE WHEN r.count + o.n + (r.count > 0)::INT < {_ROOM} THEN (r.count = 0)::INT WHEN o.n > {_ROOM} THEN 0 ELSE 1 END, r.count + o.n + (r.count > 0)::INT < {_ROOM} OR o.n <= {_ROOM}
  FROM r JOIN sent_ok o ON o.lang = r.lang AND o.source = r.source AND o.i = r.i + 1)
SELECT lang, source, block - 1 AS block_id, (sum(n) + count(*) + 1)::BIGINT AS tokens, count(*) AS sentences FROM r WHERE placed GROUP BY lang, source, block""")
def packed_blocks(spark, sf_dir):
    """Sentences of each language and source packed into blocks of 256 tokens (here: characters' code points)."""
    packed = C.pack_sentences(sentences(spark, sf_dir), ["lang", "source"], ["doc_id", "sent_idx"], 256, _by_character)
    return packed.select("lang", "source", "block_id", F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("long").alias("tokens"), F.size(F.filter("labels", lambda x: x == 1)).cast("long").alias("sentences"))


def _end_tokens(lists: pa.Array) -> pa.Array:
    """A document's labels are made at a time, and only the places of ones leave Python."""
    found = (x.as_py() for x in lists)
    return pa.array((np.flatnonzero(C.sentence_end_labels(s, _by_character, [" "] * len(s))[1]) if s else [] for s in found), pa.list_(pa.int64()), size=len(lists))


@query(f"WITH {SENT_SQL} SELECT doc_id, (sum(length(sentence)) OVER w + row_number() OVER w - 1)::BIGINT AS token FROM sent WINDOW w AS (PARTITION BY doc_id ORDER BY sent_idx)")
def sentence_end_labels(spark, sf_dir):
    """Which tokens (characters between two special ones) end a sentence."""
    docs = with_sentences(table(spark, sf_dir, "documents")).select("doc_id", F.arrow_udf(_end_tokens, "array<bigint>")("sentences").alias("t"))
    return each_of(docs, "t", ["doc_id"], "token")


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def groups(spark, sf_dir):
    return C.groups(table(spark, sf_dir, "documents"), ["lang", "source"])


@query("""SELECT dataset, id, md5('u:' || dataset || ':' || id) AS place FROM (SELECT 'documents' AS dataset, doc_id AS id FROM documents UNION ALL SELECT 'benchmark', item_id FROM benchmark)""")
def union_shuffled(spark, sf_dir):
    parts = {"documents": table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), "benchmark": table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))}
    return C.union_shuffled(parts, ["id"], seed="u").select("dataset", "id", "place")


@query("""SELECT doc_id, source, subset FROM documents JOIN (VALUES ('src1', 'laws'), ('src2', 'laws'), ('src2', 'judgements'), ('src5', 'judgements')) s(source, subset) USING (source)""")
def collect_subsets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return C.collect_subsets(docs, {"laws": ["src1", "src2"], "judgements": ["src2", "src5"]}, ["doc_id"], "source").select("doc_id", "source", "subset")


@query()
def baseline_sentences(spark, sf_dir):
    """Sentences by the JDK's rules, as a baseline."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(F.sentences("text", F.col("lang"), F.lit(""))).alias("sentences"))
