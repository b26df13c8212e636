"""Readers and writers: tables are written in each format and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..folders import shared_folder
from ..functions import text as T
from ..operators.score import predict_proba
from ..operators.segment import rule_segments
from ..plans import evaluate as E
from ..plans.corpus import concatenate
from ..plans.running import running_total
from ..resources import LANGUAGES, LANGUAGE_NAMES, SENTENCE_LENGTHS
from ..sources import readers as R, sinks as W
from .common import SCORED_SQL, SENT_SQL, places_scored, query, sentences, sql_segments, table

#: CTE numbered (lang, doc_id, sent_idx, line, sentence): a language's sentences in the order in which they are written.
_NUMBERED = f"{SENT_SQL}, numbered AS (SELECT lang, doc_id, sent_idx, row_number() OVER (PARTITION BY lang ORDER BY doc_id, sent_idx) - 1 AS line, sentence FROM sent)"


def _lang():
    """The language that a file's folder names."""
    return F.regexp_extract("file", "/lang=([a-z]+)", 1).alias("lang")


def _write_lines(rows, path: str, order: list[str], **options) -> str:
    """Text files of the column value, a folder for each language, with lines in the given order."""
    W.write_lines(rows, path, "lang", order, **options)
    return path


@query("SELECT * FROM (VALUES (0::BIGINT, 'A b. C'), (1, ''), (2, NULL)) t(doc_id, text)")
def read_texts_in_memory(spark, sf_dir):
    return R.texts(spark, ["A b. C", "", None])


@query(f"WITH {_NUMBERED} SELECT lang, line AS sent_idx, sentence FROM numbered")
def read_sentence_lines(spark, sf_dir):
    rows = sentences(spark, sf_dir).withColumn("value", F.concat(F.lit(" "), "sentence", F.lit("\r")))
    path = _write_lines(rows, shared_folder(spark), ["doc_id", "sent_idx"])
    return R.sentence_lines(spark, path, folders=True).select(_lang(), "sent_idx", "sentence")


@query(f"WITH {_NUMBERED} SELECT lang, line AS sent_idx, sentence FROM numbered WHERE line < 200")
def read_first_gzip_lines(spark, sf_dir):
    """Each file's first 200 lines: the limit is what the reader does."""
    path = _write_lines(sentences(spark, sf_dir).withColumn("value", F.col("sentence")), shared_folder(spark), ["doc_id", "sent_idx"], compression="gzip")
    return R.sentence_lines(spark, path, limit=200, folders=True).select(_lang(), "sent_idx", "sentence")


def _conllu(spark, sf_dir):
    rows = sentences(spark, sf_dir)
    lines = F.array(F.when(F.col("sent_idx") == 0, F.concat(F.lit("# newdoc id = "), F.col("doc_id").cast("string"))), F.concat(F.lit("# sent_id = "), F.col("sent_idx").cast("string")), F.concat(F.lit("# text = "), "sentence"), F.lit("1\tword\tword\tNOUN"), F.lit(""))
    rows = rows.select("lang", "doc_id", "sent_idx", F.filter(lines, lambda x: x.isNotNull()).alias("value"))
    return _write_lines(rows, shared_folder(spark), ["doc_id", "sent_idx"])


@query(f"WITH {_NUMBERED} SELECT lang, line AS sent_idx, sentence FROM numbered")
def read_conllu(spark, sf_dir):
    rows = R.conllu(spark, _conllu(spark, sf_dir), folders=True).select(_lang(), F.col("sent_idx").alias("line_no"), "sentence")
    ranked = running_total(rows, ["lang"], ["line_no"], F.lit(1), "rank")
    return ranked.select("lang", (F.col("rank") - 1).alias("sent_idx"), "sentence")


@query(f"WITH {_NUMBERED} SELECT lang, dense_rank() OVER (PARTITION BY lang ORDER BY doc_id) AS doc_id, sentence FROM numbered")
def read_conllu_documents(spark, sf_dir):
    return R.conllu(spark, _conllu(spark, sf_dir), documents=True, folders=True).select(_lang(), "doc_id", "sentence")


@query("SELECT doc_id, text AS \"left\", CASE WHEN doc_id % 3 = 0 THEN '  ' || text || chr(160) ELSE translate(text, 'e', 'E') END AS \"right\" FROM documents WHERE doc_id % 3 > 0 AND translate(text, 'e', 'E') <> text")
def parallel_rows(spark, sf_dir):
    """Pairs of texts with themselves (which go) and with other letters."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("left"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("  "), "text", F.lit(" "))).otherwise(F.translate("text", "e", "E")).alias("right"))
    return R.parallel(rows, "left", "right")


@query(f"WITH {sql_segments()} SELECT doc_id, seg_idx AS sent_idx, segment AS sentence FROM segs")
def read_jsonl_spans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", "text", rule_segments(F.col("text")).alias("s")).where("size(s) > 0")
    docs = docs.withColumn("ends", E.boundary_places(F.col("s")))
    spans = F.zip_with("s", "ends", lambda s, e: F.struct((e - F.length(s)).alias("start"), e.alias("end")))
    docs = docs.withColumn("value", F.to_json(F.struct("text", spans.alias("spans"))))
    path = _write_lines(docs, shared_folder(spark), ["doc_id"])
    # the reader numbers documents by line; lines are in order of doc_id
    order = running_total(docs.select("lang", "doc_id"), ["lang"], ["doc_id"], F.lit(1), "n").select("lang", "doc_id", (F.col("n") - 1).alias("line"))
    found = R.jsonl_spans(spark, path, folders=True).select(_lang(), F.col("doc_id").alias("line"), F.col("sent_idx").cast("long").alias("sent_idx"), "sentence")
    return found.join(order, ["lang", "line"]).select("doc_id", "sent_idx", "sentence")


_WORDS_SQL = f"{_NUMBERED}, w AS (SELECT lang, line, sentence, string_split(sentence, ' ') AS w FROM numbered)"


def _words(spark, sf_dir):
    """(lang, doc_id, sent_idx, value): lines of a sentence's words, tabs as blanks, with a 1 at its last."""
    w = F.split(F.translate("sentence", "\t", " "), " ")
    lines = T.let(w, lambda x: F.transform(x, lambda word, k: F.concat(word, F.when(k == F.size(x) - 1, "\t1").otherwise("\t0"))))
    return sentences(spark, sf_dir).select("lang", "doc_id", "sent_idx", lines.alias("value"))


@query(f"WITH {_NUMBERED} SELECT lang, line AS sent_idx, translate(sentence, chr(9), ' ') AS sentence FROM numbered")
def read_boundary_words(spark, sf_dir):
    """Words with a 1 after each sentence's last, written as labelled lines."""
    path = _write_lines(_words(spark, sf_dir), shared_folder(spark), ["doc_id", "sent_idx"])
    return R.boundary_words(spark, path, folders=True).select(_lang(), "sent_idx", "sentence")


@query("""WITH w AS (SELECT item_id, generate_subscripts(string_split(translate(text, chr(10), ' '), ' '), 1) AS k, unnest(string_split(translate(text, chr(10), ' '), ' ')) AS token FROM benchmark),
e AS (SELECT *, (sum(length(token) + 1) OVER (ORDER BY item_id, k))::BIGINT - 1 AS "end" FROM w)
SELECT token, CASE WHEN ends_with(token, '.') THEN 'PERIOD' WHEN ends_with(token, ',') THEN 'COMMA' ELSE 'O' END AS label, "end" - length(token) AS "start", "end" FROM e""")
def read_punctuated_tokens(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split(F.translate("text", "\n", " "), " ")).alias("k", "word"))
    rows = rows.withColumn("label", F.when(F.col("word").endswith("."), "PERIOD").when(F.col("word").endswith(","), "COMMA").otherwise("O")).withColumn("part", F.lit("all"))
    path = shared_folder(spark)
    W.write_labelled_words(rows, path, file="part", order=["item_id", "k"])
    return R.punctuated_tokens(spark, path, folders=True).select("token", "label", "start", "end")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{x}', '{LANGUAGE_NAMES[x]}')" for x in LANGUAGES if x in LANGUAGE_NAMES) + ") t(lang, name)")
def language_csv(spark, sf_dir):
    from ..resources import language_table

    path = shared_folder(spark)
    W.write_csv(language_table(spark), path)
    return R.language_csv(spark, path).where("name is not null").select("lang", "name")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {t}, {s})" for k, (t, s) in SENTENCE_LENGTHS.items()) + ") t(lang, target_length, spread)")
def lengths_json(spark, sf_dir):
    from ..resources import length_table

    path = shared_folder(spark)
    stats = F.map_from_entries(F.array_agg(F.struct("lang", F.struct("target_length", "spread"))))
    W.write_json(length_table(spark).agg(stats.alias("stats")), path)
    return R.lengths_json(spark, path)


@query(f"WITH {SCORED_SQL} SELECT doc_id, count(*) AS n, sum(CASE WHEN p > 0.25 THEN 1 ELSE 0 END)::BIGINT AS hits, round(sum(p::DOUBLE), 4) AS total FROM scored WHERE lang IN ('de', 'es') GROUP BY doc_id")
def stored_probabilities(spark, sf_dir):
    """Probability vectors kept as arrays in Parquet by language, and read again for two of them."""
    path = shared_folder(spark)
    docs = places_scored(predict_proba(table(spark, sf_dir, "documents"), blank=True))
    W.write_corpus(docs.select("lang", "doc_id", "probs"), path)
    rows = R.corpus(spark, path, ["de", "es"]).where("probs is not null")
    total = F.aggregate("probs", F.lit(0.0), lambda s, p: s + F.round(p.cast("double"), 6))  # float32's error adds up in long texts
    return rows.select("doc_id", F.size("probs").cast("long").alias("n"), F.size(F.filter("probs", lambda p: p > 0.25)).cast("long").alias("hits"), F.round(total, 4).alias("total"))


@query("SELECT lang, source AS style, count(*)::DOUBLE AS a, max(length(text))::DOUBLE AS b, 0.5::DOUBLE AS intercept, 0.25::DOUBLE AS punctuation, 0.125::DOUBLE AS newline FROM documents GROUP BY lang, source")
def stored_mixtures(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").groupBy("lang", F.col("source").alias("style")).agg(F.array(F.count("*").cast("double"), F.max(F.length("text")).cast("double")).alias("coefficients"))
    path = shared_folder(spark)
    W.write_json(rows.withColumns({"intercept": F.lit(0.5), "punctuation": F.lit(0.25), "newline": F.lit(0.125)}), path)
    return R.mixtures(spark, path).select("lang", "style", F.col("coefficients")[0].alias("a"), F.col("coefficients")[1].alias("b"), "intercept", "punctuation", "newline")


@query(f"WITH {_NUMBERED} SELECT line AS line_no, lang, sentence AS gold, translate(sentence, 'e', 'E') AS predicted FROM numbered")
def paired_files(spark, sf_dir):
    """Two folders with files of the same names, joined line by line."""
    paths = []
    for value in ("sentence", "translate(sentence, 'e', 'E')"):
        lines = _write_lines(sentences(spark, sf_dir).selectExpr("lang", "doc_id", "sent_idx", f"{value} as value"), shared_folder(spark), ["doc_id", "sent_idx"])
        paths.append(R.numbered_lines(spark, lines, folders=True).select(F.concat(F.lit("x/"), _lang()).alias("file"), "line_no", "line"))
    return R.paired_files(*paths).select("line_no", F.col("file").alias("lang"), "gold", "predicted")


@query(f"""WITH {sql_segments()}, e AS (SELECT doc_id, lang, source, (sum(length(segment)) OVER (PARTITION BY doc_id ORDER BY seg_idx))::BIGINT AS pos FROM segs),
d AS (SELECT lang, source, doc_id, max(pos) AS n, count(*) AS k FROM e GROUP BY lang, source, doc_id)
SELECT lang, source AS dataset, 'rules' AS system, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1 AS doc_id, k AS predicted, 1 AS "true", n AS length FROM d""")
def stored_boundary_indices(spark, sf_dir):
    """Predicted and true boundaries of each document as nested JSON, a file for each language."""
    docs = table(spark, sf_dir, "documents").select("lang", "source", "doc_id", E.boundary_places(rule_segments(F.col("text"))).alias("p")).where("size(p) > 0")
    leaf = F.struct("doc_id", F.struct(F.col("p").alias("predicted_indices"), F.slice("p", -1, 1).alias("true_indices"), F.element_at("p", -1).alias("length")).alias("x"))
    groups = docs.groupBy("lang", "source").agg(F.transform(F.array_sort(F.collect_list(leaf)), lambda r: r["x"]).alias("docs"))
    systems = groups.groupBy("lang").agg(F.map_from_entries(F.array_agg(F.struct("source", F.create_map(F.lit("rules"), F.col("docs"))))).alias("m"))
    path = _write_lines(systems.select("lang", F.to_json(F.create_map("lang", "m")).alias("value")), shared_folder(spark), [])
    got = R.boundary_indices(spark, path)
    return got.select("lang", "dataset", "system", F.col("doc_id").cast("long").alias("doc_id"), F.size("predicted").cast("long").alias("predicted"), F.size("true").alias("true"), F.col("length").cast("long").alias("length"))


@query(f"WITH {SENT_SQL} SELECT lang, doc_id, sent_idx, sentence FROM sent WHERE lang IN ('de', 'fr')")
def stored_corpus(spark, sf_dir):
    """Sentences stored by language and source; two languages are read."""
    path = shared_folder(spark)
    W.write_corpus(sentences(spark, sf_dir), path, ("lang", "source"))
    return R.corpus(spark, path, ["de", "fr"]).select("lang", "doc_id", "sent_idx", "sentence")


@query("SELECT doc_id, count(*) AS rows, (SELECT count(*) FROM documents) - (SELECT count(*) FROM documents WHERE lang = 'en') AS added FROM documents GROUP BY doc_id")
def append_missing(spark, sf_dir):
    """English documents are stored, then all: only the others are added, and nothing when that is done again."""
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "lang"), shared_folder(spark)
    W.append_missing(docs.where("lang = 'en'"), path, ["doc_id"])
    added = W.append_missing(docs, path, ["doc_id"])
    again = W.append_missing(docs, path, ["doc_id"])
    return spark.read.parquet(path).groupBy("doc_id").agg(F.count("*").alias("rows")).withColumn("added", F.lit(added + again).cast("long"))


@query("SELECT lang, source, round(avg(length(text)), 6) AS value FROM documents GROUP BY lang, source")
def stored_metrics(spark, sf_dir):
    path = shared_folder(spark)
    W.write_json(table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.round(F.avg(F.length("text")), 6).alias("value")), path)
    return spark.read.schema("lang string, source string, value double").json(path)


@query("""WITH v AS (SELECT source, count(*) AS n FROM documents GROUP BY source), r AS (SELECT source, row_number() OVER (ORDER BY n DESC, source) AS rank, n FROM v),
p AS (SELECT x.source AS a, y.source AS b, CASE WHEN x.rank < y.rank THEN printf('%.3f', y.n / x.n) ELSE '-' END AS cell FROM r x, r y),
l AS (SELECT a, a || ' & ' || string_agg(cell, ' & ' ORDER BY b) || ' \\\\' AS line FROM p GROUP BY a)
SELECT a AS source, line FROM l""")
def latex_matrix(spark, sf_dir):
    """A matrix of the better system against the worse one, as rows of a LaTeX table."""
    v = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("value"))
    pairs = E.system_pairs(v.withColumn("g", F.lit(1)), ["g"], system="source")
    n = v.select(F.col("source").alias("a"), F.col("value").alias("na")), v.select(F.col("source").alias("b"), F.col("value").alias("nb"))
    found = pairs.join(n[0], "a").join(n[1], "b").select("a", "b", (F.col("nb") / F.col("na")).alias("p")).collect()
    names = sorted(r["source"] for r in v.select("source").collect())
    lines = E.latex_matrix([tuple(r) for r in found], names).split("\n")[2:-1]
    return spark.createDataFrame(list(zip(names, lines, strict=True)), "source string, line string")


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS turns FROM conversations GROUP BY conv_id")
def nested_corpus(spark, sf_dir):
    """Lists of lists: turns stored by role, read and joined to conversations."""
    path = shared_folder(spark)
    W.write_corpus(table(spark, sf_dir, "conversations"), path, ("role",))
    rows = R.corpus(spark, path)
    return concatenate(rows, ["conv_id"], "turn", "text", "\n").join(rows.groupBy("conv_id").agg(F.count("*").alias("turns")), "conv_id")
