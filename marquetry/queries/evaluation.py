"""Boundary evaluation, curves, thresholds and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.segment import Style, rule_paragraphs, rule_segments, segment
from ..plans import evaluate as E
from ..plans.corpus import length_statistics
from ..functions import text as T
from .common import RULE_RE, SENT_SQL, STRIP_RE, WS, query, sentences, table, with_sentences

#: CTEs: sent; gold (doc_id, lang, pos) and pred (doc_id, lang, pos), boundaries of sentences and of segments of the text that the sentences make.
_GP_SQL = f"""{SENT_SQL},
gold AS (SELECT doc_id, lang, sent_idx, (sum(length(sentence)) OVER w + row_number() OVER w - 1)::BIGINT + CASE WHEN lead(sent_idx) OVER w IS NULL THEN 0 ELSE 1 END AS pos, lead(sent_idx) OVER w IS NULL AS last FROM sent WINDOW w AS (PARTITION BY doc_id ORDER BY sent_idx)),
whole AS (SELECT doc_id, lang, string_agg(sentence, ' ' ORDER BY sent_idx) AS text FROM sent GROUP BY doc_id, lang),
wl AS (SELECT doc_id, lang, regexp_extract_all(text, '{RULE_RE}') AS s FROM whole),
ws AS (SELECT doc_id, lang, generate_subscripts(s, 1) - 1 AS seg_idx, unnest(s) AS segment FROM wl),
pred AS (SELECT doc_id, lang, (sum(length(segment)) OVER (PARTITION BY doc_id ORDER BY seg_idx))::BIGINT AS pos FROM ws)"""
_COUNT_SQL = """each AS (SELECT doc_id, pos, max(g) AS g, max(p) AS p FROM (SELECT doc_id, pos, 1 AS g, 0 AS p FROM {g} UNION ALL SELECT doc_id, pos, 0, 1 FROM {p}) GROUP BY doc_id, pos),
counts AS (SELECT doc_id, sum(g * p)::BIGINT AS tp, sum((1 - g) * p)::BIGINT AS fp, sum(g * (1 - p))::BIGINT AS fn FROM each GROUP BY doc_id),
prf AS (SELECT *, round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END, 9) AS precision, round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 9) AS recall,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END, 9) AS f1, fp = 0 AND fn = 0 AS all_right FROM counts)"""
_PRF_SQL = f"WITH {_GP_SQL}, {_COUNT_SQL.format(g='gold', p='pred')}"


def _places(spark, sf_dir, *columns):
    """(columns, gold, pred): places of the boundaries of each document's sentences and of those of the segments of the text that they make."""
    docs = table(spark, sf_dir, "documents").select(*columns, E.scored_places(F.col("text"), F.col("lang")).alias("p"))
    return docs.select(*columns, F.col("p.gold").alias("gold"), F.col("p.predicted").alias("pred")).where("size(gold) + size(pred) > 0")


def _per_doc(spark, sf_dir, *columns):
    places = _places(spark, sf_dir, *dict.fromkeys(["doc_id", "lang", *columns]))
    return E.scores(places.select("doc_id", *columns, *E.confusion_of(F.col("gold"), F.col("pred"))))


@query(f"WITH {_GP_SQL} SELECT doc_id, pos, last FROM gold")
def labels_boundary(spark, sf_dir):
    return E.gold_boundaries(sentences(spark, sf_dir), ["doc_id"]).select("doc_id", "pos", "last")


@query(f"WITH {SENT_SQL} SELECT doc_id, (sum(length(sentence)) OVER w + row_number() OVER w - 2)::BIGINT AS pos FROM sent WINDOW w AS (PARTITION BY doc_id ORDER BY sent_idx)")
def labels_last_char(spark, sf_dir):
    return E.gold_boundaries(sentences(spark, sf_dir), ["doc_id"], after_space=False).select("doc_id", "pos")


@query(f"{_PRF_SQL} SELECT * FROM prf")
def prf_by_doc(spark, sf_dir):
    return _per_doc(spark, sf_dir)


@query(f"""{_PRF_SQL} SELECT lang, count(*) AS docs, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, round(avg(all_right::INT), 6) AS all_right
FROM prf JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) GROUP BY lang""")
def prf_by_lang(spark, sf_dir):
    """Macro averages over documents."""
    rows = _per_doc(spark, sf_dir, "lang")
    return rows.groupBy("lang").agg(F.count("*").alias("docs"), *[F.round(F.avg(F.col(c).cast("double") if c != "all_right" else F.col(c).cast("int")), 6).alias(c) for c in ("precision", "recall", "f1", "all_right")])


@query(f"""WITH {_GP_SQL},
ranked AS (SELECT doc_id, pos, row_number() OVER w AS n, lead(pos) OVER w IS NULL AS last FROM gold WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
dropped AS (SELECT doc_id, pos FROM ranked WHERE n % 3 = 0 OR last),
g AS (SELECT doc_id, pos FROM gold ANTI JOIN dropped USING (doc_id, pos)), p AS (SELECT doc_id, pos FROM pred ANTI JOIN dropped USING (doc_id, pos)),
{_COUNT_SQL.format(g='g', p='p')} SELECT * FROM prf""")
def exclude_every_k(spark, sf_dir):
    gold, pred = E.keep_every_kth_out(F.col("gold"), F.col("pred"), 3)
    return E.scores(_places(spark, sf_dir, "doc_id", "lang").select("doc_id", *E.confusion_of(gold, pred)).where("tp + fp + fn > 0"))


@query(f"""WITH {_GP_SQL}, {_COUNT_SQL.format(g='gold', p='pred')}
SELECT doc_id, round(CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE tp / (tp + fp + fn) END, 9) AS iou, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 1.0 ELSE 2 * tp / (2 * tp + fp + fn) END, 9) AS f1 FROM counts""")
def iou(spark, sf_dir):
    s = E.overlap(F.col("gold"), F.col("pred"))
    return _places(spark, sf_dir, "doc_id", "lang").select("doc_id", F.round(s["iou"], 9).alias("iou"), F.round(s["f1"], 9).alias("f1"))


_CURVE_SQL = """WITH e AS (SELECT round(value / 10, 0) AS threshold, (event_type = 'purchase')::BIGINT AS y FROM events),
c AS (SELECT threshold, sum(y) AS pos, count(*) AS n FROM e GROUP BY threshold),
r AS (SELECT threshold, (sum(pos) OVER w)::BIGINT AS tp, (sum(n) OVER w)::BIGINT AS m, (sum(pos) OVER ())::BIGINT AS a FROM c WINDOW w AS (ORDER BY threshold DESC)),
pr AS (SELECT threshold, tp, m - tp AS fp, a - tp AS fn, CASE WHEN m = 0 THEN 0.0 ELSE tp / m END AS p, CASE WHEN a = 0 THEN 0.0 ELSE tp / a END AS r FROM r),
curve AS (SELECT *, 2 * p * r / (p + r + 1e-6) AS f1 FROM pr)"""


def _curve(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.round(F.col("value") / 10, 0).alias("score"), (F.col("event_type") == "purchase").alias("label"))
    return E.precision_recall_curve(e, "score", "label")


@query(f"{_CURVE_SQL} SELECT threshold, tp, fp, fn, round(p, 9) AS precision, round(r, 9) AS recall, round(f1, 9) AS f1 FROM curve")
def pr_curve(spark, sf_dir):
    return _curve(spark, sf_dir).select("threshold", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(f"{_CURVE_SQL} SELECT threshold, round(f1, 9) AS f1 FROM curve ORDER BY curve.f1 DESC, threshold LIMIT 1")
def best_threshold(spark, sf_dir):
    return E.best_threshold(_curve(spark, sf_dir)).select("threshold", F.round("f1", 9).alias("f1"))


@query(f"{_CURVE_SQL}, s AS (SELECT (r - lag(r, 1, 0.0) OVER w) * (p + lag(p, 1, 1.0) OVER w) / 2 AS area FROM curve WINDOW w AS (ORDER BY threshold DESC)) SELECT round(sum(area), 9) AS auc FROM s")
def pr_auc(spark, sf_dir):
    return E.area_under_curve(_curve(spark, sf_dir)).select(F.round("auc", 9).alias("auc"))


@query("""WITH e AS (SELECT user_id % 10 AS g, value > 60 AS hit, event_type = 'purchase' AS y FROM events), counts AS (SELECT g AS "group", count_if(hit AND y)::BIGINT AS tp, count_if(hit AND NOT y)::BIGINT AS fp, count_if(NOT hit AND y)::BIGINT AS fn FROM e GROUP BY g)
SELECT *, round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END, 9) AS precision, round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 9) AS recall,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END, 9) AS f1, fp = 0 AND fn = 0 AS all_right FROM counts""")
def f1_at_threshold(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("group"), "value", (F.col("event_type") == "purchase").alias("label"))
    return E.at_threshold(e, "value", "label", 60.0, ["group"])


@query("""WITH m AS (SELECT source, lang, avg(length(text)) AS v FROM documents GROUP BY source, lang)
SELECT source, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, arg_min(lang, v) AS min_name, round(max(v), 6) AS max, arg_max(lang, v) AS max_name FROM m GROUP BY source""")
def statistics_by_source(spark, sf_dir):
    m = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.avg(F.length("text")).alias("v"))
    return E.statistics(m, "v", "lang", ["source"]).select("source", "min_name", "max_name", *[F.round(c, 6).alias(c) for c in ("mean", "median", "std", "min", "max")])


@query(f"""{_PRF_SQL}, j AS (SELECT lang, f1, doc_id % 7 = 0 AS refused FROM prf JOIN (SELECT doc_id, lang FROM documents) USING (doc_id))
SELECT lang, round(avg(f1), 6) AS f1, round(avg(f1) FILTER (WHERE NOT refused), 6) AS f1_success, count(*) FILTER (WHERE refused) AS refused FROM j GROUP BY lang""")
def success_average(spark, sf_dir):
    """Averages with and without the documents that count as refused."""
    rows = _per_doc(spark, sf_dir, "lang")
    refused = F.col("doc_id") % 7 == 0
    return rows.groupBy("lang").agg(F.round(F.avg("f1"), 6).alias("f1"), F.round(F.avg(F.when(~refused, F.col("f1"))), 6).alias("f1_success"), F.count_if(refused).alias("refused"))


@query(f"""{_PRF_SQL}, j AS (SELECT lang, source, f1 FROM prf JOIN (SELECT doc_id, lang, source FROM documents) USING (doc_id)), m AS (SELECT lang, source, avg(f1) AS f1 FROM j GROUP BY lang, source)
SELECT lang, round(avg(f1), 6) AS f1, count(*) AS datasets FROM m WHERE source IN ('src0', 'src1', 'src2') AND NOT (lang = 'de' AND source = 'src1') GROUP BY lang""")
def main_table_mean(spark, sf_dir):
    """Mean over chosen datasets, without excluded pairs."""
    m = _per_doc(spark, sf_dir, "lang", "source").groupBy("lang", "source").agg(F.avg("f1").alias("f1"))
    excluded = spark.createDataFrame([("de", "src1")], "lang string, source string")
    kept = m.where(F.col("source").isin("src0", "src1", "src2")).join(excluded, ["lang", "source"], "left_anti")
    return kept.groupBy("lang").agg(F.round(F.avg("f1"), 6).alias("f1"), F.count("*").alias("datasets"))


@query(f"""{_PRF_SQL}, t AS (SELECT unnest(['precision', 'recall', 'f1']) AS metric, unnest([precision, recall, f1]) AS v FROM prf) SELECT metric, round(avg(v), 6) AS value FROM t GROUP BY metric""")
def metric_averages(spark, sf_dir):
    tall = _per_doc(spark, sf_dir).unpivot([], ["precision", "recall", "f1"], "metric", "v")
    return tall.groupBy("metric").agg(F.round(F.avg("v"), 6).alias("value"))


@query("""WITH r AS (SELECT l_returnflag AS g, CASE WHEN l_linestatus = 'O' THEN 'N' ELSE 'A' END AS p FROM lineitem), l AS (SELECT DISTINCT g AS label FROM r UNION SELECT DISTINCT p FROM r),
c AS (SELECT label, count_if(g = label AND p = label)::BIGINT AS tp, count_if(p = label AND g <> label)::BIGINT AS fp, count_if(g = label AND p <> label)::BIGINT AS fn FROM r, l GROUP BY label)
SELECT label, tp + fn AS support, round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END, 9) AS precision, round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 9) AS recall,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END, 9) AS f1 FROM c""")
def class_report(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), F.when(F.col("l_linestatus") == "O", "N").otherwise("A").alias("p"))
    return E.class_report(rows, "g", "p")


@query(f"""WITH {SENT_SQL}, q AS (SELECT lang, count(*) AS n, min(length(sentence))::BIGINT AS min, max(length(sentence))::BIGINT AS max, quantile_cont(length(sentence), 0.25) AS a, quantile_cont(length(sentence), 0.5) AS b, quantile_cont(length(sentence), 0.75) AS c FROM sent GROUP BY lang)
SELECT lang, floor(b)::BIGINT AS target_length, greatest(floor((c - a) / 1.35), 10)::BIGINT AS spread, n, min, max FROM q WHERE n >= 100""")
def length_stats_by_lang(spark, sf_dir):
    return length_statistics(sentences(spark, sf_dir), ["lang"])


@query(f"""WITH l AS (SELECT lang, unnest(string_split(text, chr(10))) AS p FROM documents), k AS (SELECT lang, p, regexp_replace(p, '{STRIP_RE}', '', 'g') AS s FROM l WHERE regexp_matches(p, '[^{T.WS_CLASS}]'))
SELECT lang, count(*) AS paragraphs, round(avg(regexp_matches(s, '[\\p{{P}}\\p{{S}}]\\z')::INT), 9) AS ends_with_punctuation, round(avg((length(p) + 1 - length(regexp_replace(p, '{WS}', '', 'g'))) / (length(p) + 1)), 9) AS whitespace FROM k GROUP BY lang""")
def punctuation_ratios(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", F.explode(T.paragraphs(F.col("text"))).alias("p"))
    p = F.col("p")
    return rows.groupBy("lang").agg(F.count("*").alias("paragraphs"), F.round(F.avg(T.ends_with_punctuation(p).cast("int")), 9).alias("ends_with_punctuation"), F.round(F.avg(T.whitespace_ratio(p)), 9).alias("whitespace"))


@query("""WITH v AS (SELECT lang, source, avg(length(text)) AS value FROM documents GROUP BY lang, source), r AS (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY value DESC, source) AS rank FROM v)
SELECT x.lang, x.source AS a, y.source AS b FROM r x JOIN r y ON x.lang = y.lang AND x.rank < y.rank""")
def system_pairs(spark, sf_dir):
    v = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.avg(F.length("text")).alias("value"))
    return E.system_pairs(v, ["lang"], system="source")


@query()
def permutation_p_values(spark, sf_dir):
    """Full segments against lines: whether their scores differ by chance."""
    docs = with_sentences(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "s").withColumn("whole", F.array_join("s", " "))
    docs = segment(docs, text="whole", split_on_input_newlines=False, out="cut")
    docs = segment(docs, text="whole", threshold=0.5, split_on_input_newlines=False, out="lines")
    cuts = docs.select("doc_id", "lang", E.boundary_places(F.col("s"), F.length(T.separator(F.col("lang")))).alias("gold"), E.boundary_places(F.col("cut")).alias("a"), E.boundary_places(F.col("lines")).alias("b"))
    counts = [c.alias(f"{n}_{s}") for s in "ab" for n, c in zip(("tp", "fp", "fn"), E.confusion_of(F.col("gold"), F.col(s)), strict=True)]
    return E.permutation_test(cuts.where("size(gold) > 0").select("lang", "doc_id", *counts), ["lang"])


@query()
def style_mixture(spark, sf_dir):
    """A logistic mixture over embeddings with its two thresholds."""
    rows = table(spark, sf_dir, "embeddings").select("embedding", (F.col("label") == 3).alias("y"), F.round(F.col("embedding")[0].cast("double"), 3).alias("s"))
    m = E.fit_mixture(rows, "embedding", "y", "s")
    return spark.createDataFrame([(float(m["intercept"]), float(m["punctuation"]), float(m["newline"]))], "intercept double, punctuation double, newline double")


_SYSTEM_COUNTS = """each AS (SELECT doc_id, system, pos, max(g) AS g, max(p) AS p FROM (SELECT doc_id, system, pos, 1 AS g, 0 AS p FROM gg UNION ALL SELECT doc_id, system, pos, 0, 1 FROM pp) GROUP BY doc_id, system, pos),
counts AS (SELECT doc_id, system, sum(g * p)::BIGINT AS tp, sum((1 - g) * p)::BIGINT AS fp, sum(g * (1 - p))::BIGINT AS fn FROM each GROUP BY doc_id, system)
SELECT *, round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END, 9) AS precision, round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 9) AS recall,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END, 9) AS f1, fp = 0 AND fn = 0 AS all_right FROM counts"""
_TWO_SYSTEMS = "both_pred AS (SELECT doc_id, 'style' AS system, pos FROM pred UNION ALL SELECT doc_id, 'newline', length(text)::BIGINT FROM whole), both_gold AS (SELECT doc_id, system, pos FROM gold, (VALUES ('style'), ('newline')) v(system))"


def _mixture(spark, sf_dir, **options):
    style = Style({lang: {"own": (([2.0], 1.0), None, 0.5, 0.5)} for lang in ("de", "en", "es", "fr")}, "own")
    docs = with_sentences(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).withColumn("text", F.array_join("sentences", " "))
    docs = segment(docs, threshold=0.5, split_on_input_newlines=False, out="newline")
    docs = segment(docs, lang="lang", style=style, split_on_input_newlines=False, out="style")
    return E.evaluate_mixture(docs, ["doc_id"], {"newline": "newline", "style": "style", "none": None}, **options)


@query(f"WITH {_GP_SQL}, {_TWO_SYSTEMS}, gg AS (SELECT * FROM both_gold), pp AS (SELECT * FROM both_pred), {_SYSTEM_COUNTS}")
def evaluate_mixture(spark, sf_dir):
    """A newline threshold and a style's classifier on the same texts."""
    return _mixture(spark, sf_dir)


@query(f"""WITH {_GP_SQL}, {_TWO_SYSTEMS}, ranked AS (SELECT doc_id, pos, row_number() OVER w AS n, lead(pos) OVER w IS NULL AS last FROM gold WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
dropped AS (SELECT doc_id, pos FROM ranked WHERE n % 4 = 0 OR last), gg AS (SELECT * FROM both_gold ANTI JOIN dropped USING (doc_id, pos)), pp AS (SELECT * FROM both_pred ANTI JOIN dropped USING (doc_id, pos)), {_SYSTEM_COUNTS}""")
def evaluate_mixture_some(spark, sf_dir):
    """The same without every fourth boundary, and without the last."""
    return _mixture(spark, sf_dir, exclude_every_k=4).where("tp + fp + fn > 0")


def _kmer_sql(k: int, found: str) -> str:
    return f"""WITH {SENT_SQL}, g AS (SELECT lang, doc_id, sent_idx // {k} AS kmer, string_agg(sentence, ' ' ORDER BY sent_idx) AS text, list(length(sentence) ORDER BY sent_idx) AS lens, count(*) AS n FROM sent GROUP BY lang, doc_id, sent_idx // {k}),
k AS (SELECT lang, doc_id, kmer, text, list_transform(range(1, {k} + 1), lambda i: list_sum(lens[1:i])::BIGINT + i - 2) AS ends FROM g WHERE n = {k}),
c AS (SELECT lang, doc_id, kmer, ends, length(text) AS len, generate_subscripts(string_split(text, ''), 1) - 1 AS pos, unnest(string_split(text, '')) AS ch FROM k),
f AS (SELECT *, lead(ch) OVER (PARTITION BY doc_id, kmer ORDER BY pos) AS nx FROM c),
s AS (SELECT lang, doc_id, kmer, pos, pos = len - 1 AS last, list_contains(ends, pos) AS y, CASE WHEN contains('.!?…。！？', ch) AND (nx IS NULL OR regexp_matches(nx, '{WS}')) THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END AS p FROM f),
t AS (SELECT doc_id, kmer, p, sum(y::INT) AS a, count(*) AS m FROM s GROUP BY doc_id, kmer, p),
u AS (SELECT doc_id, kmer, p, (sum(a) OVER w)::DOUBLE / sum(m) OVER w AS pr, (sum(a) OVER w)::DOUBLE / {k} AS re FROM t WINDOW w AS (PARTITION BY doc_id, kmer ORDER BY p DESC)),
v AS (SELECT *, 2 * pr * re / (pr + re + 1e-6) AS f1, (re - lag(re, 1, 0) OVER w) * (pr + lag(pr, 1, 1) OVER w) / 2 AS area FROM u WINDOW w AS (PARTITION BY doc_id, kmer ORDER BY p DESC)),
best AS (SELECT doc_id, kmer, sum(area) AS auc, max(f1) AS f1_best, min(p) FILTER (WHERE f1 = top) AS threshold FROM (SELECT *, max(f1) OVER (PARTITION BY doc_id, kmer) AS top FROM v) GROUP BY doc_id, kmer),
r AS (SELECT s.lang, s.doc_id, s.kmer, bool_and(last OR (p > 0.25) = y) AS correct, bool_or(NOT last AND p > 0.25) AS found, bool_and(last OR (p > threshold) = y) AS correct_best, any_value(auc) AS auc, any_value(f1_best) AS f1_best FROM s JOIN best USING (doc_id, kmer) GROUP BY s.lang, s.doc_id, s.kmer)
SELECT lang, round(avg(auc), 6) AS auc, round(avg(({found})::INT), 6) AS accuracy, round(avg(correct_best::INT), 6) AS accuracy_best, round(avg(f1_best), 6) AS f1_best, count(*) AS n FROM r GROUP BY lang"""


def _kmer_evaluation(spark, sf_dir, k: int):
    docs = with_sentences(table(spark, sf_dir, "documents").select("lang", "doc_id", "text"), "s")
    each = E.kmer_scores_of(docs, ["lang", "doc_id"], "s", k, 0.25)
    out = E.kmer_averages(each, ["lang"], pairs=k == 2)
    return out.select("lang", *[F.round(c, 6).alias(c) for c in ("auc", "accuracy", "accuracy_best", "f1_best")], "n")


@query(_kmer_sql(2, "correct AND found"))
def pair_evaluation(spark, sf_dir):
    """Whether the one cut between two sentences is found, and nothing else."""
    return _kmer_evaluation(spark, sf_dir, 2)


@query(_kmer_sql(3, "correct"))
def kmer_evaluation(spark, sf_dir):
    return _kmer_evaluation(spark, sf_dir, 3)


def _indices(spark, sf_dir):
    """Boundaries of two systems; in every ninth document they don't agree on the truth, in every tenth not on the length."""
    docs = table(spark, sf_dir, "documents").where("text <> ''")
    rows = []
    for name, cut in (("rules", rule_segments(F.col("text"))), ("lines", rule_paragraphs(F.col("text")))):
        other = F.lit(name == "lines")
        n = F.length("text")
        true = F.when(other & (F.col("doc_id") % 9 == 0), F.array(n - 1)).otherwise(F.array(n))
        rows.append(docs.select("lang", F.col("source").alias("dataset"), F.lit(name).alias("system"), "doc_id", E.boundary_places(cut).alias("predicted"), true.alias("true"), F.when(other & (F.col("doc_id") % 10 == 0), n + 1).otherwise(n).alias("length")))
    return rows


@query("SELECT lang, source AS dataset, doc_id, 2 AS systems, CASE WHEN doc_id % 9 = 0 THEN 2 ELSE 1 END AS true_sets, CASE WHEN doc_id % 10 = 0 THEN 2 ELSE 1 END AS lengths FROM documents WHERE text <> '' AND (doc_id % 9 = 0 OR doc_id % 10 = 0)")
def index_conflicts(spark, sf_dir):
    a, b = _indices(spark, sf_dir)
    return E.index_conflicts(a.unionByName(b)).select("lang", "dataset", "doc_id", "systems", "true_sets", "lengths")


@query(f"""SELECT lang, source AS dataset, doc_id, len(regexp_extract_all(text, '{RULE_RE}')) AS rules, len(regexp_extract_all(text, '(?s).*?
{WS}*|.+')) AS lines, length(text)::BIGINT AS length FROM documents WHERE text <> ''""")
def merged_indices(spark, sf_dir):
    """One row for each document with what both systems predict, where they agree on truth and length."""
    a, b = _indices(spark, sf_dir)
    same = b.drop("true", "length").join(a.select("doc_id", "true", "length"), "doc_id")
    m = E.merge_indices([a, same])
    return m.select("lang", "dataset", "doc_id", *[F.size(F.col("predicted")[n]).cast("long").alias(n) for n in ("rules", "lines")], F.col("length").cast("long").alias("length"))


@query("SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS deviation FROM events GROUP BY user_id")
def timing_statistics(spark, sf_dir):
    """Mean and sample deviation of repeated measurements; 0 for a single one."""
    t = E.timing_statistics(table(spark, sf_dir, "events"), ["user_id"], "value")
    return t.select("user_id", "n", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


@query("SELECT lang, source, round(avg(v), 6) AS value FROM (SELECT lang, source, CASE WHEN lang = 'de' THEN NULL ELSE length(text) END AS v FROM documents) GROUP BY lang, source")
def missing_values(spark, sf_dir):
    """Averages of measurements that a whole language lacks: null stays null."""
    rows = table(spark, sf_dir, "documents").select("lang", "source", F.when(F.col("lang") != "de", F.length("text")).alias("v"))
    return rows.groupBy("lang", "source").agg(F.round(F.avg("v"), 6).alias("value"))


@query("""WITH a AS (SELECT doc_id, length(text) * (1 + CASE doc_id % 4 WHEN 0 THEN 0.001 WHEN 1 THEN 0.00001 ELSE 0 END)::DOUBLE AS a, length(text)::DOUBLE AS b FROM documents WHERE text <> '')
SELECT doc_id, round(a, 6) AS a, b FROM a WHERE abs(a - b) > 1e-5 + 1e-4 * abs(b)""")
def far_apart(spark, sf_dir):
    """Values that differ by more than the tolerances."""
    docs = table(spark, sf_dir, "documents").where("text <> ''")
    n = F.length("text").cast("double")
    moved = n * (1 + F.when(F.col("doc_id") % 4 == 0, 0.001).when(F.col("doc_id") % 4 == 1, 0.00001).otherwise(0.0))
    return E.far_apart(docs.select("doc_id", moved.alias("v")), docs.select("doc_id", n.alias("v")), ["doc_id"], "v").select("doc_id", F.round("a", 6).alias("a"), "b")
