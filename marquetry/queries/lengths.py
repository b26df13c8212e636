"""Length priors and segmentation under length constraints."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.priors import NAMES, prior, weights, with_length_defaults
from ..operators.segment import each_of, length_ends, segment
from ..resources import DEFAULT_LENGTH, SENTENCE_LENGTHS, length_table
from .common import SCORED_SQL, query, table

_STATS = ", ".join(f"('{k}', {t}, {s})" for k, (t, s) in SENTENCE_LENGTHS.items())
_MAX = 150
_WEIGHT = {
    "uniform": "1.0::DOUBLE",
    "gaussian": "exp(-0.5 * ((n - t) / s) * ((n - t) / s))",
    "clipped_polynomial": "greatest(1.0 - ((n - t) * (n - t)) / (s * s), 0.0)",
    "lognormal": "exp(-0.5 * power((ln(n) - (ln(t) + (s / t) * (s / t))) / (s / t), 2)) / n",
}


def _prior_query(name: str):
    sql = f"""WITH l(lang, t, s) AS (SELECT a, b::DOUBLE, c::DOUBLE FROM (VALUES {_STATS}) v(a, b, c)), g AS (SELECT unnest(range(1, 201))::DOUBLE AS n)
SELECT lang, n::BIGINT AS length, round(CASE WHEN n > {_MAX} THEN 0.0 ELSE {_WEIGHT[name]} END, 9) AS weight FROM l, g"""

    @query(sql, f"prior_{name}")
    def run(spark, sf_dir):
        rows = length_table(spark).crossJoin(spark.range(1, 201).withColumnRenamed("id", "length"))
        weight = prior(name, F.col("length"), F.col("target_length").cast("double"), F.col("spread").cast("double"), _MAX)
        return rows.select("lang", "length", F.round(weight, 9).alias("weight"))


for _name in NAMES:
    _prior_query(_name)


@query(f"""SELECT doc_id, coalesce(t, {DEFAULT_LENGTH[0]}) AS target_length, coalesce(s, {DEFAULT_LENGTH[1]}) AS spread
FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'xx' ELSE lang END AS lang FROM documents) d LEFT JOIN (VALUES {_STATS}) v(a, t, s) ON lang = a""")
def lang_defaults(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "xx").otherwise(F.col("lang")).alias("lang"))
    return with_length_defaults(docs).select("doc_id", "target_length", "spread")


def _invariants(df):
    s = F.col("segments")
    longest = F.array_max(F.transform(s, lambda x: F.length(x)))
    joined = F.array_join(s, "")
    return df.where("text <> ''").select("doc_id", F.length(joined).cast("long").alias("chars"), (longest <= 200).alias("within"), F.md5(joined).alias("joined"))


_INVARIANTS_SQL = "SELECT doc_id, length(text)::BIGINT AS chars, true AS within, md5(text) AS joined FROM documents WHERE text <> ''"


@query(_INVARIANTS_SQL)
def constrained_viterbi(spark, sf_dir):
    """Whole texts, cut optimally into 20 to 200 characters with a Gaussian prior; the SQL holds what every cut must keep."""
    return _invariants(segment(table(spark, sf_dir, "documents"), lang="lang", split_on_input_newlines=False, min_length=20, max_length=200, prior_type="gaussian"))


@query(_INVARIANTS_SQL)
def constrained_greedy(spark, sf_dir):
    return _invariants(segment(table(spark, sf_dir, "documents"), lang="lang", split_on_input_newlines=False, min_length=20, max_length=200, prior_type="clipped_polynomial", algorithm="greedy"))


@query()
def constrained_segments(spark, sf_dir):
    """The segments themselves, with a log-normal prior."""
    docs = segment(table(spark, sf_dir, "documents"), lang="lang", split_on_input_newlines=False, min_length=10, max_length=300, prior_type="lognormal")
    return each_of(docs, "segments", ["doc_id"], "segment", "seg_idx")


@query("SELECT doc_id, true AS within, md5(text) AS joined FROM documents WHERE text <> ''")
def constrained_min_only(spark, sf_dir):
    """Only a least length: the threshold isn't consulted then either."""
    docs = segment(table(spark, sf_dir, "documents"), split_on_input_newlines=False, min_length=40).where("text <> ''")
    s = F.col("segments")
    short = F.exists(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(1))), lambda x: (F.length(x) < 40) & (F.size(s) > 1))
    return docs.select("doc_id", (~short).alias("within"), F.md5(F.array_join(s, "")).alias("joined"))


_LOW, _HIGH = 20, 200
_PLAIN = "docs AS (SELECT doc_id, lang, length(text)::BIGINT AS n FROM documents WHERE regexp_matches(text, '[^\\s]'))"


def _tables(name: str, log: bool) -> str:
    """(lang, w): weights, or their logarithms, of the lengths 0 to 200."""
    rows = []
    for lang in ("de", "en", "es", "fr"):
        w = weights(name, _HIGH, _HIGH, lang)
        with np.errstate(divide="ignore"):
            w = np.log(w) if log else w
        rows.append(f"('{lang}', [{', '.join(repr(float(x)) if np.isfinite(x) else chr(39) + '-inf' + chr(39) + '::DOUBLE' for x in w)}]::DOUBLE[])")
    return f"(VALUES {', '.join(rows)}) w(lang, w)"


def _place(p: float, log: bool) -> str:
    """A probability as the search has it: a float32, or its logarithm."""
    return repr(float(np.log(np.float32(p)) if log else np.float32(p)))


def _places(log: bool) -> str:
    """CTE d (doc_id, n, w, m, places): ends with a probability, and the text's end, in order."""
    return f"""{SCORED_SQL}, {_PLAIN},
pl AS (SELECT doc_id, pos + 1 AS pos, CASE WHEN p > 0.5 THEN {_place(0.9, log)} ELSE {_place(0.4, log)} END::DOUBLE AS x FROM scored WHERE p > 0),
al AS (SELECT doc_id, pos, x FROM pl JOIN docs USING (doc_id) WHERE pos < n UNION ALL SELECT doc_id, n, {"0.0" if log else "1.0"}::DOUBLE FROM docs),
li AS (SELECT doc_id, list({{'pos': pos, 'x': x}} ORDER BY pos) AS places, count(*) AS m FROM al GROUP BY doc_id),
d AS (SELECT doc_id, n, w, m, places FROM docs JOIN li USING (doc_id) JOIN {_tables("gaussian" if log else "clipped_polynomial", log)} USING (lang))"""


_VITERBI = f"""WITH RECURSIVE {_places(True)},
r AS (SELECT doc_id, 0::BIGINT AS k, 0::BIGINT AS pos, NULL::BIGINT AS source, [{{'pos': 0::BIGINT, 'best': 0.0::DOUBLE}}] AS live FROM d
  UNION ALL SELECT doc_id, k, CASE WHEN top > '-inf'::DOUBLE THEN here ELSE -1 END, list_filter(cand, lambda c: c.v = top)[1].pos, CASE WHEN top > '-inf'::DOUBLE THEN list_append(live, {{'pos': here, 'best': top}}) ELSE live END
  FROM (SELECT *, coalesce(list_max(list_transform(cand, lambda c: c.v)), '-inf'::DOUBLE) AS top FROM (SELECT doc_id, k, h.pos AS here, live, list_transform(list_filter(live, lambda l: l.pos <= h.pos - {_LOW}), lambda l: {{'v': l.best + w[h.pos - l.pos + 1] + h.x, 'pos': l.pos}}) AS cand
    FROM (SELECT r.doc_id, r.k + 1 AS k, d.w, d.places[r.k + 1] AS h, list_filter(r.live, lambda l: l.pos >= d.places[r.k + 1].pos - {_HIGH}) AS live FROM r JOIN d ON d.doc_id = r.doc_id WHERE r.k < d.m)))),
steps AS MATERIALIZED (SELECT doc_id, pos, source FROM r WHERE pos > 0),
back AS (SELECT d.doc_id, d.n AS pos FROM d JOIN steps s ON s.doc_id = d.doc_id AND s.pos = d.n UNION ALL SELECT s.doc_id, s.source FROM back b JOIN steps s ON s.doc_id = b.doc_id AND s.pos = b.pos WHERE s.source > 0),
even AS (SELECT doc_id, n, n // {_HIGH} AS q, n % {_HIGH} AS rest FROM d WHERE doc_id NOT IN (SELECT doc_id FROM back)),
grid AS (SELECT doc_id, CASE WHEN i = q AND rest > 0 AND rest < {_LOW} THEN n - {_LOW} ELSE i * {_HIGH} END AS pos FROM (SELECT *, unnest(range(1, q + 1)) AS i FROM even) WHERE NOT (i = q AND rest = 0))
SELECT doc_id, pos AS "end" FROM (SELECT doc_id, pos FROM back JOIN d USING (doc_id) WHERE pos < n UNION ALL SELECT doc_id, pos FROM grid)"""


@query(_VITERBI)
def viterbi_ends(spark, sf_dir):
    """The optimal cuts themselves, with even steps where no cut is possible; the SQL searches place by place."""
    docs = length_ends(table(spark, sf_dir, "documents"), lang="lang", min_length=_LOW, max_length=_HIGH, prior_type="gaussian", split_on_input_newlines=False)
    return each_of(docs, "ends", ["doc_id"], "end").select("doc_id", F.col("end").cast("long").alias("end"))


_GREEDY = f"""WITH RECURSIVE {_places(False)},
r AS (SELECT doc_id, 0::BIGINT AS k, 0::BIGINT AS "end", 0::BIGINT AS before, n FROM d
  UNION ALL SELECT doc_id, k + 1, CASE WHEN top > 0 THEN list_filter(cand, lambda c: c.v = top)[1].pos ELSE least(base + {_LOW}, n) END, base, n
  FROM (SELECT *, coalesce(list_max(list_transform(cand, lambda c: c.v)), 0.0) AS top FROM (SELECT r.doc_id, r.k, r."end" AS base, d.n, list_transform(list_filter(d.places, lambda p: p.pos >= r."end" + {_LOW} AND p.pos <= r."end" + {_HIGH}), lambda p: {{'v': d.w[p.pos - r."end" + 1] * p.x, 'pos': p.pos}}) AS cand
    FROM r JOIN d ON d.doc_id = r.doc_id WHERE r."end" < d.n))),
tails AS (SELECT doc_id, max(k) AS k FROM r GROUP BY doc_id), last AS (SELECT r.doc_id, r.k, r.n - r.before < {_LOW} AS short, b.before AS two FROM r JOIN tails USING (doc_id, k) LEFT JOIN r b ON b.doc_id = r.doc_id AND b.k = r.k - 1)
SELECT r.doc_id, r."end" FROM r JOIN last l ON l.doc_id = r.doc_id WHERE r.k > 0 AND r."end" < r.n AND NOT (r.k = l.k - 1 AND l.short AND r.n - l.two <= {_HIGH})"""


@query(_GREEDY)
def greedy_ends(spark, sf_dir):
    docs = length_ends(table(spark, sf_dir, "documents"), lang="lang", min_length=_LOW, max_length=_HIGH, prior_type="clipped_polynomial", algorithm="greedy", split_on_input_newlines=False)
    return each_of(docs, "ends", ["doc_id"], "end").select("doc_id", F.col("end").cast("long").alias("end"))
