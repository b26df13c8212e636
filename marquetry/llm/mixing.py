"""Mixing sources to target weights by weighted fair queueing.

Documents of a source are shuffled by ``md5(seed:doc_id)``.  A document's virtual finish time is the source's tokens up to
and with it, divided by the source's weight.  All documents are sorted by finish time, and those stay whose running total of
tokens is within the budget.  Texts are read once, to count tokens; both running totals are over rows of numbers, in range partitions
each of whose sum is carried to those after it.  A hot source is thus spread over many tasks.

Cases: a null source is a source of its own.  Sources without a listed weight have ``DEFAULT_WEIGHT``; a source whose weight
is 0 or less gives nothing.  A token is a run of characters that aren't space, tab or line break; a null text has none.
Null ids sort first.  Rows that repeat an id and a token count are interchangeable and keep places of their own.  Ties in
finish time go by shuffle key, source, id and tokens.  An empty table gives an empty result.  Further columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.running import running_total
from ._spark import fresh, table, written

WEIGHTS = {"src0": 2.0, "src1": 4.0, "src2": 3.0, "src3": 0.5}
DEFAULT_WEIGHT = 1.0
BUDGET_SHARE = 0.6
SEED = "mix1"


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\r\\n]+")), F.lit(0)).cast("long")


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    default_weight: float = DEFAULT_WEIGHT,
    budget_share: float = BUDGET_SHARE,
    seed: str = SEED,
) -> DataFrame:
    """(doc_id, source, tokens, finish, total): the documents within the budget; total is the running sum that orders them.

    The budget is budget_share of the tokens of all sources with a weight, rounded down.
    """
    return _mixed(docs, {}, weights, default_weight, budget_share, seed)


def _weight(weights: dict[str, float] | None, default_weight: float) -> Column:
    weight = F.lit(float(default_weight))
    for name, w in (WEIGHTS if weights is None else weights).items():
        weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    return weight


def _mixed(docs: DataFrame, carry: dict[str, Column], weights, default_weight: float, budget_share: float, seed: str) -> DataFrame:
    rows = docs.select(
        F.col("doc_id"), F.col("source"), token_count(F.col("text")).alias("tokens"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key"),
        _weight(weights, default_weight).alias("weight"), *[c.alias(n) for n, c in carry.items()],
    ).where("weight > 0")
    extra = list(carry)
    order = ["key", "doc_id", "tokens", *extra]
    queued = running_total(rows, ["source"], order, F.col("tokens"), "queued").withColumn("finish", F.col("queued") / F.col("weight"))
    total = running_total(queued.drop("queued", "weight"), [], ["finish", "key", "source", "doc_id", "tokens", *extra], F.col("tokens"), "total")
    total = written(total)
    budget = (total.agg(F.sum("tokens")).first()[0] or 0) * budget_share
    return total.where(F.col("total") <= F.lit(int(budget))).select("doc_id", "source", "tokens", "finish", "total", *extra)


def mixed_documents(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = DEFAULT_WEIGHT, budget_share: float = BUDGET_SHARE, seed: str = SEED) -> DataFrame:
    """All columns of the documents that mix() keeps, with its tokens, finish and total as mix_tokens, mix_finish and mix_total.

    Copies of one row, equal in all columns, get a place each.  Columns that have these three names already are replaced.
    """
    docs = docs.drop("mix_tokens", "mix_finish", "mix_total")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    row_hash = F.xxhash64(*[F.to_json(F.struct(c)) if "map<" in kind or "variant" in kind else c for c, (_, kind) in zip(columns, docs.dtypes, strict=True)])
    own, own_id, row, id_ = fresh(docs, "own_hash", "own_id", "mixed_hash", "mixed_id")
    plan = _mixed(docs, {"row": row_hash}, weights, default_weight, budget_share, seed)
    plan = plan.select(F.col("row").alias(row), F.hash("doc_id").alias(id_), F.col("tokens").alias("mix_tokens"), F.col("finish").alias("mix_finish"), F.col("total").alias("mix_total"))
    docs = docs.withColumns({own: row_hash, own_id: F.hash("doc_id")})
    same = (F.col(own) == F.col(row)) & (F.col(own_id) == F.col(id_))
    out = [*columns, "mix_tokens", "mix_finish", "mix_total"]
    again = plan.groupBy(row, id_).count().where("count > 1").drop("count")
    if again.isEmpty():
        return docs.join(plan.hint("shuffle_hash"), same).select(out)
    # of equal rows, which can be many, one is joined with the places of all
    once = docs.join(plan.join(again, [row, id_], "left_anti").hint("shuffle_hash"), same).select(out)
    many = docs.join(again.hint("shuffle_hash"), same, "left_semi").dropDuplicates([own, own_id])
    return once.unionByName(many.join(plan.join(again, [row, id_], "left_semi"), same).select(out))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


_CASES = " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in WEIGHTS.items())
OP8_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \\t\\r\\n]+')), 0)::BIGINT AS tokens,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS key, CASE source {_CASES} ELSE {DEFAULT_WEIGHT!r}::DOUBLE END AS weight
  FROM documents),
q AS (
  SELECT *, (sum(tokens) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, tokens ROWS UNBOUNDED PRECEDING))::BIGINT / weight AS finish
  FROM d WHERE weight > 0),
t AS (
  SELECT *, (sum(tokens) OVER (ORDER BY finish, key, source NULLS FIRST, doc_id NULLS FIRST, tokens ROWS UNBOUNDED PRECEDING))::BIGINT AS total FROM q)
SELECT doc_id, source, tokens, finish, total FROM t
WHERE total <= floor((SELECT sum(tokens) FROM t)::DOUBLE * {BUDGET_SHARE!r})
"""
