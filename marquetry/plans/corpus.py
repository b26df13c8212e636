"""Corpora: sampling, splitting, balancing, grouping, budgets and packing, as relational plans.

Random choices are by hash of a key, so that they don't depend on partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from ..folders import fresh, is_written, written
from ..functions.text import all_of
from ..resources import NO_PUNCTUATION, NO_WHITESPACE, PUNCTUATION
from .running import running_total


def hash_order(*columns: str, seed: str = "") -> Column:
    """A key whose order is a shuffle: md5 of the columns, which other engines have too."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in columns]))


def kmers(sentences: DataFrame, by: list[str], k: int, order: str = "sent_idx", text: str = "sentence", separator: str = " ", longer_than: int = 0) -> DataFrame:
    """(by, kmer_idx, text): runs of k sentences that don't overlap; a rest shorter than k goes, and so do texts that aren't longer than asked."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = sentences.withColumn("__n", F.row_number().over(w) - 1).withColumn("kmer_idx", F.floor(F.col("__n") / k).cast("long"))
    groups = rows.groupBy(*by, "kmer_idx").agg(F.array_sort(F.collect_list(F.struct("__n", F.col(text).alias("t")))).alias("s"))
    joined = F.array_join(F.transform("s", lambda x: x["t"]), separator)
    return groups.where(F.size("s") == k).select(*by, "kmer_idx", joined.alias("text")).where(F.length("text") > longer_than)


def _with(rows: DataFrame, by: list[str], **values: Column) -> DataFrame:
    """Adds aggregates of each row's group.  Groups are aggregated before they are shuffled, and joined: no task holds a group's rows."""
    sums = rows.groupBy(*by).agg(*[v.alias(n) for n, v in values.items()])
    keys = fresh(rows, *[f"by_{c}" for c in by])
    sums = sums.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)], *values)
    on = all_of([F.col(f"`{c}`").eqNullSafe(F.col(k)) for c, k in zip(by, keys, strict=True)])
    return rows.join(sums, on).drop(*keys)


def sample_kmers(rows: DataFrame, key: list[str], share: float, at_most: int, by: list[str], seed: str = "42") -> DataFrame:
    """round(n share) rows of each group, at most so many, in the order of their hashes."""
    place, rank, n = fresh(rows, "place", "rank", "n")
    ranked = running_total(rows.withColumn(place, hash_order(*key, seed=seed)), by, [place, *key], F.lit(1), rank)
    return _with(ranked, by, **{n: F.count("*")}).where(F.col(rank) <= F.least(F.round(F.col(n) * share), F.lit(at_most))).select(*rows.columns)


def windows_of(sentences: DataFrame, by: list[str], k: int, order: str = "sent_idx", text: str = "sentence", pad: bool = True) -> DataFrame:
    """(by, chunk, sentences): k sentences each, the last filled up with empty ones."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = sentences.withColumn("__n", F.row_number().over(w) - 1).withColumn("chunk", F.floor(F.col("__n") / k).cast("long"))
    groups = rows.groupBy(*by, "chunk").agg(F.array_sort(F.collect_list(F.struct("__n", F.col(text).alias("t")))).alias("s"))
    listed = F.transform("s", lambda x: x["t"])
    if pad:
        listed = F.concat(listed, F.array_repeat(F.lit(""), F.lit(k) - F.size("s")))
    return groups.select(*by, "chunk", listed.alias("sentences"))


def concatenate(chunks: DataFrame, by: list[str], order: str, text: str, delimiter: str) -> DataFrame:
    """(by, text): a group's chunks in order."""
    groups = chunks.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("s"))
    return groups.select(*by, F.array_join(F.transform("s", lambda x: x["t"]), delimiter).alias("text"))


def take(rows: DataFrame, key: list[str], n: int | None = None, share: float | None = None, seed: str = "") -> DataFrame:
    """n rows, or about a share of them, in hash order."""
    if n is not None:
        return rows.orderBy(hash_order(*key, seed=seed), *key).limit(n)
    first = F.conv(F.substring(hash_order(*key, seed=seed), 1, 8), 16, 10).cast("long")
    return rows.where(first < F.lit(int((share or 0) * 2**32)))


def split_off(rows: DataFrame, key: list[str], per_thousand: int, seed: str = "") -> DataFrame:
    """Adds split: valid for about so many rows in a thousand, else train."""
    first = F.conv(F.substring(hash_order(*key, seed=seed), 1, 8), 16, 10).cast("long")
    return rows.withColumn("split", F.when(first % 1000 < per_thousand, "valid").otherwise("train"))


def half_split(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds split: train for the first half (rounded down) of each group, else test."""
    rank, n = fresh(rows, "rank", "n")
    ranked = _with(running_total(rows, by, order, F.lit(1), rank), by, **{n: F.count("*")})
    return ranked.select(*rows.columns, F.when(F.col(rank) <= F.floor(F.col(n) / 2), "train").otherwise("test").alias("split"))


def first_rows(rows: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__rank") <= n).drop("__rank")


def thin_unpunctuated(rows: DataFrame, flag: str, target: float, key: list[str], lang: str = "lang", seed: str = "") -> DataFrame:
    """Drops rows without final punctuation until they are a share of at most target; languages without punctuation are left alone."""
    place, rank, rest = fresh(rows, "place", "rank", "rest")
    rows = rows if is_written(rows) else written(rows)  # they are read three times
    counted = _with(rows, [lang], **{rest: F.count_if(F.col(flag))})
    always = F.col(flag) | F.col(lang).isin(*NO_PUNCTUATION)
    ranked = running_total(counted.where(~always).withColumn(place, hash_order(*key, seed=seed)), [lang], [place, *key], F.lit(1), rank)
    kept = ranked.where(F.col(rank) <= F.floor(F.col(rest) * target / (1 - target))).select(*rows.columns)
    return rows.where(always).unionByName(kept)


def interleave(rows: DataFrame, by: str, order: list[str], restart: bool = False) -> DataFrame:
    """Adds turn: sources take turns, in the order of their names; with restart, exhausted ones begin anew until the longest ends."""
    ranked = running_total(rows, [by], order, F.lit(1).cast("long"), "turn")
    if not restart:
        return ranked
    n, copy = fresh(ranked, "n", "copy")
    longest = rows.groupBy(by).count().agg(F.max("count")).first()[0] or 0
    ranked = _with(ranked, [by], **{n: F.count("*")})
    copies = F.sequence(F.lit(0).cast("long"), F.floor((F.lit(longest) - F.col("turn")) / F.col(n)))
    return ranked.withColumn(copy, F.explode(copies)).withColumn("turn", F.col("turn") + F.col(copy) * F.col(n)).drop(copy, n)


def upsample(rows: DataFrame, by: list[str], goal: int) -> DataFrame:
    """Groups of fewer rows than the goal are repeated goal // n + 1 times; adds copy."""
    (n,) = fresh(rows, "n")
    times = F.when(F.col(n) < goal, F.floor(F.lit(goal) / F.col(n)) + 1).otherwise(F.lit(1)).cast("int")
    return _with(rows, by, **{n: F.count("*")}).withColumn("copy", F.explode(F.sequence(F.lit(1), times))).drop(n)


def oversample_unspaced(rows: DataFrame, times: int, lang: str = "lang") -> DataFrame:
    """Rows of languages without white space, so many times."""
    n = F.when(F.col(lang).isin(*NO_WHITESPACE), F.lit(times)).otherwise(F.lit(1))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), n)))


def prefer(rows: DataFrame, by: list[str], column: str, order: list[str]) -> DataFrame:
    """Rows of the first source, in the given order of preference, that a group has."""
    rank, best = fresh(rows, "rank", "best")
    found = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col(column)), F.lit(0))
    ranked = rows.withColumn(rank, F.when(found == 0, F.lit(len(order) + 1)).otherwise(found))
    return _with(ranked, by, **{best: F.min(rank)}).where(F.col(rank) == F.col(best)).drop(rank, best)


def expand_mixed(rows: DataFrame, lang: str = "lang") -> DataFrame:
    """A row of a mixed language a-b becomes two, a-b_A and a-b_B."""
    parts = F.split(F.col(lang), "-")
    names = F.when(F.size(parts) > 1, F.transform(parts, lambda p: F.concat(F.col(lang), F.lit("_"), F.upper(p)))).otherwise(F.array(F.col(lang)))
    return rows.withColumn(lang, F.explode(names))


def groups(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, n): the groups that occur; empty combinations don't."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def union_shuffled(parts: dict[str, DataFrame], key: list[str], seed: str = "") -> DataFrame:
    """All rows with their source as ``dataset``, and ``place``, a hash by which they are in random order."""
    out = None
    for name, df in parts.items():
        df = df.withColumn("dataset", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.withColumn("place", hash_order("dataset", *key, seed=seed))


def collect_subsets(rows: DataFrame, subsets: dict[str, list[str]], by: list[str], column: str = "dataset") -> DataFrame:
    """Rows with the names of the unions that their dataset belongs to, a row for each; datasets in no union go."""
    pairs = rows.sparkSession.createDataFrame([(d, name) for name, members in subsets.items() for d in members], f"{column} string, subset string")
    return rows.join(F.broadcast(pairs), column)  # as many rows as the caller listed


def with_several(rows: DataFrame, by: list[str], at_least: int = 2) -> DataFrame:
    """Rows of groups with at least so many."""
    (n,) = fresh(rows, "n")
    return _with(rows, by, **{n: F.count("*")}).where(F.col(n) >= at_least).drop(n)


def char_budget(rows: DataFrame, by: list[str], order: list[str], budget: int, text: str = "text") -> DataFrame:
    """Rows until the budget is reached, the one that reaches it included; only lengths are summed."""
    n = F.coalesce(F.length(text), F.lit(0)).cast("long")
    total = running_total(rows.select(*by, *order, n.alias("__n")), by, order, F.col("__n"), "__total")
    return rows.join(total.where(F.col("__total") - F.col("__n") < budget).select(*by, *order), [*by, *order], "left_semi")


def missing(rows: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows that aren't done yet."""
    return rows.join(done.select(*key).distinct(), key, "left_anti")


def few_shot_prompt(rows: DataFrame, by: list[str], order: list[str], n: int, question: str = "sentence", instruction: str = "Separate the sentences:") -> DataFrame:
    """(by, prompt): the instruction and a group's first n examples."""
    first = first_rows(rows, by, order, n).withColumn("__o", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    shots = concatenate(first.withColumn("__s", F.concat(F.lit("# "), F.col("__o").cast("string"), F.lit("\n"), F.col(question))), by, "__o", "__s", "\n")
    return shots.select(*by, F.concat(F.lit(f"{instruction}\n"), F.col("text")).alias("prompt"))


def length_statistics(rows: DataFrame, by: list[str], text: str = "sentence", at_least: int = 10, group_at_least: int = 100) -> DataFrame:
    """(by, target_length, spread, n, min, max) of lengths: median, and the quartiles' distance / 1.35 but 10 at least, as whole numbers."""
    n = F.length(text)
    out = rows.where(n > 0).groupBy(*by).agg(F.count("*").alias("n"), F.min(n).cast("long").alias("min"), F.max(n).cast("long").alias("max"), *[F.percentile(n, q).alias(f"q{k}") for k, q in enumerate((0.25, 0.5, 0.75))])
    spread = F.greatest(F.floor((F.col("q2") - F.col("q0")) / 1.35), F.lit(10))
    return out.where(F.col("n") >= max(at_least, group_at_least)).select(*by, F.floor("q1").cast("long").alias("target_length"), spread.cast("long").alias("spread"), "n", "min", "max")


def token_blocks(rows: DataFrame, by: list[str], order: list[str], block: int, text: str = "text", overflow: int = 0) -> DataFrame:
    """(by, block, doc order, start, length): which characters of which row are in which block, if rows are joined and cut every so many.

    A block goes on for overflow characters into the next one.  A rest shorter than a block goes.  Only lengths are summed; texts stay where they are.
    """
    n = F.coalesce(F.length(text), F.lit(0)).cast("long")
    placed = running_total(rows.select(*by, *order, n.alias("n")), by, order, F.col("n"), "after").withColumn("begin", F.col("after") - F.col("n"))
    placed = _with(placed, by, total=F.sum("n"))
    first = F.greatest(F.floor((F.col("begin") - overflow) / block), F.lit(0).cast("long"))
    last = F.floor((F.col("after") - 1) / block)
    blocks = placed.where("n > 0").withColumn("block", F.explode(F.sequence(first, last)))
    edge = (F.col("block") + 1) * block + overflow
    start = F.greatest(F.col("block") * block - F.col("begin"), F.lit(0))
    end = F.least(edge - F.col("begin"), F.col("n"))
    return blocks.where(edge <= F.col("total")).where(end > start).select(*by, *order, "block", start.alias("start"), (end - start).alias("length"))


def sentence_end_labels(sentences: list[str], encode, separators: list[str], first: int = 0, last: int = 2) -> tuple[list[int], list[int]]:
    """Ids and labels of the text that sentences make: 1 for the last token of each, 0 for others and for the special tokens around them.

    encode: text -> (token ids, where each begins).  separators: what stands before each sentence but the first.
    """
    text, ends = "", []
    for k, s in enumerate(sentences):
        text += (separators[k] if k else "") + s
        ends.append(len(text) - 1)
    ids, starts = encode(text)
    labels = np.zeros(len(ids), np.int64)
    following = np.searchsorted(np.asarray(starts), np.array(ends), "right")  # the first token after each sentence
    labels[following[following > 0] - 1] = 1
    return [first, *np.asarray(ids).tolist(), last], [0, *labels.tolist(), 0]


#: Sentences that one task packs at a time; blocks go on across its edges.
STRETCH = 50_000
#: If set, blocks end after so many sentences of a group.
PACKED_TOGETHER: int | None = None


def pack_sentences(sentences: DataFrame, by: list[str], order: list[str], block: int, encode, text: str = "sentence", reserve: int = 4, separator: str = " ", p_add: float = 1.0, p_flip: float = 0.0, seed: int = 0) -> DataFrame:
    """(by, block_id, input_ids, attention_mask, labels): sentences packed greedily into blocks of less than block - reserve tokens.

    encode: see sentence_end_labels().  Padding has id 0, mask 0 and label -100.  Empty and purely numeric sentences, and ones longer than a
    block, are left out.  p_add: chance that a sentence which fits is added, and doesn't begin a new block.  p_flip: chance that a sentence that ends in a
    mark is followed by the other separator (a blank, or none).  Draws depend on seed, group and place.

    No task holds a group, and yet a group is packed from its first sentence to its last: what a stretch of STRETCH sentences does only depends on how
    full the open block is, and whether it ends in a mark.  Each stretch is followed for all of these states at once, which soon become one; then the states
    are carried through the stretches, and sentences get their blocks.
    """
    room = block - reserve
    marks = set(PUNCTUATION)
    other = "" if separator else " "
    together = PACKED_TOGETHER

    def steps(t: pa.Table) -> Iterator[tuple[int, int, int, int, int, bool, bool]]:
        """(place, tokens alone, after the separator, after the other one, whether a mark ends it, whether it may be added, whether a mark flips)."""
        rng = np.random.default_rng([seed, int(t["group"][0].as_py()) & (2**63 - 1), int(t["rank"][0].as_py())])
        for i, s in enumerate(t[text].to_pylist()):
            draw, flip = rng.random(2)
            if not s or s.isnumeric() or not (alone := len(encode(s)[0])):
                continue
            yield i, alone, len(encode(separator + s)[0]), len(encode(other + s)[0]) if p_flip > 0 else 0, int(s[-1] in marks), draw <= p_add, flip < p_flip

    def follow(t: pa.Table) -> pa.Table:
        t = t.sort_by("rank")
        state = np.arange(2 * room + 2)  # twice the tokens of the open block, and 1 if a mark ends it
        of, begun = np.arange(len(state)), np.zeros(len(state), np.int64)
        count, mark = state >> 1, state & 1
        for k, (_, alone, n, m, ends, add, flip) in enumerate(steps(t)):
            full = count + np.where(count == 0, alone, np.where(mark * flip == 1, m, n))
            fits = (full < room) & ((count == 0) | add)
            begun = begun + (np.where(fits, count == 0, alone <= room))[of]
            count = np.where(fits, full, alone if alone <= room else 0)
            mark = np.where(count > 0, ends, 0)
            if k % 16 == 0 and len(count) > 1:
                left, back = np.unique(2 * count + mark, return_inverse=True)
                of, count, mark = back[of], left >> 1, left & 1
        return pa.table({"group": t["group"][:1], "stretch": t["stretch"][:1], "after": pa.array([(2 * count + mark)[of].tolist()], pa.list_(pa.int32())), "begun": pa.array([begun.tolist()], pa.list_(pa.int32()))})

    def carry(t: pa.Table) -> pa.Table:
        t = t.sort_by("stretch")
        state, base, states, bases = 0, 0, [], []
        for after, begun in zip(t["after"], t["begun"], strict=True):
            state = state if together is None else 0
            states.append(state)
            bases.append(base)
            base, state = base + begun[state].as_py(), after[state].as_py()
        return pa.table({"g": t["group"], "s": t["stretch"], "state": pa.array(states, pa.int32()), "base": pa.array(bases, pa.int64())})

    def place(t: pa.Table) -> pa.Table:
        t = t.sort_by("rank")
        state, at = t["state"][0].as_py(), t["base"][0].as_py() - 1
        count, mark = state >> 1, state & 1
        rows, blocks, gaps = [], [], []
        for i, alone, n, m, ends, add, flip in steps(t):
            full = count + (alone if count == 0 else m if mark and flip else n)
            if full < room and (count == 0 or add):
                gaps.append(other if count and mark and flip else separator)
                at, count = at + (count == 0), full
            elif alone > room:
                count = 0
                continue
            else:
                gaps.append(separator)
                at, count = at + 1, alone
            mark = ends
            rows.append(i)
            blocks.append(at)
        kept = t.select([*by, "group", "rank", text]).take(pa.array(rows, pa.int64()))
        return kept.append_column("block_id", pa.array(blocks, pa.int64())).append_column("gap", pa.array(gaps, pa.string()))

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("rank")
        ids = t["block_id"].to_numpy()
        edges = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])).tolist()
        texts, gaps = t[text].to_pylist(), t["gap"].to_pylist()
        coded = [sentence_end_labels(texts[a:b], encode, gaps[a:b]) for a, b in zip(edges, [*edges[1:], len(texts)], strict=True)]
        pad = [block - len(i) for i, _ in coded]
        rows = {c: t[c].take(pa.array(edges, pa.int64())) for c in by}
        rows |= {
            "block_id": pa.array(ids[edges], pa.int64()),
            "input_ids": pa.array([i + [0] * p for (i, _), p in zip(coded, pad, strict=True)], pa.list_(pa.int32())),
            "attention_mask": pa.array([[1] * len(i) + [0] * p for (i, _), p in zip(coded, pad, strict=True)], pa.list_(pa.int32())),
            "labels": pa.array([x + [-100] * p for (_, x), p in zip(coded, pad, strict=True)], pa.list_(pa.int32())),
        }
        return pa.table(rows)

    ints = ArrayType(IntegerType())
    keys = sentences.select(*by).schema
    schema = StructType([*keys.fields]).add("block_id", "long").add("input_ids", ints).add("attention_mask", ints).add("labels", ints)
    placed = StructType([*keys.fields]).add("group", "long").add("rank", "long").add(text, "string").add("block_id", "long").add("gap", "string")
    ranked = running_total(sentences.select(*dict.fromkeys([*by, *order, text])), by, order, F.lit(1), "rank")
    stretches = ranked.select(*by, text, "rank", F.xxhash64(*by).alias("group"), F.floor((F.col("rank") - 1) / (together or STRETCH)).alias("stretch"))
    followed = stretches.groupBy("group", "stretch").applyInArrow(follow, "group long, stretch long, after array<int>, begun array<int>")
    entries = followed.groupBy("group").applyInArrow(carry, "g long, s long, state int, base long")  # a row for each stretch
    entered = stretches.join(F.broadcast(entries), (F.col("group") == F.col("g")) & (F.col("stretch") == F.col("s"))).drop("g", "s")
    found = entered.groupBy("group", "stretch").applyInArrow(place, placed)
    return found.groupBy("group", F.floor(F.col("block_id") / 1000)).applyInArrow(lambda key, t: build(t), schema)


_CLASS = np.zeros(max(map(ord, PUNCTUATION)) + 2, np.int64)
_CLASS[[10, *map(ord, PUNCTUATION)]] = np.arange(1, len(PUNCTUATION) + 2)


def corrupt_training(rows: DataFrame, key: str, text: str = "text", newline_rate: float = 1.0, mark_rate: float = 0.5, space_rate: float = 0.0, seed: int = 0) -> DataFrame:
    """(key, text, labels): line breaks, and marks, are deleted at the given rates while labels stay aligned.

    A character's label is the first class among the deleted characters that follow it and the next one that stays.  A text's first character
    isn't deleted if it is a mark.  A line break becomes a blank instead at space_rate.  Draws are digits of md5 hashes of seed, key and place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, labels = [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                cp = np.frombuffer((t or "").encode("utf-32-le"), np.uint32).copy()
                own = _CLASS[np.minimum(cp, len(_CLASS) - 1)]
                stays = np.ones(len(cp), bool)
                kept = False  # whether a character before stays
                at = 0
                for i in np.flatnonzero(own).tolist():
                    kept = kept or i > at
                    draw = hashlib.md5(f"{seed}:{'' if k is None else k}:{i}".encode()).digest()
                    if own[i] == 1 and int.from_bytes(draw[:4]) < newline_rate * 2**32:
                        if int.from_bytes(draw[4:8]) < space_rate * 2**32:
                            cp[i] = 32
                            kept = True
                        else:
                            stays[i] = False
                    elif own[i] > 1 and kept and int.from_bytes(draw[:4]) < mark_rate * 2**32:
                        stays[i] = False
                    else:
                        kept = True
                    at = i + 1
                left = np.flatnonzero(stays)
                # the first place with a class after each character that stays; it counts if no other character stays before it
                classed = np.append(np.flatnonzero(own), len(cp))
                first = classed[np.searchsorted(classed, left + 1)]
                following = np.append(left[1:], len(cp))
                found = np.where((first <= following) & (first < len(cp)), own[np.minimum(first, max(0, len(cp) - 1))], 0) if len(cp) else own
                texts.append(cp[left].tobytes().decode("utf-32-le"))
                labels.append(found.astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(labels, pa.list_(pa.int32()))], ["key", "text", "labels"])

    return rows.select(F.col(key).cast("long"), text).mapInArrow(run, "key long, text string, labels array<int>").withColumnRenamed("key", key)


def check_sentences(rows: DataFrame, text: str = "sentence") -> DataFrame:
    """Rows whose sentence has a line break inside, which adaptation data mustn't have."""
    return rows.where(F.col(text).contains("\n"))


def require_clean(rows: DataFrame, text: str = "sentence") -> None:
    if not check_sentences(rows, text).isEmpty():
        raise ValueError("sentences must not contain line breaks")
