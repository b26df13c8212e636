"""Near-duplicate groups: SimHash fingerprints searched with the recursion of May and Ozerov.

1. Each text becomes a 256-bit SimHash of its distinct word pairs.  Equal fingerprints are one node.
2. In each repetition the coordinates are permuted into strips and flipped by a random vector.  On a
   strip a fingerprint is filtered by partial weight: it joins the list of centre ``z`` if the weight
   of ``(x xor z)`` on the strip is at most 1.  The centres are the words of a Hamming code, whose
   balls of radius 1 tile the strip, so that each fingerprint passes exactly one filter.  Each list is
   filtered again on the next strip until lists are small.
3. Lists are searched by brute force: any two fingerprints of a list that differ in at most ``radius`` bits are joined.
   A list of more than ``LARGE_LIST`` is cut into blocks, and each two blocks are searched in a task of their own, so that no task
   holds a hot list and nothing in it is left out.  Repetitions are as many as the target recall needs for pairs at the radius.
4. Connected groups are labelled with their least id.

Cases: a null text, and a text without any word, has no fingerprint and is in no group.  Rows with a null ``doc_id``
are in no group either, and stay.  Of a group one row stays, the one with the least ``doc_id``, of rows that repeat this id the one with the
least hash of its text, and of equal ones any.  Rows that repeat an id with different texts are judged each by its own text.
Columns besides ``doc_id`` and ``text`` aren't read.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import _flat
from ._spark import discard, fresh, table, written

BITS = 256
RADIUS = 58
SHINGLE = 2
RECALL = 0.96
#: Strips are added until lists hold this many fingerprints on average at most.
LIST_SIZE = 2048
#: A list with more fingerprints than this is searched in blocks of so many.
LARGE_LIST = 16384
#: Check bits of the Hamming codes: of the first strip (15 coordinates, 11 bits of key), and of further ones by their bits of key.
_FIRST, _NEXT = 4, {4: 3, 1: 2}
_SEED = 5
_SALTS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89], np.uint64)


def fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> list[bytes | None]:
    """SimHash of each lower-case text; None for one without words."""
    out: list[bytes | None] = []
    for low, high in _flat.slices(texts):
        hashes, first = _flat.words(*_flat.utf8(texts.slice(low, high - low)))
        hashes, starts = _flat.distinct(*_flat.shingles(hashes, first, shingle))
        n = np.diff(starts)
        bits = [2 * _flat.bit_counts(_flat.mix(hashes ^ salt), starts) > n[:, None] for salt in _SALTS]
        packed = np.packbits(np.concatenate(bits, axis=1), axis=1)
        out += [x.tobytes() if k else None for x, k in zip(packed, n, strict=True)]
    return out


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, h, fp) for every row with words: h is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fingerprints(b.column(2), shingle), pa.binary())], ["doc_id", "h", "fp"])

    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.lower("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, h long, fp binary").where("fp is not null")


def _code(checks: int) -> np.ndarray:
    """For each value of a strip, the number of the code word within distance 1."""
    n = 2**checks - 1
    values = np.arange(1 << n)
    syndrome = np.zeros(1 << n, np.int64)
    for i in range(n):
        syndrome ^= np.where(values >> i & 1, i + 1, 0)
    word = values ^ np.where(syndrome > 0, 1 << np.maximum(syndrome - 1, 0), 0)
    return np.unique(word, return_inverse=True)[1]


def same_list(differing: int, checks: list[int]) -> float:
    """Chance that two vectors that differ in so many of all bits share their code word on each of the strips.

    Strips are drawn without replacement.  Two words of a strip of n bits that differ in none of them have one code word, those that
    differ in one or in two bits have it with 2 / (n + 1), others never.
    """
    ways = np.ones(1)
    for n in (2**c - 1 for c in checks):
        ways = np.convolve(ways, [1, 2 * n / (n + 1), n * (n - 1) / (n + 1)])
    rest = BITS - sum(2**c - 1 for c in checks)
    return sum(float(w) * math.comb(rest, differing - k) / math.comb(BITS, differing) for k, w in enumerate(ways) if k <= differing)


def _repetitions(recall: float, chance: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - chance)) if chance < 1 else 1


def plan(n_nodes: int, recall: float = RECALL, radius: int = RADIUS, list_size: int = LIST_SIZE) -> tuple[list[int], int]:
    """Check bits of each strip's code, and repetitions, for so many fingerprints."""
    checks, bits = [_FIRST], 11
    more = max(0, math.ceil(math.log2(max(1, n_nodes) / list_size)) - bits)
    more = min(more, 36)  # keys have 63 bits, of which repetitions need 16
    checks += [_NEXT[4]] * (more // 4) + [_NEXT[1]] * (more % 4)
    return checks, _repetitions(recall, same_list(radius, checks))


def filter_keys(packed: np.ndarray, checks: list[int], repetition: int) -> np.ndarray:
    """The list that each fingerprint (uint8 [n, 32]) reaches in a repetition."""
    rng = np.random.default_rng([_SEED, repetition])
    order, flips = rng.permutation(BITS), rng.integers(0, 2, BITS).astype(np.uint8)
    key = np.full(len(packed), repetition, np.int64)
    at = 0
    for c in checks:
        width = 2**c - 1
        value = np.zeros(len(packed), np.int64)
        for j, coordinate in enumerate(order[at : at + width]):
            bit = packed[:, coordinate >> 3] >> (7 - (coordinate & 7)) & 1 ^ flips[coordinate]
            value |= bit.astype(np.int64) << j
        key = (key << (width - c)) | _CODES[c][value]
        at += width
    return key


_CODES = {c: _code(c) for c in (_FIRST, *_NEXT.values())}


def _joined(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels, each the least place of its group, after the groups of i and j have become one."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return labels
        a, b, i, j = a[apart], b[apart], i[apart], j[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (labels[labels] != labels).any():
            labels = labels[labels]


def near_edges(fps: np.ndarray, ids: np.ndarray, starts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For lists that follow each other (starts: n + 1 indices), edges that join all fingerprints within the radius.

    All pairs of a list are compared.  Short lists are compared all at once, and their pairs are the edges; of a longer
    one each group's members are joined with its first, as pairs inside a dense group can be many.
    """
    a, b = [], []
    sizes = np.diff(starts)
    most = fps.shape[1] - 1  # nearly all pairs differ in more bits than the radius in all words but the last
    short = np.repeat(sizes <= 24, sizes)
    list_of = np.repeat(np.arange(len(sizes)), sizes)
    for step in range(1, int(min(24, sizes.max(initial=0)))):
        at = np.flatnonzero(short[:-step] & (list_of[:-step] == list_of[step:]))
        if len(at) == 0:
            break
        at = at[np.bitwise_count(fps[at, :most] ^ fps[at + step, :most]).sum(axis=1, dtype=np.int64) <= radius]
        close = np.bitwise_count(fps[at] ^ fps[at + step]).sum(axis=1, dtype=np.int64) <= radius
        a.append(ids[at[close]])
        b.append(ids[at[close] + step])
    for k in np.flatnonzero(sizes > 24):
        own, n = fps[starts[k] : starts[k + 1]], int(sizes[k])
        words = np.ascontiguousarray(own[:, :most].T)
        labels, rows, big = np.arange(n), max(1, (1 << 17) // n), None
        for low in range(0, n, rows):
            tile, later = np.arange(low, min(low + rows, n)), np.arange(low, n)
            if big is None:
                parts = [(tile, later, words[:, low:])]
            else:  # a large group's members needn't be compared with each other
                inside, outside = labels[tile] == big, later[labels[low:] != big]
                parts = [(tile[~inside], later, words[:, low:]), (tile[inside], outside, words[:, outside])]
            for own_rows, others, theirs in parts:
                if len(own_rows) == 0 or len(others) == 0:
                    continue
                mine = words[:, own_rows]
                differ = np.bitwise_count(mine[0, :, None] ^ theirs[0])
                for x, y in zip(mine[1:], theirs[1:]):
                    differ += np.bitwise_count(x[:, None] ^ y)
                i, j = np.divmod(np.flatnonzero(differ.ravel() <= radius), len(others))
                i, j = own_rows[i], others[j]
                apart = (i < j) & (labels[i] != labels[j])
                i, j = i[apart], j[apart]
                if len(i) == 0:
                    continue
                close = np.bitwise_count(own[i] ^ own[j]).sum(axis=1, dtype=np.int64) <= radius
                labels = _joined(labels, i[close], j[close])
                if n > 1024:
                    members = np.bincount(labels)
                    big = int(members.argmax()) if members.max() > n // 8 else None
        member = np.flatnonzero(labels != np.arange(n))
        a.append(ids[starts[k] + labels[member]])
        b.append(ids[starts[k] + member])
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y = np.concatenate(a), np.concatenate(b)
    return np.minimum(x, y), np.maximum(x, y)


_ROWS = "key long, id long, fp binary"


def _searched(lists: DataFrame, radius: int, large: int | None) -> DataFrame:
    """(key, id, other, fp) from lists (key, id, fp): edges between id and other, whose key is null; and the rows of lists with more than large members."""
    names = ["key", "id", "other", "fp"]

    def found(keys: np.ndarray, ids: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        edges = np.unique(np.stack(near_edges(fps.view(np.uint64).reshape(-1, BITS // 64), ids, starts, radius), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.nulls(len(edges), pa.int64()), pa.array(edges[:, 0]), pa.array(edges[:, 1]), pa.nulls(len(edges), pa.binary())], names)

    def put_off(keys: np.ndarray, ids: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array([x.tobytes() for x in fps], pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held, hot = 0, None  # rows kept, and the key of the large list that is passed on
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            fps = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, BITS // 8)
            if hot is not None:
                cut = int(np.searchsorted(keys, hot, "right"))
                if cut:
                    yield put_off(keys[:cut], ids[:cut], fps[:cut])
                if cut == len(keys):
                    continue
                keys, ids, fps, hot = keys[cut:], ids[cut:], fps[cut:], None
            kept.append((keys, ids, fps))
            held += len(keys)
            if kept[0][0][0] == keys[-1]:  # one list so far: it may go on
                if large is not None and held > large:
                    hot = int(keys[-1])
                    for x in kept:
                        yield put_off(*x)
                    kept, held = [], 0
                continue
            keys, ids, fps = (np.concatenate(x) for x in zip(*kept, strict=True))
            cut = int(np.searchsorted(keys, keys[-1]))
            kept, held = [(keys[cut:], ids[cut:], fps[cut:])], len(keys) - cut
            yield from whole(keys[:cut], ids[:cut], fps[:cut])
        if kept:
            yield from whole(*(np.concatenate(x) for x in zip(*kept, strict=True)))

    def whole(keys: np.ndarray, ids: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Lists that are here from beginning to end."""
        if large is not None:
            _, place, sizes = np.unique(keys, return_inverse=True, return_counts=True)
            big = sizes[place] > large
            if big.any():
                yield put_off(keys[big], ids[big], fps[big])
                keys, ids, fps = keys[~big], ids[~big], fps[~big]
        if len(keys):
            yield found(keys, ids, fps)

    return lists.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, id long, other long, fp binary")


def _in_blocks(rows: DataFrame, large: int) -> DataFrame:
    """The rows (key, id, fp) of large lists, sent to every pair of blocks that their own block is in; key names list and pair."""
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / large).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = rows.join(sizes, "key").select("key", "id", "fp", own.alias("own"), other)
    return pairs.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "id", "fp")


def pairs(nodes: DataFrame, n_nodes: int, radius: int = RADIUS, recall: float = RECALL, large: int = LARGE_LIST) -> DataFrame:
    """(a, b), a < b: edges that connect the fingerprints (id, fp) within the radius.  They are in a written table."""
    checks, repetitions = plan(n_nodes, recall, radius)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 4096):
                ids, fps = b.column(0).slice(low, 4096), b.column(1).slice(low, 4096)
                packed = np.frombuffer(b"".join(fps.to_pylist()), np.uint8).reshape(-1, BITS // 8)
                for r in range(repetitions):
                    yield pa.RecordBatch.from_arrays([pa.array(filter_keys(packed, checks, r)), ids, fps], ["key", "id", "fp"])

    found = written(_searched(nodes.select("id", "fp").mapInArrow(emit, _ROWS), radius, large))
    edges = found.where("key is null").select(F.col("id").alias("a"), F.col("other").alias("b"))
    hot = found.where("key is not null").select("key", "id", "fp")
    if not hot.isEmpty():
        edges = edges.union(_searched(_in_blocks(hot, large), radius, None).select(F.col("id").alias("a"), F.col("other").alias("b")))
    out = written(edges.distinct())
    discard(found)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(id, root): for each end of an edge the least id of its connected group.

    Alternates the large-star and small-star steps; the edges of each round are written.
    """

    def stats(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    before = stats(edges)
    first = edges
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # each b hangs on smaller ids only
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b")
        star = small.select(F.col("m").alias("a"), "b").union(small.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()
        last, edges = edges, written(star)
        if last is not first:
            discard(last)
        now = stats(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("id"), F.col("a").alias("root"))
    return roots.union(edges.select(F.col("a").alias("id"), F.col("a").alias("root"))).distinct()


def _judged(docs: DataFrame, radius: int, recall: float, shingle: int) -> DataFrame:
    """(doc_id, h, n, kept_id, kept_h) for each id and text of the groups of several rows: how many rows have both, and those of the row that stays."""
    marked = written(with_fingerprints(docs, shingle))
    nodes = marked.groupBy("fp").agg(F.min(F.struct("doc_id", "h")).alias("first"), F.count("*").alias("n"))
    nodes = written(nodes.withColumn("id", F.monotonically_increasing_id()))
    edges = pairs(nodes, nodes.count(), radius, recall)
    roots = components(edges)
    grouped = nodes.join(roots, "id", "left").where("n > 1 or root is not null").select("fp", "first", F.coalesce("root", "id").alias("root"))
    kept = grouped.groupBy("root").agg(F.min("first").alias("kept"))
    kept = grouped.join(kept, "root").select("fp", "kept")
    rows = marked.join(kept, "fp").groupBy("doc_id", "h", F.col("kept.doc_id").alias("kept_id"), F.col("kept.h").alias("kept_h")).agg(F.count("*").alias("n"))
    out = written(rows)
    discard(marked, nodes, edges)
    return out


def _stays() -> Column:
    return (F.col("doc_id") == F.col("kept_id")) & (F.col("h") == F.col("kept_h"))


def duplicates(docs: DataFrame, radius: int = RADIUS, recall: float = RECALL, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, duplicate_of): every row that goes, once for each id and text, with the id of the row of its group that stays."""
    rows = _judged(docs, radius, recall, shingle).where(~_stays() | (F.col("n") > 1))
    return rows.select("doc_id", F.col("kept_id").alias("duplicate_of"))


def drop_duplicates(docs: DataFrame, radius: int = RADIUS, recall: float = RECALL, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs without those that duplicates() lists; all columns stay as they are."""
    own_id, own_h, gone_id, gone_h = fresh(docs, "own_id", "own_h", "gone_id", "gone_h")
    judged = _judged(docs, radius, recall, shingle)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumns({own_id: F.col("doc_id").cast("long"), own_h: F.xxhash64("text")})

    def of(rows: DataFrame) -> tuple[DataFrame, Column]:
        # null ids match nothing; their texts spread them over the tasks
        return rows.select(F.col("doc_id").alias(gone_id), F.col("h").alias(gone_h)).hint("shuffle_hash"), (F.col(own_id) == F.col(gone_id)) & (F.col(own_h) == F.col(gone_h))

    again = judged.where(_stays() & (F.col("n") > 1))
    if again.isEmpty():
        return keyed.join(*of(judged.where(~_stays())), "left_anti").select(columns)
    # of equal rows one stays: they are set aside, and merged before the shuffle
    rest = keyed.join(*of(judged.where(~_stays() | (F.col("n") > 1))), "left_anti").select(columns)
    return rest.unionByName(keyed.join(*of(again), "left_semi").dropDuplicates([own_id, own_h]).select(columns))


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "documents"))
