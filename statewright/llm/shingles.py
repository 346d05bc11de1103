"""Near copies by the similarity of their sets of five-word shingles.

Two texts are linked if the Jaccard similarity of their shingle sets is at least
``similarity``.  Candidates are texts that share a key: ``BANDS`` keys a text,
each of ``ROWS`` minimum hashes.  At similarity 0.8 a pair shares some key with
probability 1 - (1 - 0.8^5)^24 = 0.9999, above it sooner.  Every link is verified
on the whole sets, so none is an estimate, and every two texts under a key are
compared unless links found before join them already.

Links are found in two rounds.  First, texts that are neighbours under a key are
compared, which joins nearly all groups.  Then texts under a key that are still
in different components are compared: pair by pair where a key has ``PAIRWISE``
texts at most; where it has more, in blocks of bounded weight, each two blocks
of a key in one task that multiplies their incidence matrices.  Blocks of one
component needn't meet, so a large group costs as much as its texts; a task
returns links that join components, never all pairs.

How it is laid out on a cluster
    Equal sets are one node.  Keys are counted with map-side combine and single
    keys dropped.  Neighbours come from a range sort, so a hot key is spread over
    tasks; a text is in a bounded number of pairs there.  Blocks are dealt by hash
    within a component or a mix of small ones, without gathering a key.  Only keys
    are kept of all texts; sets are made again for the texts that share a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, partitions, settle, settle_in_small_batches
from .components import components

WORDS, BANDS, ROWS = 5, 24, 5
PAIRWISE = 16
#: Weight of the sets in one block: their shingles and a constant each, which bounds a task's matrices too.
BLOCK_WEIGHT, SET_WEIGHT = 1 << 20, 512
#: Columns of the incidence matrices that are held at a time.
COLUMNS = 2048
BROADCAST_TEXTS = 1_000_000
#: Odd multiplier of the mixing steps (2^64 over the golden ratio), and the minimum hashes' factors.
MIX = np.uint64(0x9E3779B97F4A7C15)
FACTORS, OFFSETS = np.random.RandomState(5).randint(0, 1 << 62, (2, BANDS * ROWS, 1), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(state: np.ndarray, more: np.ndarray) -> np.ndarray:
    out = (state ^ more) * MIX
    out ^= out >> np.uint64(29)
    out *= MIX
    return out ^ (out >> np.uint64(32))


def shingle_set(data: bytes) -> np.ndarray:
    """Sorted distinct digests of the shingles of a text in UTF-8; a text of fewer words is one shingle."""
    import xxhash

    words = data.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    digests = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), dtype=">u8").astype(np.uint64)
    width = min(WORDS, len(digests))
    n = len(digests) - width + 1
    state = np.full(n, width, dtype=np.uint64)
    for i in range(width):
        state = _mixed(state, digests[i : i + n])
    return np.unique(state)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key a band: a digest of the band's number and its minimum hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[None, at : at + 1024] * FACTORS + OFFSETS).min(axis=1), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        keys = _mixed(keys, least[i::ROWS])
    return keys


def set_name(shingles: np.ndarray) -> int | None:
    """Digest of a shingle set; None if it is empty."""
    import xxhash

    return xxhash.xxh64_intdigest(shingles.tobytes()) - (1 << 63) if len(shingles) else None


def sketch(data: bytes) -> tuple[int | None, np.ndarray]:
    """Digest of a text's shingle set, and its keys."""
    shingles = shingle_set(data)
    return set_name(shingles), band_keys(shingles) if len(shingles) else shingles


def shingle_sets(docs: DataFrame, text_col: str, texts: DataFrame) -> DataFrame:
    """set_key and its shingles for the texts whose digests are in ``texts`` (text_key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                sets = [shingle_set(x.as_py()) for x in whole.column(0).slice(at, 256)]
                yield pa.RecordBatch.from_arrays([pa.array(map(set_name, sets), pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["set_key", "shingles"])

    rows = docs.select(F.col(text_col).cast("binary").alias("text"), F.xxhash64(text_col).alias("text_key")).where("text is not null")
    few = texts.count() <= BROADCAST_TEXTS
    found = rows.join(F.broadcast(texts) if few else texts, "text_key", "left_semi").select("text").mapInArrow(run, "set_key bigint, shingles array<bigint>")
    return found.groupBy("set_key").agg(F.first("shingles").alias("shingles"))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of sets side by side under a key; the rows are sorted by key."""
    last_key, last_set = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    for batch in batches:
        keys = np.concatenate([last_key, batch.column(0).to_numpy(zero_copy_only=False)])
        sets = np.concatenate([last_set, batch.column(1).to_numpy(zero_copy_only=False)])
        same = keys[1:] == keys[:-1]
        one, two = sets[:-1][same], sets[1:][same]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], ["a", "b"])
        last_key, last_set = keys[-1:], sets[-1:]


def joining_links(flat: np.ndarray, starts: np.ndarray, left: np.ndarray, right: np.ndarray, roots: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links between sets of ``left`` and of ``right`` (row numbers) that join their components: similar pairs, fewer than there are components.

    Set i holds flat[starts[i]:starts[i + 1]].
    """
    sizes = np.diff(starts)
    order = np.argsort(flat, kind="stable")
    values, owners = flat[order], np.repeat(np.arange(len(sizes)), sizes)[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1  # a shingle of one set alone is in no intersection
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owners, column = owners[keep], number[column[keep]]
    row_left, row_right = np.full(len(sizes), -1), np.full(len(sizes), -1)
    row_left[left], row_right[right] = np.arange(len(left)), np.arange(len(right))
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + COLUMNS + 1, COLUMNS))
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        who, what = owners[a:b], column[a:b] - k * COLUMNS
        one, two = np.zeros((len(left), COLUMNS), dtype=np.float32), np.zeros((len(right), COLUMNS), dtype=np.float32)
        here = row_left[who] >= 0
        one[row_left[who[here]], what[here]] = 1
        here = row_right[who] >= 0
        two[row_right[who[here]], what[here]] = 1
        common += one @ two.T
    total = (sizes[left][:, None] + sizes[right][None, :]).astype(np.float64)
    alike = (common >= similarity * (total - common)) & (roots[left][:, None] != roots[right][None, :])
    above = {int(r): int(r) for r in np.unique(roots)}

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    out = []
    for i, j in zip(*np.nonzero(alike), strict=True):
        x, y = top(int(roots[left[i]])), top(int(roots[right[j]]))
        if x != y:
            above[x] = y
            out.append((int(left[i]), int(right[j])))
    return out


def blocks_compared(rest: DataFrame, sets: DataFrame, similarity: float, weight: int = BLOCK_WEIGHT) -> DataFrame:
    """Verified links (a, b) between sets of different components under a key; ``rest``: key, set_key, root."""
    sized = settle(rest.join(sets.select("set_key", (F.size("shingles") + SET_WEIGHT).alias("w")), "set_key"))
    by_root = sized.groupBy("key", "root").agg(F.sum("w").alias("w"))
    by_root = by_root.withColumn("large", F.col("w") > weight)
    small = by_root.where("not large").groupBy("key").agg(F.sum("w").alias("small"))
    parts = lambda c: F.ceil(F.col(c) / weight)
    placed = by_root.join(small, "key", "left").select(F.col("key").alias("_k"), F.col("root").alias("_r"), "large", F.when(F.col("large"), parts("w")).otherwise(parts("small")).alias("parts"))
    joined = sized.join(placed, (sized["key"] == placed["_k"]) & (sized["root"] == placed["_r"]))
    # A large component has blocks of its own; small ones share blocks, each whole in one.
    salt = F.pmod(F.xxhash64(F.when(F.col("large"), F.col("set_key")).otherwise(F.col("root"))), F.col("parts"))
    member = settle(joined.select("key", F.when(F.col("large"), F.col("root")).alias("owner"), salt.alias("salt"), "set_key", "root"))
    known = member.groupBy("key", "owner", "salt").agg(F.count_distinct("root").alias("roots"))
    known = settle(known.select("key", "roots", "owner", "salt", F.struct(F.coalesce("owner", F.lit(0)).alias("o"), F.col("owner").isNull().alias("mixed"), "salt").alias("block")))
    one, two = known.alias("one"), known.alias("two")
    meeting = one.join(two, (F.col("one.key") == F.col("two.key")) & (F.col("one.block") <= F.col("two.block")))
    meeting = meeting.where((F.col("one.owner").isNull() | ~F.col("one.owner").eqNullSafe(F.col("two.owner"))) & ((F.col("one.block") != F.col("two.block")) | (F.col("one.roots") > 1)))
    meeting = settle(meeting.select(F.col("one.key").alias("key"), F.col("one.block").alias("x"), F.col("two.block").alias("y"), F.monotonically_increasing_id().alias("task")))
    ends = meeting.select("task", "key", F.col("x").alias("block"), F.lit(1).alias("side")).unionByName(meeting.where("x <> y").select("task", "key", F.col("y").alias("block"), F.lit(2).alias("side")))
    ends = ends.unionByName(meeting.where("x = y").select("task", "key", F.col("x").alias("block"), F.lit(2).alias("side"))).groupBy("task", "key", "block").agg(F.sum("side").alias("side"))
    of = member.select("key", "set_key", "root", F.struct(F.coalesce("owner", F.lit(0)).alias("o"), F.col("owner").isNull().alias("mixed"), "salt").alias("block"))
    dealt = ends.join(of, ["key", "block"]).select("task", "side", "set_key", "root").join(sets, "set_key").select("task", "side", "set_key", "root", "shingles")

    def run(rows: pa.Table) -> pa.Table:
        side, keys, roots = (rows.column(i).to_numpy() for i in (1, 2, 3))
        lists = rows.column(4).combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        flat, starts = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))]).astype(np.int64)
        found = joining_links(flat, starts, np.nonzero(side & 1)[0], np.nonzero(side & 2)[0], roots, similarity)
        a, b = keys[[i for i, _ in found]] if found else keys[:0], keys[[j for _, j in found]] if found else keys[:0]
        return pa.table([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    links = settle(dealt.groupBy("task").applyInArrow(run, "a bigint, b bigint").distinct())
    for old in (sized, member, known, meeting):
        discard(old)
    return links


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar enough, as a settled table."""
    pairs = settle(pairs.distinct())
    both = pairs.join(sets.select(F.col("set_key").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("set_key").alias("b"), F.col("shingles").alias("y")), "b")
    common = both.select("a", "b", F.expr("size(array_intersect(x, y))").alias("n"), F.expr("size(x) + size(y)").alias("total"))
    found = settle(common.where(F.col("n") / (F.col("total") - F.col("n")) >= similarity).select("a", "b"))
    discard(pairs)
    return found


def similar_sets(rows: DataFrame, docs: DataFrame, similarity: float, text_col: str = "text", pairwise: int = PAIRWISE, weight: int = BLOCK_WEIGHT) -> DataFrame:
    """Verified links (a, b) of set digests; ``rows`` has text_key, set_key and bands of ``docs``."""
    parts = partitions(rows.sparkSession)
    keyed = settle(rows.where("set_key is not null").select("set_key", F.explode("bands").alias("key")).distinct())
    counts = settle(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    shared = settle(keyed.join(counts, "key"))
    discard(keyed)
    texts = rows.select("set_key", "text_key").join(shared.select("set_key").distinct(), "set_key", "left_semi").groupBy("set_key").agg(F.min("text_key").alias("text_key"))
    sets = settle_in_small_batches(shingle_sets(docs, text_col, settle(texts.select("text_key").distinct())))
    ordered = shared.select("key", "set_key").repartitionByRange(parts, "key", "set_key").sortWithinPartitions("key", "set_key")
    first = verified(ordered.mapInArrow(_neighbours, "a bigint, b bigint"), sets, similarity)
    roots = settle(components(first))
    placed = settle(shared.join(roots, shared["set_key"] == roots["node"], "left").select("key", "set_key", "n", F.coalesce("root", "set_key").alias("root")))
    mixed = settle(placed.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key"))
    if mixed.isEmpty():  # every key's texts are joined already
        for old in (counts, shared, sets, placed, mixed, roots):
            discard(old)
        return first
    rest = settle(placed.join(mixed, "key"))
    few = rest.where(F.col("n") <= pairwise).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("set_key", "root"))).alias("of"))
    pairs = few.selectExpr(
        "explode(flatten(transform(of, (x, i) -> transform(filter(slice(of, i + 2, size(of)), y -> y.root <> x.root), y -> named_struct('a', x.set_key, 'b', y.set_key))))) AS pair"
    ).select("pair.a", "pair.b")
    second = verified(pairs, sets, similarity)
    found, many = first.unionByName(second), rest.where(F.col("n") > pairwise).select("key", "set_key", "root")
    if not many.isEmpty():
        found = found.unionByName(blocks_compared(many, sets, similarity, weight))
    for old in (counts, shared, sets, placed, mixed, rest, roots):
        discard(old)
    return found


def similar_links(rows: DataFrame, docs: DataFrame, similarity: float, text_col: str = "text", pairwise: int = PAIRWISE, weight: int = BLOCK_WEIGHT) -> DataFrame:
    """Links (a, b) of fingerprints whose texts are similar; ``rows`` has fp beside text_key, set_key and bands of ``docs``."""
    known = settle(rows.where("set_key is not null").select("set_key", "fp").distinct())
    named = settle(known.groupBy("set_key").agg(F.min("fp").alias("least")))
    found = similar_sets(rows, docs, similarity, text_col, pairwise, weight)
    ends = found.join(named.select(F.col("set_key").alias("a"), F.col("least").alias("x")), "a").join(named.select(F.col("set_key").alias("b"), F.col("least").alias("y")), "b")
    alike = known.join(named, "set_key").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    return ends.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(alike).where("a <> b").distinct()
