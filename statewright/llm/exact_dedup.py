"""Exact deduplication by deterministic block naming.

A document's normalised text is cut into blocks of a fixed number of code
points.  The distinct blocks are sorted and each gets an integer name; then
adjacent pairs of names are sorted and named in turn, until every document has
one name.  Two documents have the same ``(level, name)`` if and only if their
normalised texts are equal.  Blocks are sorted by a digest, and by the blocks
themselves where different blocks share one (found by comparing the least and the
greatest block of each digest); pairs are sorted by their two names.

How it is laid out on a cluster
    * Texts are shuffled once, after a map-side combine: equal blocks of one
      input split travel once, so a text that a third of all rows hold does not
      load one task.  Everything after works on integers.
    * Names are ``range number << 40 | rank in the range``; ranges are taken
      from a digest's leading bits, so they are even and need no sampling, and
      a name is a pure function of the set of values (a lost task names alike).
    * Names return to documents by sort-merge joins of two plain exchanges,
      which adaptive execution splits where a name is very common.

Defined results
    Null text counts as empty; all empty texts are one group.  A null id sorts
    after every other id.  Rows repeated with the same id and an equal text are
    separate rows of the group, of which one at most stays.  An empty table
    gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, settle, spread_name, text_of

#: White space that does not count: space and the controls from tab to carriage return.
WHITE = r"[\x20\x09-\x0D]+"
RANGE_BITS, RANK_BITS = 16, 40


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(text_of(text), WHITE, "")


def blocks_of(norm: Column, size: int) -> Column:
    """Blocks of ``size`` code points, in order; one empty block for an empty text."""
    return F.when(norm == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(norm, F.lit(f"((?s).{{1,{size}}})"), F.lit(1)))


def _named(values: DataFrame, order: list[str], digest: Column) -> DataFrame:
    """``values`` (distinct rows) with ``name``: the range of the digest, then the rank there."""
    in_range = Window.partitionBy("_range").orderBy(*order)
    ranges = F.shiftrightunsigned(digest, 64 - RANGE_BITS)
    return (
        values.withColumn("_range", ranges)
        .withColumn("name", F.shiftleft(F.col("_range"), RANK_BITS).bitwiseOR(F.row_number().over(in_range).cast("long")))
        .drop("_range")
    )


def _gathered(placed: DataFrame) -> DataFrame:
    """Names of each key in order of position: as many as the document has blocks."""
    in_order = F.array_sort(F.collect_list(F.struct("pos", "name")))
    return placed.groupBy("key").agg(F.transform(in_order, lambda x: x["name"]).alias("names"))


def _pairs(names: Column) -> Column:
    """Adjacent pairs; the last has -1 for a missing second name."""
    halves = F.sequence(F.lit(0), F.floor((F.size(names) - 1) / 2).cast("int"))
    second = lambda i: F.coalesce(F.get(names, 2 * i + 1), F.lit(-1).cast("long"))
    return F.transform(halves, lambda i: F.struct(F.get(names, 2 * i).alias("a"), second(i).alias("b")))


def block_identities(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 8192, digest: Callable[[Column], Column] = F.xxhash64
) -> DataFrame:
    """One row for each distinct (id, normalised text, length of the text) with its identity.

    Columns: doc_id, points (code points of the original text), text_sha256
    (hex, of the normalised text), copies (rows alike), level, name.
    ``digest`` only steers work; equal digests of different blocks are told
    apart by the blocks' order (tests pass a digest that collides).
    """
    keys = ["doc_id", "points", "text_sha256"]
    cut = docs.select(F.col(id_col).alias("doc_id"), F.char_length(text_of(text_col)).alias("points"), normalised(text_col).alias("norm"))
    cut = cut.select("doc_id", "points", F.sha2("norm", 256).alias("text_sha256"), blocks_of(F.col("norm"), block).alias("blocks"))
    light = cut.select(*keys, F.transform("blocks", lambda x: digest(x)).alias("digests"))
    light = light.groupBy(*keys, "digests").agg(F.count("*").alias("copies"))
    light = settle(light.withColumn("key", F.monotonically_increasing_id()))

    # Distinct digests; a digest whose least and greatest block differ stands for several.
    loose = docs.select(F.explode(blocks_of(normalised(text_col), block)).alias("block")).select(digest(F.col("block")).alias("h"), "block")
    spans = loose.groupBy("h").agg(F.min("block").alias("lo"), F.max("block").alias("hi"))
    spans = settle(spans.select("h", (F.col("lo") != F.col("hi")).alias("clash")))
    at = light.select("key", F.size("digests").alias("n"), F.posexplode("digests").alias("pos", "h"), F.lit(1).alias("sub"))
    values = spans.where("not clash").select("h", F.lit(1).alias("sub"))
    clash = spans.where("clash").select("h")
    if not clash.isEmpty():
        found = cut.select(*keys, F.posexplode("blocks").alias("pos", "block")).withColumn("h", digest(F.col("block")))
        found = settle(found.join(clash, "h", "left_semi").distinct())
        order = found.select("h", "block").distinct().withColumn("sub", F.row_number().over(Window.partitionBy("h").orderBy("block")))
        order = settle(order)
        same = [light[k].eqNullSafe(found[k]) for k in keys]
        subs = found.join(order, ["h", "block"]).join(light, same).select("key", "pos", F.col("sub").alias("told"))
        at = at.join(subs, ["key", "pos"], "left").withColumn("sub", F.coalesce("told", "sub")).drop("told")
        values = values.unionByName(order.select("h", "sub"))

    names = settle(_named(values, ["h", "sub"], F.xxhash64("h", "sub")))
    placed = settle(at.join(names, ["h", "sub"]).select("key", "n", "pos", "name"))
    discard(names)
    done = [placed.where("n = 1").select("key", F.lit(1).alias("level"), "name")]
    longest = light.agg(F.max(F.size("digests"))).first()[0] or 0
    state = settle(_gathered(placed.where("n > 1"))) if longest > 1 else None
    level = 1
    while longest > 1:
        longest, level = (longest + 1) // 2, level + 1
        pairs = state.select("key", F.size("names").alias("n"), F.posexplode(_pairs(F.col("names"))).alias("pos", "pair"))
        pairs = pairs.select("key", "n", "pos", "pair.a", "pair.b")
        names = settle(_named(pairs.select("a", "b").distinct(), ["a", "b"], F.xxhash64("a", "b")))
        placed = settle(pairs.join(names, ["a", "b"]).select("key", "n", "pos", "name"))
        done.append(placed.where("n <= 2").select("key", F.lit(level).alias("level"), "name"))
        if longest > 1:
            state = settle(_gathered(placed.where("n > 2")))
        discard(names)
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole.join(light.select("key", *keys, "copies"), "key").drop("key")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 8192, digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """A row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of a group the row with the most code points in its original text stays,
    then the smallest id.
    """
    ids = settle(block_identities(docs, id_col, text_col, block, digest))
    best = F.min(F.struct((-F.col("points")).alias("short"), F.col("doc_id").isNull().alias("unknown"), "doc_id")).alias("best")
    groups = settle(ids.groupBy("level", "name").agg(best, F.sum("copies").alias("group_size")))
    joined = ids.join(groups, ["level", "name"])
    first = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("points") == -F.col("best.short"))
    rows = joined.select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", "text_sha256", "points", first.alias("first"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    )
    return rows.select("doc_id", "keep_id", "group_size", (F.col("first") & (F.col("copy") == 1)).alias("kept"), "text_sha256", F.col("points").alias("n_points"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 8192) -> DataFrame:
    """``docs`` without the rows that do not stay, all columns as they were."""
    kept = exact_groups(docs, id_col, text_col, block).where("kept")
    own = {c: spread_name([*docs.columns], c) for c in ("_keep", "_sha", "_points")}
    kept = kept.select(F.col("doc_id").alias(own["_keep"]), F.col("text_sha256").alias(own["_sha"]), F.col("n_points").alias(own["_points"]))
    kept = settle(kept)
    keyed = docs.withColumns({own["_sha"]: F.sha2(normalised(text_col), 256), own["_points"]: F.char_length(text_of(text_col))})
    same = keyed[id_col].eqNullSafe(kept[own["_keep"]]) & (keyed[own["_sha"]] == kept[own["_sha"]]) & (keyed[own["_points"]] == kept[own["_points"]])
    left = keyed.join(kept, same, "left_semi")
    # Rows alike in id, text and length: one of them, the least by all its columns.
    twice = settle(left.groupBy(id_col, own["_sha"], own["_points"]).agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    if twice.isEmpty():
        return left.select(*docs.columns)
    alike = left[id_col].eqNullSafe(twice[id_col]) & (left[own["_sha"]] == twice[own["_sha"]]) & (left[own["_points"]] == twice[own["_points"]])
    some = left.join(twice, alike, "left_semi").groupBy(id_col, own["_sha"], own["_points"])
    single = some.agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row")).select("row.*")
    return left.join(twice, alike, "left_anti").select(*docs.columns).unionByName(single)
