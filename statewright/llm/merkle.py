"""WARC fixity audit with Merkle trees.

Each record is hashed as it would lie in its file.  A leaf covers ``FANOUT``
neighbouring places of one file and hashes the ordered (offset, length, digest)
entries of that range.  Inner nodes hash their children in order, ``FANOUT`` at
most: ranges of leaves up to one node for each file, then files by ever shorter
prefixes of their hexadecimal names, up to one root.  Two replicas are compared
from the root down; only children of mismatching nodes are looked at, and only
records in mismatching leaves are compared one by one.

How it is laid out on a cluster
    * A payload is hashed where it is read and never shuffled; what travels is a
      digest, an offset and a length for each distinct record.
    * A file is named by a digest of the record's (id, url), with as many digits
      as keep files near ``FILE_RECORDS`` records.  Equal records are one entry
      with a count; where an id and url have very many different records, the
      record's digest takes part in the name, so no key makes a large file.
    * A node gathers ``FANOUT`` rows at most.  The descent joins mismatches only.

Defined results
    Null payloads, ids and urls are hashed as empty.  ``changed``: the same id
    and url with another digest or count; ``missing`` or ``added``: in one
    replica only.  A record that only moved because of others isn't reported.
    Equal replicas or two empty tables give an empty report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

FANOUT = 16
FILE_RECORDS = 1024
#: Different records of one id and url beyond which their digests take part in the file's name.
CROWDED = 1024


def record_rows(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """record_id, url, length, digest, copies of each distinct record."""
    name = F.concat_ws("\n", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(url_col), F.lit("")))
    record = F.concat(F.lit("WARC/1.1\nWARC-Type: response\n"), name, F.lit("\n\n"), F.coalesce(F.col(payload_col), F.lit("")), F.lit("\n\n"))
    rows = pages.select(F.col(id_col).alias("record_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("digest"))
    return settle(rows.groupBy("record_id", "url", "length", "digest").agg(F.count("*").alias("copies")))


def digits_for(records: int) -> int:
    digits = 0
    while records > FILE_RECORDS * FANOUT**digits:
        digits += 1
    return digits


def filed(rows: DataFrame, digits: int, crowded: int = CROWDED) -> DataFrame:
    """The records with file, place and start (offset in the file)."""
    key = F.concat_ws("\n", F.coalesce(F.col("record_id").cast("string"), F.lit("")), F.col("url"))
    many = settle(rows.groupBy(F.xxhash64("record_id", "url").alias("_crowd")).agg(F.count("*").alias("n")).where(F.col("n") > crowded).select("_crowd"))
    rows = rows.withColumn("_key", F.xxhash64("record_id", "url"))
    named = rows.join(many, rows["_key"] == many["_crowd"], "left")
    full = F.sha2(F.when(F.col("_crowd").isNull(), key).otherwise(F.concat(key, F.lit("\n"), F.col("digest"))), 256)
    named = named.withColumn("file", F.substring(full, 1, digits)).drop("_crowd", "_key")
    order = Window.partitionBy("file").orderBy(F.col("record_id").asc_nulls_last(), "url", "digest")
    before = F.sum(F.col("length") * F.col("copies")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    named = named.withColumns({"place": (F.row_number().over(order) - 1).cast("long"), "start": F.coalesce(before, F.lit(0).cast("long"))})
    return settle(named)


def ordered_hash(order: str, *columns: str) -> Column:
    """Hash of a group's rows in the order of a column."""
    rows = F.array_sort(F.collect_list(F.struct(order, *columns)))
    line = lambda r: F.concat_ws(":", *[r[c].cast("string") for c in (order, *columns)])
    return F.sha2(F.array_join(F.transform(rows, line), "\n"), 256).alias("hash")


def tree(records: DataFrame, digits: int) -> list[DataFrame]:
    """Levels from the leaves to the root: (node, parent, hash).

    A node inside a file is ``file/level/number``, one above files ``prefix``.
    """
    inside = lambda level, number: F.concat_ws("/", F.col("file"), F.lit(level), number.cast("string"))
    depth, widest = 0, (records.agg(F.max("place")).first()[0] or 0) // FANOUT
    leaf = F.floor(F.col("place") / FANOUT).alias("number")
    level = settle(records.groupBy("file", leaf).agg(ordered_hash("place", "start", "length", "copies", "digest")))
    out: list[DataFrame] = []
    while True:
        last = widest == 0
        parent = F.col("file") if last else inside(depth + 1, F.floor(F.col("number") / FANOUT))
        out.append(level.select(inside(depth, F.col("number")).alias("node"), parent.alias("parent"), "hash"))
        if last:
            break
        level = settle(level.groupBy("file", F.floor(F.col("number") / FANOUT).alias("number")).agg(ordered_hash("number", "hash")))
        depth, widest = depth + 1, widest // FANOUT
    above = out[-1]
    for n in range(digits, -1, -1):
        above = settle(above.groupBy(F.col("parent").alias("node")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda r: F.concat_ws(":", r["node"], r["hash"])), "\n"), 256).alias("hash")))
        above = above.select("node", F.substring("node", 1, n - 1).alias("parent") if n else F.lit(None).cast("string").alias("parent"), "hash")
        out.append(above)
    return out


def mismatching(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes of one level whose hashes differ or that one replica lacks."""
    other = b.select(F.col("node").alias("_node"), F.col("hash").alias("_hash"))
    both = a.join(other, a["node"] == other["_node"], "full")
    return both.where(~F.col("hash").eqNullSafe(F.col("_hash"))).select(F.coalesce("node", "_node").alias("node"))


def audit(ours: DataFrame, theirs: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", crowded: int = CROWDED) -> DataFrame:
    """status, file, place, start, record_id, url, digest, other_digest of every record that differs.

    ``place`` and ``start`` are those of our replica, or of theirs for added records.
    """
    rows = [record_rows(x, id_col, url_col, payload_col) for x in (ours, theirs)]
    digits = digits_for(rows[0].count())
    records = [filed(x, digits, crowded) for x in rows]
    trees = [tree(x, digits) for x in records]
    # Trees may differ in depth inside files; compare from the root while both have the level.
    down = settle(mismatching(trees[0][-1], trees[1][-1]))
    a, b = trees[0][::-1], trees[1][::-1]
    deep = len(a) == len(b)
    for k in range(1, len(a) if deep else digits + 1):
        below = [x[k].join(down, x[k]["parent"] == down["node"], "left_semi") for x in (a, b)]
        down = settle(mismatching(*below))
    leaf = F.concat_ws("/", F.col("file"), F.lit(0), F.floor(F.col("place") / FANOUT).cast("string"))
    unit = leaf if deep else F.col("file")
    reached = [x.withColumn("_unit", unit) for x in records]
    reached = [x.join(down, x["_unit"] == down["node"], "left_semi").drop("_unit") for x in reached]
    shape = ["file", "place", "start", "record_id", "url", "digest", "copies"]
    left, right = (x.select(*[F.col(c).alias(f"{side}_{c}") for c in shape]) for x, side in zip(reached, "ab", strict=True))
    # Records alike in both are no finding, wherever they lie.
    same = lambda x, y: (
        F.col(f"{x}_record_id").eqNullSafe(F.col(f"{y}_record_id")) & (F.col(f"{x}_url") == F.col(f"{y}_url")) & (F.col(f"{x}_digest") == F.col(f"{y}_digest")) & (F.col(f"{x}_copies") == F.col(f"{y}_copies"))
    )
    only = [settle(left.join(right, same("a", "b"), "left_anti")), settle(right.join(left, same("a", "b"), "left_anti"))]
    # Of one id and url, differing records are paired in their order.
    pair = lambda x, side: x.withColumn("nth", F.row_number().over(Window.partitionBy(f"{side}_record_id", f"{side}_url").orderBy(f"{side}_place", f"{side}_digest"))).withColumnRenamed("nth", f"{side}_nth")
    left, right = pair(only[0], "a"), pair(only[1], "b")
    met = F.col("a_record_id").eqNullSafe(F.col("b_record_id")) & (F.col("a_url") == F.col("b_url")) & (F.col("a_nth") == F.col("b_nth"))
    both = left.join(right, met, "full")
    status = F.when(F.col("b_digest").isNull(), "missing").when(F.col("a_digest").isNull(), "added").otherwise("changed")
    first = lambda c: F.coalesce(f"a_{c}", f"b_{c}").alias(c)
    return both.select(
        status.alias("status"), first("file"), first("place"), first("start"), first("record_id"), first("url"), F.col("a_digest").alias("digest"), F.col("b_digest").alias("other_digest")
    )
