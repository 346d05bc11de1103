"""Tables that are as large as a model: computed once and held.  The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that may be held in a plan; larger tables are checkpointed instead.
HELD_ROWS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, else the one given to ``setCheckpointDir``.

    Only on one machine, where neither names one (as in tests), a temporary
    folder is made, once, and set as the session's.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        folder = folder.rstrip("/")
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(folder)
        return folder
    if folder := spark.sparkContext.getCheckpointDir():
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="statewright-")
    spark.sparkContext.setCheckpointDir(folder)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote, wherever Spark reaches it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def held(df: DataFrame, limit: int = HELD_ROWS) -> list:
    """The rows of a table that is as large as a model; raises if it is larger than that."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows where a model's table is expected")
    return rows


def pinned(df: DataFrame, limit: int = HELD_ROWS) -> DataFrame:
    """``df`` computed now, so that later steps don't compute it again.

    A model's table is bounded by its alphabets and its history length; its size
    is checked all the same, and a larger one goes to the checkpoint folder.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) <= limit:
        return df.sparkSession.createDataFrame(rows, df.schema)
    shared_folder(df.sparkSession)
    return df.checkpoint()


def settled(df: DataFrame, limit: int = HELD_ROWS) -> DataFrame:
    """``df`` of any size, computed once: written to the shared folder and read again, or held where it is small.

    For steps over large tables: :func:`pinned` looks for a small table first and
    computes a large one again for its checkpoint.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4()}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    if found.count() > limit:
        return found
    small = spark.createDataFrame(found.collect(), df.schema)
    removed(spark, path)
    return small


def numbered(df: DataFrame, by: list[str], name: str = "n", first: int = 0) -> DataFrame:
    """``df`` with whole numbers from ``first`` in the order of ``by``, a key: rows are counted in ranges side by side.

    The result is computed: asking it twice gives the same numbers.
    """
    placed = pinned(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)  # how that function numbers rows
    before, total = [], first
    for r in sorted(placed.groupBy(part.alias("part")).count().collect()):  # one row per partition
        before.append((r["part"], total))
        total += r["count"]
    offsets = df.sparkSession.createDataFrame(before, "_part bigint, _before bigint")
    both = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")  # as many rows as partitions
    return both.select(*df.columns, (F.col("_before") + within).alias(name))
