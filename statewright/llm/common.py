"""What the operators of this subpackage share: inputs, shared scratch tables, row helpers."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.small import shared_folder

_SCRATCH: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; raises on a cluster that names none."""
    return shared_folder(spark)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage in a way that outlives executors: a later failure rereads
    files instead of recomputing (perhaps in another order) what was decided.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SCRATCH.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back._settled_at = path
    return back


def settle_in_small_batches(df: DataFrame, rows: int = 512) -> DataFrame:
    """``settle`` with fewer rows an Arrow batch: less memory of executors and their Python workers for texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    before = conf.get(name)
    conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        return settle(df)
    finally:
        conf.set(name, before)


#: What Python workers remember between tasks, by operator, and how to forget it.
_REMEMBERED: dict[str, Callable[[], object]] = {}


def remembers(name: str, forget: Callable[[], object]) -> None:
    _REMEMBERED[name] = forget


def remember_only(name: str) -> None:
    """Called in a worker: what other operators left there goes, since a worker serves one after another."""
    for other, forget in _REMEMBERED.items():
        if other != name:
            forget()


def discard(df: DataFrame) -> None:
    """Delete a settled table that no later plan reads."""
    path = getattr(df, "_settled_at", None)
    if path:
        _delete(df.sparkSession, path)
        _SCRATCH[:] = [x for x in _SCRATCH if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    for spark, path in _SCRATCH:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session has ended: the folder belongs to whoever set it up
            return


atexit.register(_clean)


def partitions(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_of(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def spread_name(names: list[str], wanted: str) -> str:
    """``wanted``, or a variant of it that clashes with none of ``names`` (case-insensitively)."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted
