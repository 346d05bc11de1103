"""From event tables or strings to symbol tables ``symbols(series_id, t, x, y)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.small import pinned

NULL_INPUT = "0"
#: Rows that a task is to rank, so that its memory doesn't grow with the table, however few shuffle partitions are set.
TASK_ROWS = 1 << 21


def _dealt(base: DataFrame, series: str) -> DataFrame:
    """``base`` by series, in as many partitions as its rows need; what one task can rank is left to Spark."""
    rows = base.count()  # of a table in files: told by their footers
    if rows <= TASK_ROWS:
        return base
    return base.repartition(max(-(-rows // TASK_ROWS), base.sparkSession.sparkContext.defaultParallelism), series)


def encode(df: DataFrame, series: str | Column, order: list[str], y: Column, x: Column | None = None, bucket: Column | None = None) -> DataFrame:
    """Symbols in order within each series, ``t`` from 0.

    ``bucket`` is any expression that does not decrease along ``order`` (a day,
    say).  With it, positions are ranks inside (series, bucket) plus the counts
    of the buckets before, so that a series of any length is ranked by many tasks.
    """
    key = F.col(series) if isinstance(series, str) else series
    base = df.select(key.alias("series_id"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], (x if x is not None else F.lit(NULL_INPUT)).alias("x"), y.alias("y"), (bucket if bucket is not None else F.lit(0)).alias("_b"))
    by = [f"_o{i}" for i in range(len(order))]
    within = F.row_number().over(Window.partitionBy("series_id", "_b").orderBy(*by)) - 1
    ranked = (_dealt(base, "series_id") if bucket is None else base).withColumn("t", within.cast("long"))
    if bucket is not None:
        sizes = base.groupBy("series_id", "_b").agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy("series_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
        offsets = sizes.select(F.col("series_id").alias("_s"), F.col("_b").alias("_bb"), F.coalesce(before, F.lit(0)).alias("_before"))
        ranked = ranked.join(offsets, ranked["series_id"].eqNullSafe(offsets["_s"]) & ranked["_b"].eqNullSafe(offsets["_bb"])).withColumn("t", F.col("t") + F.col("_before"))
    return ranked.select("series_id", "t", "x", "y")


def followers(df: DataFrame, series: str, order: list[str], y: str) -> DataFrame:
    """y, after: each symbol and the next one of its series (null after the last); sorted once, without positions."""
    after = F.lead(y).over(Window.partitionBy(series).orderBy(*order))
    return _dealt(df.select(series, *order, y), series).select(F.col(y).alias("y"), after.alias("after"))


def explode_strings(wide: DataFrame, x: str | None = "X", y: str = "Y", series: str = "series_id") -> DataFrame:
    """``sequences(series_id, X, Y)`` to symbols; without ``x`` the input is constant."""
    split = lambda c: F.array_remove(F.split(c, ""), "")
    if x is None:
        return wide.select(F.col(series).alias("series_id"), F.posexplode(split(y)).alias("t", "y")).select("series_id", F.col("t").cast("long").alias("t"), F.lit(NULL_INPUT).alias("x"), "y")
    checked = wide.withColumn("_pair", F.when(F.length(x) == F.length(y), F.arrays_zip(split(x).alias("x"), split(y).alias("y"))).otherwise(F.raise_error(F.lit("x and y of a series differ in length"))))
    rows = checked.select(F.col(series).alias("series_id"), F.posexplode("_pair").alias("t", "p"))
    return rows.select("series_id", F.col("t").cast("long").alias("t"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def to_strings(symbols: DataFrame) -> DataFrame:
    """Symbols back to one string per series."""
    rows = F.array_sort(F.collect_list(F.struct("t", "x", "y")))
    joined = lambda c: F.array_join(F.transform(rows, lambda r: r[c]), "")
    return symbols.groupBy("series_id").agg(joined("x").alias("X"), joined("y").alias("Y"))


def constant_input(symbols: DataFrame, symbol: str = NULL_INPUT) -> DataFrame:
    """The same outputs under a constant input: a machine instead of a transducer."""
    return symbols.withColumn("x", F.lit(symbol))


def first_symbols(symbols: DataFrame, n: int) -> DataFrame:
    return symbols.where(F.col("t") < n)


def split_train_test(symbols: DataFrame, share: float = 0.5) -> DataFrame:
    """Symbols with ``part``: train for the first ``share`` of each series, else test."""
    sizes = symbols.groupBy("series_id").agg(F.count("*").alias("_n"))
    both = symbols.join(sizes, "series_id")
    return both.select("series_id", "t", "x", "y", F.when(F.col("t") < F.floor(F.col("_n") * share), "train").otherwise("test").alias("part"))


def alphabet(symbols: DataFrame, role: str) -> DataFrame:
    """role, symbol, idx of the distinct symbols of ``x`` or ``y``, in order."""
    found = symbols.select(F.col(role).alias("symbol")).distinct()
    rank = F.row_number().over(Window.partitionBy(F.lit(role)).orderBy("symbol")) - 1
    return found.select(F.lit(role).alias("role"), "symbol", rank.alias("idx"))


def emission_symbols(symbols: DataFrame) -> DataFrame:
    """Every (x, y), numbered with x as the greater digit; as many rows as the alphabets' product."""
    x = alphabet(symbols, "x").select(F.col("symbol").alias("x"), F.col("idx").alias("i"))
    y = alphabet(symbols, "y").select(F.col("symbol").alias("y"), F.col("idx").alias("j"))
    y = pinned(y)
    width = y.agg(F.count("*").alias("w"))
    return x.join(F.broadcast(y)).join(F.broadcast(width)).select("x", "y", (F.col("i") * F.col("w") + F.col("j")).cast("long").alias("e_idx"))


def check_alphabet(symbols: DataFrame, axs: list[str], ays: list[str]) -> DataFrame:
    """``symbols``; a symbol outside the alphabets raises when its row is read."""
    ok = F.col("x").isin(axs) & F.col("y").isin(ays)
    return symbols.withColumn("y", F.when(ok, F.col("y")).otherwise(F.raise_error(F.concat(F.lit("symbol outside the alphabets: "), "x", F.lit(","), "y"))))
