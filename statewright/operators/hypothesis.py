"""Tests that two histories have the same distribution of next outputs, as DataFrame plans."""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.small import pinned
from ..functions.stats import chi2_tail

#: Degrees of freedom up to which critical values are laid out in a plan; beyond, :func:`rejected` raises.
MOST_DF = 128


@lru_cache(maxsize=64)
def critical_values(alpha: float, most: int = MOST_DF) -> tuple[float, ...]:
    """The chi-squared statistic that is passed with probability ``alpha``, for 1 to ``most`` degrees of freedom."""
    out = []
    for df in range(1, most + 1):
        low, high = 0.0, df + 10.0
        while chi2_tail(high, df) > alpha:
            high *= 2
        for _ in range(100):
            middle = (low + high) / 2
            low, high = (middle, high) if chi2_tail(middle, df) > alpha else (low, middle)
        out.append(high)
    return tuple(out)


def even_tail(stat: Column, half_df: int) -> Column:
    """Chi-squared tail for 2 * half_df degrees of freedom in built-in functions."""
    return F.exp(-stat / 2) * sum((F.pow(stat / 2, F.lit(i)) / math.factorial(i) for i in range(1, half_df)), F.lit(1.0))


def parent_pairs(words: DataFrame) -> DataFrame:
    """For each history of length k - 1 >= 1 with a current input: its counts beside those of the history without its oldest pair.

    Columns xs, past (the child's), x, y, n_child, n_parent.
    """
    rows = words.select("k", "xs", F.expr("left(ys, k - 1)").alias("past"), F.expr("right(ys, 1)").alias("y"), "n")
    child = rows.where("k > 1")
    cells = child.select(F.expr("left(xs, k - 1)").alias("hx"), F.col("past").alias("hy"), F.expr("right(xs, 1)").alias("x")).distinct()
    outputs = pinned(rows.select("y").distinct())
    grid = cells.join(F.broadcast(outputs))  # rows times the output alphabet
    counted = grid.join(child.select(F.expr("left(xs, k - 1)").alias("hx"), F.col("past").alias("hy"), F.expr("right(xs, 1)").alias("x"), "y", F.col("n").alias("n_child")), ["hx", "hy", "x", "y"], "left")
    parent = rows.select(F.expr("left(xs, k - 1)").alias("px"), F.col("past").alias("py"), F.expr("right(xs, 1)").alias("x"), "y", F.col("n").alias("n_parent"))
    keyed = counted.withColumns({"px": F.expr("substring(hx, 2)"), "py": F.expr("substring(hy, 2)")})
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return keyed.join(parent, ["px", "py", "x", "y"], "left").select(F.col("hx").alias("xs"), F.col("hy").alias("past"), "x", "y", zero("n_child"), zero("n_parent"))


def homogeneity_stats(pairs: DataFrame, kind: str = "chi2") -> DataFrame:
    """xs, past, stat, df per history from (xs, past, x, y, n_child, n_parent)."""
    from pyspark.sql import Window

    row = Window.partitionBy("xs", "past", "x")
    sized = pairs.withColumns({"a": F.sum("n_child").over(row), "b": F.sum("n_parent").over(row), "ys": F.count("*").over(row)}).where("a > 0 and b > 0")
    pooled = (F.col("n_child") + F.col("n_parent")) / (F.col("a") + F.col("b"))
    if kind == "chi2":
        part = lambda n, size: F.when(pooled > 0, F.pow(F.col(n) - pooled * F.col(size), 2) / (pooled * F.col(size))).otherwise(0.0)
    elif kind == "G":
        part = lambda n, size: F.when(F.col(n) > 0, 2 * F.col(n) * F.log(F.col(n) / (pooled * F.col(size)))).otherwise(0.0)
    else:
        raise ValueError("kind is chi2 or G")
    cells = sized.select("xs", "past", "x", "ys", (part("n_child", "a") + part("n_parent", "b")).alias("s"))
    return cells.groupBy("xs", "past").agg(F.sum("s").alias("stat"), (F.count_distinct("x") * (F.max("ys") - 1)).alias("df"))


def two_histogram_stats(pairs: DataFrame) -> DataFrame:
    """The older statistic over outputs only: two histograms of different totals, one degree less than bins."""
    cells = pairs.groupBy("xs", "past", "y").agg(F.sum("n_child").alias("m1"), F.sum("n_parent").alias("m2"))
    sums = cells.groupBy("xs", "past").agg(F.sum("m1").alias("s1"), F.sum("m2").alias("s2"), F.count("*").alias("bins"))
    both = cells.join(sums, ["xs", "past"]).where("s1 > 0 and s2 > 0")
    term = F.when(F.col("m1") + F.col("m2") > 0, F.pow(F.sqrt(F.col("s2") / F.col("s1")) * F.col("m1") - F.sqrt(F.col("s1") / F.col("s2")) * F.col("m2"), 2) / (F.col("m1") + F.col("m2"))).otherwise(0.0)
    return both.groupBy("xs", "past").agg(F.sum(term).alias("stat"), (F.max("bins") - 1).alias("df"))


def rejected(stats: DataFrame, alpha: float = 0.001, most: int = MOST_DF) -> DataFrame:
    """With ``reject``: whether the statistic passes the critical value at ``alpha`` (false without degrees of freedom; more than ``most`` raise)."""
    limits = F.array(*[F.lit(v) for v in critical_values(alpha, most)])
    df = F.col("df").cast("int")
    too_many = F.raise_error(F.lit(f"more than {most} degrees of freedom")).cast("boolean")
    return stats.withColumn("reject", F.when(df > most, too_many).when(df > 0, F.col("stat") > F.element_at(limits, F.greatest(df, F.lit(1)))).otherwise(F.lit(False)))
