"""Interval joins: which interval lo < u <= hi each value lies in, without comparing all with all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.small import pinned, settled

#: Bins between quantiles of the values.
BINS = 64
#: Values of a bin that meet its intervals in one place; larger bins are dealt out.
BIN_ROWS = 1 << 20


#: Intervals to a bin, from which bins are cut again.
BIN_INTERVALS = 16


def _cut(rows: DataFrame, fine: DataFrame, name: str, value: str, bins: int) -> DataFrame:
    """``rows`` with the column ``name`` of bins cut by the quantiles in ``fine``; a row per bin is broadcast."""
    within = F.aggregate("_cuts", F.lit(0), lambda n, b: n + (b < F.col(value)).cast("int"))
    both = rows.join(F.broadcast(fine.withColumnRenamed("_from", "_at")), F.col(name) == F.col("_at"), "left")
    return both.withColumn(name, F.col(name) * bins + F.when(F.col("_cuts").isNull(), 0).otherwise(within)).drop("_at", "_cuts")


def interval_join(points: DataFrame, intervals: DataFrame, value: str = "u", low: str = "lo", high: str = "hi", on: list[str] | None = None, bins: int = BINS, bin_rows: int = BIN_ROWS) -> DataFrame:
    """All columns of both sides where low < value <= high, and where the columns ``on`` are equal, if any are named.

    The axis is cut between quantiles of the values.  A value goes to its bin, an
    interval to every bin it touches, and the two meet by an equality of bins.  Of
    many intervals, bins are cut again between the intervals' low ends, so that
    their number grows with the intervals' and few meet in one bin.  Where one value is so frequent that a bin is large whatever
    its bounds, its values are dealt out over several places and the intervals
    that touch the bin go to each of them.  Null values and intervals with a null
    end match nothing; intervals may overlap, and an interval with low >= high is
    empty.
    """
    if bins < 2:
        raise ValueError("two bins at least")
    known = points.where(F.col(value).isNotNull())
    cuts = known.agg(F.percentile_approx(value, [i / bins for i in range(1, bins)]).alias("b")).first()["b"] or []
    cuts = sorted(set(cuts))
    bounds = F.array(*[F.lit(c) for c in cuts]) if cuts else None
    bin_of = lambda c: F.size(F.filter(bounds, lambda b: b < F.col(c))) if cuts else F.lit(0)
    placed, ends = known.withColumn("_bin", bin_of(value)), intervals.where(F.col(low) < F.col(high)).withColumns({"_from": bin_of(low), "_to": bin_of(high)})
    # A bin of many intervals is cut again between the quantiles of their low ends.
    many, parts = ends.count(), bins
    while many > parts * BIN_INTERVALS:
        fine = pinned(ends.groupBy("_from").agg(F.percentile_approx(low, [i / bins for i in range(1, bins)]).alias("_cuts")))
        placed = _cut(placed, fine, "_bin", value, bins)
        ends = settled(_cut(settled(_cut(ends, fine, "_to", high, bins)), fine, "_from", low, bins))
        parts *= bins
    shares = pinned(placed.groupBy("_bin").agg(F.count("*").alias("_rows")).select("_bin", F.ceil(F.col("_rows") / bin_rows).cast("int").alias("_places")))  # a row per bin
    dealt = placed.join(F.broadcast(shares), "_bin").withColumn("_place", (F.rand(0) * F.col("_places")).cast("int")).drop("_places")
    touched = ends.withColumn("_bin", F.explode(F.sequence("_from", "_to"))).drop("_from", "_to")
    spread = touched.join(F.broadcast(shares), "_bin").withColumn("_place", F.explode(F.sequence(F.lit(0), F.col("_places") - 1))).drop("_places")
    met = dealt.join(spread, ["_bin", "_place", *(on or [])]).where((F.col(low) < F.col(value)) & (F.col(value) <= F.col(high)))
    return met.drop("_bin", "_place")


def cumulative_intervals(weights: DataFrame, outcome: str, weight: str = "p", by: list[str] | None = None) -> DataFrame:
    """The keys, outcome, lo, hi: each outcome's part of (0, 1], in order of the outcome: a cumulative distribution as intervals.

    A group is one distribution; it has as many rows as outcomes.
    """
    from pyspark.sql import Window

    keys = by or []
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = F.sum(weight).over(group.orderBy(outcome).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(weight).over(group)
    return weights.select(*keys, outcome, ((upto - F.col(weight)) / total).alias("lo"), (upto / total).alias("hi"))
