"""Scores of predictions against what happened, per series; ``rows(series_id, t, y, y_pred, p)``.

y_pred is null where nothing was predicted, p the probability given to '1'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("accuracy", "precision", "recall", "F", "tv", "logloss")


def _ratio(hits: Column, of: Column) -> Column:
    return F.when(of == 0, 1.0).otherwise(hits / of)


def _expression(metric: str) -> Column:
    true, said = F.col("y") == "1", F.coalesce(F.col("y_pred") == "1", F.lit(False))
    both = F.count_if(true & said)
    precision, recall = _ratio(both, F.count_if(said)), _ratio(both, F.count_if(true))
    if metric == "accuracy":
        return F.avg(F.coalesce(F.col("y") == F.col("y_pred"), F.lit(False)).cast("int"))
    if metric == "precision":
        return precision
    if metric == "recall":
        return recall
    if metric == "F":
        return F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))
    if metric == "tv":
        return F.avg(F.abs(true.cast("int") - F.col("p")))
    if metric == "logloss":
        given = F.when(true, F.col("p")).otherwise(1 - F.col("p"))
        return F.avg(-F.log(F.greatest(given, F.lit(1e-12))))
    raise ValueError(f"unknown metric {metric!r}: one of {', '.join(METRICS)}")


def evaluate(rows: DataFrame, metrics: list[str], skip: int = 0) -> DataFrame:
    """One row per series, a column per metric; the first ``skip`` positions are left out."""
    return rows.where(F.col("t") >= skip).groupBy("series_id").agg(*[_expression(m).alias(m) for m in metrics])


def confusion(rows: DataFrame, steps: int = 100) -> DataFrame:
    """threshold, tp, fp, fn, tn at ``steps`` + 1 even thresholds.

    Rows are first counted by the threshold cell that their probability falls
    in; thresholds then sum cells, so no row is copied per threshold.
    """
    cells = rows.where("p is not null").select(F.floor(F.col("p") * steps + 1e-9).cast("int").alias("cell"), (F.col("y") == "1").alias("true"))
    cells = cells.groupBy("cell").agg(F.count_if("true").alias("pos"), F.count_if(~F.col("true")).alias("neg"))
    grid = rows.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("cell"))
    filled = grid.join(F.broadcast(cells), "cell", "left").fillna(0, ["pos", "neg"])
    after, every = Window.orderBy("cell").rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(F.lit(1))  # steps + 1 rows
    tp, fp = F.sum("pos").over(after), F.sum("neg").over(after)
    return filled.select((F.col("cell") / steps).alias("threshold"), tp.alias("tp"), fp.alias("fp"), (F.sum("pos").over(every) - tp).alias("fn"), (F.sum("neg").over(every) - fp).alias("tn"))


def area_under_curve(counts: DataFrame) -> DataFrame:
    """auc of a confusion table by trapezoids."""
    rates = counts.select("threshold", (F.col("tp") / (F.col("tp") + F.col("fn"))).alias("tpr"), (F.col("fp") / (F.col("fp") + F.col("tn"))).alias("fpr"))
    end = rates.limit(1).select(F.lit(2.0).alias("threshold"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr"))
    order = Window.orderBy(F.desc("threshold"))  # as many rows as thresholds
    steps = rates.unionByName(end).withColumns({"t0": F.lag("tpr").over(order), "f0": F.lag("fpr").over(order)})
    return steps.agg(F.sum((F.col("fpr") - F.col("f0")) * (F.col("tpr") + F.col("t0")) / 2).alias("auc"))
