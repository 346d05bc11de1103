"""Information measures of a machine by way of its mixed states.

A machine's mixed states are the distributions over its states that observing
it from the stationary distribution can leave; they form a machine themselves,
whose states are known to who watches.  :func:`measures` finds them one after
another in one task per model; :func:`mixed_state_tables` finds those of a model
that has many, a level of words at a time, as tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.small import held, numbered, pinned
from .algebra import stationary_exact


class TooManyMixedStates(ValueError):
    """More mixed states than one task is to hold; :func:`mixed_state_tables` has no such bound."""


@dataclass
class Measures:
    cmu: float
    hmu: float
    hmu_state_graph: float
    excess: float
    h_l: list[float]
    big_h: list[float]
    e_l: list[float]


def symbol_matrices(edges: list[tuple[object, str, object, float]]) -> tuple[list, dict[str, np.ndarray]]:
    """States in order of appearance and a matrix per symbol, rows rescaled to one over all symbols."""
    states = list(dict.fromkeys([e[0] for e in edges] + [e[2] for e in edges]))
    at = {s: i for i, s in enumerate(states)}
    mats = {x: np.zeros((len(states), len(states))) for x in dict.fromkeys(e[1] for e in edges)}
    for a, x, b, p in edges:
        mats[x][at[a], at[b]] += p
    total = sum(mats.values()).sum(axis=1, keepdims=True)
    return states, {x: np.divide(m, total, out=np.zeros_like(m), where=total > 0) for x, m in mats.items()}


def mixed_states(mats: dict[str, np.ndarray], pi: np.ndarray, tolerance: float = 1e-3, most: int = 5000) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Distributions reached from ``pi``, and per symbol (probability, goal) of each; equal means alike within ``tolerance`` on average."""
    etas, todo = [pi], [0]
    steps: dict[str, list[tuple[float, int]]] = {x: [] for x in mats}
    for here in todo:
        for x, m in mats.items():
            moved = etas[here] @ m
            p = float(moved.sum())
            if p <= 0:
                steps[x].append((0.0, -1))
                continue
            eta = moved / p
            gaps = np.abs(np.array(etas) - eta).mean(axis=1)
            goal = int(gaps.argmin())
            if gaps[goal] >= tolerance:
                if len(etas) >= most:
                    raise TooManyMixedStates(f"more than {most} mixed states")
                goal = len(etas)
                etas.append(eta)
                todo.append(goal)
            steps[x].append((p, goal))
    return np.array(etas), {x: np.array(v) for x, v in steps.items()}


def measures(edges: list[tuple[object, str, object, float]], length: int = 10, tolerance: float = 1e-3, most: int = 5000) -> Measures:
    """Statistical complexity, entropy rate, excess entropy and their finite-length curves, in bits.

    The entropy rate is that of the labelled symbols; ``hmu_state_graph`` ignores
    which of two symbols leads to the same mixed state.
    """
    _, mats = symbol_matrices(edges)
    pi = stationary_exact(sum(mats.values()))
    etas, steps = mixed_states(mats, pi, tolerance, most)
    n = len(etas)
    w = np.zeros((n, n))
    gains = np.zeros(n)
    for table in steps.values():
        for i, (p, goal) in enumerate(table):
            if p > 0:
                w[i, int(goal)] += p
                gains[i] -= p * np.log2(p)
    w /= w.sum(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        graph = -np.where(w > 0, w * np.log2(w), 0).sum(axis=1)
    rest = recurrent_distribution(w)
    cmu = float(-sum(p * np.log2(p) for p in rest if p > 1e-15)) + 0.0
    hmu = float(rest @ gains)
    curve, now = [], np.zeros(n)
    now[0] = 1.0
    for _ in range(max(200, 2 * length)):
        curve.append(float(now @ gains))
        now = now @ w
    cumulative = np.cumsum(curve)
    e_l = [float(2 * cumulative[k] - cumulative[2 * k + 1]) for k in range(len(cumulative) // 2)]
    excess = float(np.sum(np.array(curve) - hmu))
    return Measures(cmu, hmu, float(rest @ graph), excess, curve[:length], [float(c) for c in cumulative[:length]], e_l[:length])


def recurrent_distribution(w: np.ndarray, rounds: int = 64) -> np.ndarray:
    """Where a lazy walk from the first state ends: squaring (W + I) / 2 forgets transient states and periods."""
    step = (w + np.eye(len(w))) / 2
    for _ in range(rounds):
        after = step @ step
        after /= after.sum(axis=1, keepdims=True)
        if np.abs(after - step).max() < 1e-15:
            break
        step = after
    return step[0].clip(0) / step[0].clip(0).sum()


def measure_models(edges: DataFrame, length: int = 10, skip_too_many: bool = False) -> DataFrame:
    """model_id, cmu, hmu, hmu_state_graph, excess and arrays h_l, big_h, e_l per model of ``edges(model_id, s_from, x, s_to, p)``.

    A model with more mixed states than one task holds raises, or with ``skip_too_many`` has no row.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["s_from", "x", "s_to"])
        try:
            m = measures(list(zip(rows["s_from"], rows["x"], rows["s_to"], rows["p"], strict=True)), length)
        except TooManyMixedStates:
            if skip_too_many:
                return pd.DataFrame([], columns=["model_id", "cmu", "hmu", "hmu_state_graph", "excess", "h_l", "big_h", "e_l"])
            raise
        return pd.DataFrame([(rows["model_id"].iloc[0], m.cmu, m.hmu, m.hmu_state_graph, m.excess, m.h_l, m.big_h, m.e_l)], columns=["model_id", "cmu", "hmu", "hmu_state_graph", "excess", "h_l", "big_h", "e_l"])

    key = edges.schema["model_id"].dataType.simpleString()
    shape = f"model_id {key}, cmu double, hmu double, hmu_state_graph double, excess double, h_l array<double>, big_h array<double>, e_l array<double>"
    return edges.select("model_id", "s_from", "x", "s_to", "p").groupBy("model_id").applyInPandas(run, shape)


# -- mixed states as tables


@dataclass
class MixedStates:
    """states(id, level, eta) in order of discovery, the first one the stationary distribution; steps(id, x, p, goal) of every possible symbol."""

    states: DataFrame
    steps: DataFrame
    symbols: list[str]


def _grid(eta: np.ndarray, directions: np.ndarray, width: float) -> list[list[int]]:
    """Cells of two directions: distributions alike within the tolerance lie in cells that touch."""
    return np.floor(eta @ directions / width).astype(np.int64).tolist()


def _near(left: DataFrame, right: DataFrame, tolerance: float) -> DataFrame:
    """Rows of both sides (left: eta, cell; right: other, other_cell) with their gap, where that is below the tolerance."""
    around = F.array(*[F.array(*[F.col("cell")[i] + d for i, d in enumerate(shift)]) for shift in product((-1, 0, 1), repeat=2)])
    spread = left.withColumn("_cell", F.explode(around))
    gap = F.aggregate(F.zip_with("eta", "other", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, b: a + b) / F.size("eta")
    return spread.join(right, F.col("_cell") == F.col("other_cell")).withColumn("gap", gap).where(F.col("gap") < tolerance).drop("_cell", "other_cell")


def _leaders(candidates: DataFrame, tolerance: float) -> DataFrame:
    """Candidates (place, eta, cell) that no leader of an earlier place is like: what taking them one by one would keep."""
    others = candidates.select(F.col("place").alias("earlier"), F.col("eta").alias("other"), F.col("cell").alias("other_cell"))
    clashes = pinned(_near(candidates, others, tolerance).where("earlier < place").select("earlier", "place"))
    open_ones, found = candidates.select("place"), None
    while open_ones.head(1):
        first = pinned(open_ones.join(clashes.select("place").distinct(), "place", "left_anti"))
        found = first if found is None else found.unionByName(first)
        followers = clashes.join(first.select(F.col("place").alias("earlier")), "earlier", "left_semi").select("place").distinct()
        open_ones = pinned(open_ones.join(first, "place", "left_anti").join(followers, "place", "left_anti"))
        clashes = pinned(clashes.join(open_ones, "place", "left_semi").join(open_ones.select(F.col("place").alias("earlier")), "earlier", "left_semi").select("earlier", "place"))
    return candidates.where("false") if found is None else candidates.join(found, "place", "left_semi")


def _found_at_once(spark: SparkSession, mats: dict[str, np.ndarray], pi: np.ndarray, tolerance: float, most: int) -> MixedStates | None:
    """The tables of a model with few mixed states; None if there are more than ``most``."""
    try:
        etas, moves = mixed_states(mats, pi, tolerance, most)
    except TooManyMixedStates:
        return None
    steps = [(i, x, float(p), int(goal)) for x, table in moves.items() for i, (p, goal) in enumerate(table) if p > 0]
    level, after = {0: 0}, {}
    for i, _, _, goal in sorted(steps, key=lambda s: (s[0], s[3])):
        after.setdefault(i, []).append(goal)
    for i in range(len(etas)):  # a state is numbered when it is first met, by one that was numbered before
        for goal in after.get(i, ()):
            level.setdefault(goal, level[i] + 1)
    states = spark.createDataFrame([(i, level[i], eta.tolist()) for i, eta in enumerate(etas)], "id bigint, level int, eta array<double>")
    return MixedStates(states, spark.createDataFrame(steps, "id bigint, x string, p double, goal bigint"), list(mats))


def mixed_state_tables(edges: DataFrame, tolerance: float = 1e-3, at_once: int = 5000) -> MixedStates:
    """The mixed states of ``edges(s_from, x, s_to, p)``, any number of them, equal to what :func:`mixed_states` finds.

    Up to ``at_once`` of them are found one after another.  Of a model with more,
    each level moves the states found last by every symbol.  What they come to is
    compared, by cells of a grid as wide as the tolerance, with the states known
    and with each other; of those that are new and alike the first in order stays.
    The model itself is held by each task; its size is checked.
    """
    spark = edges.sparkSession
    table = sorted(tuple(r) for r in held(edges.select("s_from", "x", "s_to", "p")))
    _, mats = symbol_matrices(table)
    pi = stationary_exact(sum(mats.values()))
    n, names = len(pi), list(mats)
    if at_once and (few := _found_at_once(spark, mats, pi, tolerance, at_once)):
        return few
    directions = np.random.default_rng(0).integers(0, 2, (n, 2)).astype(float)
    width = n * tolerance / 2 * (1 + 1e-9)  # the most by which a sum over some of the states can differ

    def moves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for place, eta in zip(rows["id"].tolist(), rows["eta"], strict=True):
                for i, x in enumerate(names):
                    moved = np.asarray(eta) @ mats[x]
                    if (p := float(moved.sum())) > 0:
                        after = moved / p
                        out.append((place, x, p, place * len(names) + i, after.tolist(), *_grid(after[None], directions, width)))
            yield pd.DataFrame(out, columns=["id", "x", "p", "place", "eta", "cell"])

    known = spark.createDataFrame([(0, 0, pi.tolist(), *_grid(pi[None], directions, width))], "id bigint, level int, eta array<double>, cell array<bigint>")
    fresh, count, level, steps = known, 1, 0, None
    while count:
        level += 1
        met = pinned(fresh.select("id", "eta").mapInPandas(moves, "id bigint, x string, p double, place bigint, eta array<double>, cell array<bigint>"))
        there = known.select(F.col("id").alias("goal"), F.col("eta").alias("other"), F.col("cell").alias("other_cell"))
        nearest = lambda found: found.groupBy("place").agg(F.min(F.struct("gap", "goal")).alias("best"))
        old = pinned(nearest(_near(met.select("place", "eta", "cell"), there, tolerance)))
        new = met.join(old, "place", "left_anti").groupBy("eta").agg(F.min("place").alias("place"), F.first("cell").alias("cell"))
        leaders = _leaders(pinned(new), tolerance).select("place", "eta", "cell")
        total = known.count()
        added = pinned(numbered(leaders, ["place"], "id", total))
        own = added.select(F.col("place").alias("since"), F.col("id").alias("goal"), F.col("eta").alias("other"), F.col("cell").alias("other_cell"))
        late = _near(met.select("place", "eta", "cell"), own, tolerance).where("since <= place").select("place", "gap", "goal")
        goals = nearest(old.select("place", "best.gap", "best.goal").unionByName(late)).select("place", F.col("best.goal").alias("goal"))
        told = pinned(met.select("id", "x", "p", "place").join(goals, "place").select("id", "x", "p", "goal"))
        steps = told if steps is None else pinned(steps.unionByName(told))
        fresh = added.select("id", F.lit(level).alias("level"), "eta", "cell")
        known, count = pinned(known.unionByName(fresh)), added.count()
    return MixedStates(known.select("id", "level", "eta"), steps, names)


def closure_curve(mixed: MixedStates, length: int = 10) -> DataFrame:
    """length, h_l (entropy of the next symbol after length - 1 of them), big_h (of words of the length), in bits."""
    gains = pinned(mixed.steps.groupBy("id").agg((-F.sum(F.col("p") * F.log2("p"))).alias("gain")))
    now = mixed.steps.sparkSession.createDataFrame([(0, 1.0)], "id bigint, w double")
    rows, sofar = [], 0.0
    for k in range(1, length + 1):
        h = now.join(gains, "id").agg(F.sum(F.col("w") * F.col("gain"))).first()[0] or 0.0
        sofar += h
        rows.append((k, float(h), float(sofar)))
        now = pinned(now.join(mixed.steps, "id").groupBy(F.col("goal").alias("id")).agg(F.sum(F.col("w") * F.col("p")).alias("w")))
    return mixed.steps.sparkSession.createDataFrame(rows, "length int, h_l double, big_h double")
