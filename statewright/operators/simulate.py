"""Simulation of machines, transducers and well-known processes.

Random runs of machines are seeded by (seed, series); draws along given inputs are
digests of (seed, series, position).  So a repeated or recomputed task makes the
same series, and series that are given can be cut into chunks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .algebra import stationary_exact
from .filters import CHUNK, folded_states
from .measures import symbol_matrices

PIECE = 1 << 16


def generator(seed: int, series: object) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(str(series).encode())])


class Walker:
    """Draws a machine's symbols by inverse cumulative probabilities."""

    def __init__(self, edges: list[tuple[object, str, object, float]]) -> None:
        self.states, mats = symbol_matrices(edges)
        self.pi = stationary_exact(sum(mats.values()))
        self.table = []
        for i in range(len(self.states)):
            moves = [(x, j, m[i, j]) for x, m in mats.items() for j in np.nonzero(m[i])[0]]
            self.table.append((np.cumsum([p for _, _, p in moves]), [(x, int(j)) for x, j, _ in moves]))

    def first(self, rng: np.random.Generator) -> int:
        return int(min(np.searchsorted(np.cumsum(self.pi), rng.random()), len(self.pi) - 1))

    def run(self, rng: np.random.Generator, n: int, state: int) -> tuple[list[str], int]:
        out = []
        for u in rng.random(n):
            bounds, moves = self.table[state]
            x, state = moves[min(int(np.searchsorted(bounds, u * bounds[-1])), len(moves) - 1)]
            out.append(x)
        return out, state


def simulate_machine(spark: SparkSession, edges: list[tuple[object, str, object, float]], series: int, length: int, seed: int = 0, start: object = None) -> DataFrame:
    """series_id, t, x, y: runs of a machine (s_from, symbol, s_to, p) under a constant input."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walker = Walker(edges)
        for rows in batches:
            for s in rows["series_id"]:
                rng = generator(seed, s)
                state = walker.first(rng) if start is None else walker.states.index(start)
                for t in range(0, length, PIECE):
                    ys, state = walker.run(rng, min(PIECE, length - t), state)
                    yield pd.DataFrame({"series_id": s, "t": range(t, t + len(ys)), "x": "0", "y": ys})

    return spark.range(series).withColumnRenamed("id", "series_id").mapInPandas(run, "series_id bigint, t bigint, x string, y string")


def simulate_transducer(inputs: DataFrame, edges: list[tuple[object, str, str, object, float]], start: object, seed: int = 0, chunk: int = CHUNK) -> DataFrame:
    """The inputs (series_id, t, x) with a drawn output y; an impossible input gives null and keeps the state."""
    table: dict[tuple[object, str], list[tuple[float, str, object]]] = {}
    for a, x, y, b, p in edges:
        table.setdefault((a, x), []).append((p, y, b))
    states = list(dict.fromkeys([start, *[e[0] for e in edges], *[e[3] for e in edges]]))

    def rule(state: object, x: str, u: str) -> tuple[tuple, object]:
        moves = table.get((state, x))
        if not moves:
            return (None,), state
        left = float(u) * sum(p for p, _, _ in moves)
        for p, y, b in moves:
            left -= p
            if left < 0:
                break
        return (y,), b

    return _drawn(inputs, states, start, rule, seed, chunk)


def _drawn(inputs: DataFrame, states: list, first: object, rule, seed: int, chunk: int) -> DataFrame:
    """The inputs with the outputs of a rule (state, x, draw) -> ((y,), state)."""
    named = inputs.select("series_id", "t", "x", uniform(seed).cast("string").alias("y"))
    made = folded_states(named, states, first, rule, "made string", ["made"], chunk)
    return made.join(inputs.select("series_id", "t", "x"), ["series_id", "t"]).select("series_id", "t", "x", F.col("made").alias("y"))


# -- processes as plans: the outputs of well-known channels for given inputs

def _before(column: str, steps: int = 1) -> Column:
    return F.lag(column, steps).over(Window.partitionBy("series_id").orderBy("t"))


def delay(inputs: DataFrame, first: str = "0") -> DataFrame:
    """y is the input one step before."""
    return inputs.select("series_id", "t", "x", F.coalesce(_before("x"), F.lit(first)).alias("y"))


def period4(spark: SparkSession, length: int, word: str = "1001") -> DataFrame:
    return spark.range(length).select(F.lit(0).cast("long").alias("series_id"), F.col("id").alias("t"), F.lit("0").alias("x"), F.substring(F.lit(word), (F.col("id") % len(word) + 1).cast("int"), F.lit(1)).alias("y"))


def periodic_kick(inputs: DataFrame, period: int = 3) -> DataFrame:
    """A cycle of ones with a zero at its start, begun anew after every input of one."""
    order = Window.partitionBy("series_id").orderBy("t")
    kicked = inputs.withColumn("k", F.when(F.lag("x").over(order) == "1", F.col("t")))
    last = F.max("k").over(order.rowsBetween(Window.unboundedPreceding, 0))
    place = F.when(last.isNull(), F.col("t")).otherwise(F.col("t") - last - 1)
    y = F.when(F.col("t") == 0, "0").when(last == F.col("t"), "1").when(place % period == 0, "0").otherwise("1")
    return kicked.select("series_id", "t", "x", y.alias("y"))


def turn_machine(inputs: DataFrame, left: str = "1", right: str = "2") -> DataFrame:
    """Two positions: an input left or right answers 1 if it changes the position, one step later; others 0."""
    order = Window.partitionBy("series_id").orderBy("t")
    moves = inputs.withColumns({"m": F.lag("x").over(order), "turn": F.when(F.col("x").isin(left, right), F.col("x"))})
    was = F.coalesce(F.last("turn", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -2)), F.lit(left))
    return moves.select("series_id", "t", "x", F.when(F.col("m").isin(left, right) & (F.col("m") != was), "1").otherwise("0").alias("y"))


def z_channel(inputs: DataFrame, seed: int = 0, flip: float = 0.5) -> DataFrame:
    """Zeros pass; ones become zeros with probability ``flip``, by a digest of (seed, series, t)."""
    return inputs.select("series_id", "t", "x", F.when(F.col("x") == "0", "0").when(uniform(seed) < flip, "0").otherwise("1").alias("y"))


def odd_random(inputs: DataFrame, seed: int = 0) -> DataFrame:
    """A fair coin while the run of ones up to now is odd, else the input."""
    order = Window.partitionBy("series_id").orderBy("t")
    islands = inputs.withColumn("g", F.count_if(F.col("x") == "0").over(order))
    run = F.count_if(F.col("x") == "1").over(Window.partitionBy("series_id", "g").orderBy("t"))
    return islands.withColumn("run", run).select("series_id", "t", "x", F.when(F.col("run") % 2 == 1, F.when(uniform(seed) < 0.5, "0").otherwise("1")).otherwise(F.col("x")).alias("y"))


def uniform(seed: int) -> Column:
    """A number in [0, 1) fixed by seed, series and position: 32 bits of an MD5 digest of the three, colons between."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("series_id").cast("string"), F.col("t").cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def _process(inputs: DataFrame, states: list, start: object, rule, chunk: int = CHUNK) -> DataFrame:
    """Outputs of a rule (state, input before: '1', '0' or None, x, draw) -> (y, state), carried along each series."""

    def with_input(state: tuple, x: str, u: str) -> tuple[tuple, tuple]:
        y, after = rule(state[0], state[1], x, float(u))
        return (y,), (after, "1" if x == "1" else "0")

    return _drawn(inputs, [(s, b) for s in states for b in "01"], (start, None), with_input, 7, chunk)


def even_transducer(inputs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Ones come in pairs: after an odd run of ones always a one, else the input before."""

    def rule(odd: bool, before: str | None, x: str, u: float) -> tuple[str, bool]:
        if before is None:
            return "0", False
        return ("1", not odd) if odd or before == "1" else ("0", False)

    return _process(inputs, [False, True], False, rule, chunk)


def even_flip(inputs: DataFrame, up: float = 0.35, keep: float = 0.75, chunk: int = CHUNK) -> DataFrame:
    """Like the even transducer, with a one after an even run drawn: ``up`` after input 0, ``keep`` after 1."""

    def rule(odd: bool, before: str | None, x: str, u: float) -> tuple[str, bool]:
        if before is None:
            return "0", False
        if odd or u <= (keep if before == "1" else up):
            return "1", not odd
        return "0", False

    return _process(inputs, [False, True], False, rule, chunk)


def float_reset(inputs: DataFrame, top: int = 2, chunk: int = CHUNK) -> DataFrame:
    """A walk on 0 to ``top``: input 0 floats it a step either way, 1 resets it to the top; a reset at the top answers 1."""

    def rule(place: int, before: str | None, x: str, u: float) -> tuple[str, int]:
        if before is None:
            return "0", top
        if before == "1":
            return ("1" if place == top else "0"), top
        return "0", min(top, max(0, place + (-1 if u < 0.5 else 1)))

    return _process(inputs, list(range(top + 1)), top, rule, chunk)


def periodic_even_kick(inputs: DataFrame, period: int = 3, chunk: int = CHUNK) -> DataFrame:
    """The cycle of the periodic kick, begun anew after every even, non-empty run of input ones."""

    def rule(state: tuple[int, int], before: str | None, x: str, u: float) -> tuple[str, tuple[int, int]]:
        ones, place = state  # of the run of ones only that there is one and its parity matter: 0, odd as 1, even as 2
        if before is None:
            return "0", (int(x == "1"), 1 % period)
        if ones == 2:
            y, place = "1", 0
        else:
            y, place = ("0" if place == 0 else "1"), (place + 1) % period
        return y, ((2 if ones == 1 else 1) if x == "1" else 0, place)

    return _process(inputs, [(o, k) for o in range(3) for k in range(period)], (0, 1 % period), rule, chunk)


def lookup_process(inputs: DataFrame, table: dict[tuple[str, str], float], chunk: int = CHUNK) -> DataFrame:
    """Ones with the probability that the last inputs and outputs (as strings) have in ``table``; zeros until there are enough."""
    length = len(next(iter(table))[0])
    known = sorted({c for xs, _ in table for c in xs})
    other = next(c for c in "?~#" if c not in known)  # stands for inputs that no entry has

    def strings(symbols: list[str]) -> list[str]:
        return ["".join(w) for k in range(length + 1) for w in product(symbols, repeat=k)]

    def rule(past: tuple[str, str], x: str, u: str) -> tuple[tuple, tuple[str, str]]:
        p = table.get(past, 0.0)
        y = "1" if p > 0 and float(u) <= p else "0"
        return (y,), ((past[0] + (x if x in known else other))[-length:], (past[1] + y)[-length:])

    states = [(xs, ys) for xs in strings([*known, other]) for ys in strings(["0", "1"]) if len(xs) == len(ys)]
    return _drawn(inputs, states, ("", ""), rule, 7, chunk)
