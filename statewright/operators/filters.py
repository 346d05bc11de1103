"""Filtering: which state a series is in, and what it will do next.

Every filter cuts a long series into chunks.  Each chunk tells for whatever it
may be met in where that leads, these maps are composed in order (a small row per
chunk), and each chunk is then replayed from its start: two parallel passes over
the symbols, no task longer than a chunk.  For the suffix filter and the processes
of :mod:`.simulate` a map is from state to state.  A belief over pairs of states
is a mixture.  In unifilar models each pair goes one way until it dies, so a
chunk's map is where each pair ends and with what weight, or when it dies, and
what a fresh start after each such death comes to.  Where a label leads to
several states (a hidden Markov source), the map is the product of the chunk's
matrices, rescaled row by row, with the logarithm of what was taken out.
"""

from __future__ import annotations

import copy
import json
import math
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.small import held, pinned

CHUNK = 1 << 16
UNKNOWN = -1
#: Cells of the products of matrices that are made side by side.
PRODUCT_CELLS = 1 << 22


class SuffixModel:
    """State of each history and each transition, of one model."""

    def __init__(self, states: dict[tuple[str, str], int], steps: dict[tuple[int, str, str], int], length: int) -> None:
        self.states, self.steps, self.length = states, steps, length
        self.only = next(iter(states.values())) if len(set(states.values())) == 1 else None

    @classmethod
    def read(cls, histories: DataFrame, transitions: DataFrame, length: int) -> SuffixModel:
        """From model tables, which are as large as a model: bounded by its words, not by its data."""
        states = {(r["xs"], r["ys"]): r["state"] for r in held(histories.select("xs", "ys", "state"))}
        steps = {(r["s_from"], r["x"], r["y"]): r["s_to"] for r in held(transitions.select("s_from", "x", "y", "s_to"))}
        return cls(states, steps, length)

    def walk(self, state: int, xs: str, ys: str, first: int, start: int) -> list[int]:
        """States before each symbol from index ``start`` on; ``first`` is the series position of index 0."""
        out = []
        for i in range(start, len(ys) + 1):
            t = first + i
            if self.only is not None:
                state = self.only if t >= self.length - 1 else UNKNOWN
            elif t < self.length - 1:
                state = UNKNOWN
            elif t == self.length - 1:
                state = self.states.get((xs[i - self.length + 1 : i], ys[i - self.length + 1 : i]), UNKNOWN)
            elif state != UNKNOWN and i > 0:
                state = self.steps.get((state, xs[i - 1], ys[i - 1]), UNKNOWN)
                if state == UNKNOWN:
                    state = self.resync(xs, ys, i)
            else:
                state = self.resync(xs, ys, i)
            out.append(state)
        return out

    def resync(self, xs: str, ys: str, i: int) -> int:
        a = i - self.length
        return self.states.get((xs[a:i], ys[a:i]), UNKNOWN) if a >= 0 else UNKNOWN


def in_order(rows: DataFrame) -> DataFrame:
    """The rows of each chunk in one task, in order."""
    return rows.repartition("series_id", "part").sortWithinPartitions("series_id", "part", "t")


def met_in(rows: DataFrame, begins: DataFrame, unknown: Column) -> DataFrame:
    """``rows`` and, before each chunk's first one, a row of t = -1 with what the chunk is met in.

    Not a join: Spark would leave out the shuffle after a join by the same keys,
    and, where it then turns that join into a broadcast, read the rows as they lie,
    a chunk in several tasks.
    """
    told = begins.select("series_id", "part", F.lit(-1).cast("long").alias("t"), F.lit(None).cast("string").alias("x"), F.lit(None).cast("string").alias("y"), "begins")
    return rows.select("series_id", "part", "t", "x", "y", unknown.alias("begins")).unionByName(told)


def filter_states(symbols: DataFrame, model: SuffixModel, chunk: int = CHUNK) -> DataFrame:
    """series_id, t, state before each symbol (null while unknown)."""
    halo = model.length
    own = F.floor(F.col("t") / chunk)
    places = F.when(F.col("t") % chunk >= chunk - halo, F.array(own, own + 1)).otherwise(F.array(own))
    spread = symbols.select("series_id", "t", "x", "y", F.explode(places).alias("part"))
    key = symbols.schema["series_id"].dataType.simpleString()

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Where each chunk leads from each state it may be met in."""
        known = sorted(set(model.states.values()))
        at, cursors, last, out = None, [], -1, []

        def tell() -> None:
            if at is not None and last >= at[1] * chunk:  # else a halo with no symbols of its own after it
                out.extend((*at, start, cursor.upcoming()) for start, cursor in cursors)

        names = ["series_id", "part", "begins", "ends"]
        for rows in batches:
            out = []
            for s, part, t, x, y in zip(*(rows[c].tolist() for c in ("series_id", "part", "t", "x", "y")), strict=True):
                if (s, part) != at:
                    tell()
                    at = (s, part)
                    cursors = [(start, Cursor(model, part, chunk, start)) for start in ([UNKNOWN] if part == 0 else [UNKNOWN, *known])]
                for _, cursor in cursors:
                    cursor.take(t, x, y)
                last = t
            yield pd.DataFrame(out, columns=names)
        out = []
        tell()
        yield pd.DataFrame(out, columns=names)

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Which state each chunk is met in: a series' chunks come in order."""
        at, met, state, goals = None, None, UNKNOWN, {}
        for rows in batches:
            out = []
            for s, part, b, e in zip(*(rows[c].tolist() for c in ("series_id", "part", "begins", "ends")), strict=True):
                if (s, part) != (at, met):
                    state = goals.get(state, UNKNOWN) if s == at else UNKNOWN
                    at, met, goals = s, part, {}
                    out.append((s, part, state))
                goals[b] = e
            yield pd.DataFrame(out, columns=["series_id", "part", "begins"])

    # Only series of more than one chunk need the first pass.
    long = symbols.where(F.col("t") == chunk).select("series_id").distinct()
    maps = in_order(spread.join(long, "series_id", "left_semi")).mapInPandas(ends, f"series_id {key}, part bigint, begins bigint, ends bigint")
    by_series = maps.repartition("series_id").sortWithinPartitions("series_id", "part")
    begins = by_series.mapInPandas(compose, f"series_id {key}, part bigint, begins bigint")

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, cursor = None, None
        for rows in batches:
            out = []
            columns = (rows[c].tolist() for c in ("series_id", "part", "t", "x", "y", "begins"))
            for s, part, t, x, y, b in zip(*columns, strict=True):
                if (s, part) != at:
                    at, cursor = (s, part), Cursor(model, part, chunk, b)
                if t < 0:
                    continue
                state = cursor.take(t, x, y)
                if state is not None:
                    out.append((s, t, state))
            yield pd.DataFrame(out, columns=["series_id", "t", "state"])

    replayed = in_order(met_in(spread, begins, F.lit(UNKNOWN))).mapInPandas(replay, f"series_id {key}, t bigint, state bigint")
    return replayed.select("series_id", "t", F.when(F.col("state") != UNKNOWN, F.col("state")).alias("state"))


class Cursor:
    """Goes through one chunk: the halo before it only tells what came before."""

    def __init__(self, model: SuffixModel, part: int, chunk: int, state: int) -> None:
        self.model, self.first, self.state = model, part * chunk, state
        self.xs, self.ys, self.next, self.fresh = "", "", 0, True

    def take(self, t: int, x: str, y: str) -> int | None:
        """The state before this symbol; None in the halo."""
        self.next = t
        out = None
        if t >= self.first:
            if not (self.fresh and self.first > 0):  # a chunk's first symbol is met in the given state
                self.state = self.upcoming()
            self.fresh, out = False, self.state
        self.xs, self.ys, self.next = (self.xs + x)[-self.model.length :], (self.ys + y)[-self.model.length :], t + 1
        return out

    def upcoming(self) -> int:
        return self.model.walk(self.state, self.xs, self.ys, self.next - len(self.ys), len(self.ys))[0]


def predict(filtered: DataFrame, symbols: DataFrame, emission: DataFrame, ays: list[str], prior: float | None = None) -> DataFrame:
    """series_id, t, state, p (of the last symbol of ``ays``), y_pred: the likeliest output given state and input.

    Ties go to the earlier symbol.  Without a state p is ``prior`` (1 / outputs)
    and y_pred null.  ``emission``: state, x, y, p.
    """
    spread = emission.groupBy("state", "x").agg(*[F.coalesce(F.max(F.when(F.col("y") == y, F.col("p"))), F.lit(0.0)).alias(f"p_{i}") for i, y in enumerate(ays)])
    rows = filtered.join(symbols, ["series_id", "t"]).join(F.broadcast(pinned(spread)), ["state", "x"], "left")
    likeliest = F.lit(None).cast("string")
    best = F.greatest(*[F.col(f"p_{i}") for i in range(len(ays))]) if len(ays) > 1 else F.col("p_0")
    for i, y in reversed(list(enumerate(ays))):
        likeliest = F.when(F.col(f"p_{i}") == best, y).otherwise(likeliest)
    fallback = F.lit(prior if prior is not None else 1.0 / len(ays))
    return rows.select("series_id", "t", "y", "state", F.coalesce(f"p_{len(ays) - 1}", fallback).alias("p"), likeliest.alias("y_pred"))


def lagged_prior(filtered: DataFrame, symbols: DataFrame, emission: DataFrame, ays: list[str], prior: list[float] | None = None) -> DataFrame:
    """series_id, t, then p_<y> per output: predictions made from the state after the symbol before; the prior while unknown."""
    prior = prior or [1.0 / len(ays)] * len(ays)
    spread = emission.groupBy("state", "x").agg(*[F.max(F.when(F.col("y") == y, F.col("p"))).alias(f"_p{i}") for i, y in enumerate(ays)])
    rows = filtered.join(symbols, ["series_id", "t"]).join(F.broadcast(pinned(spread)), ["state", "x"], "left")
    known = F.col("_p0").isNotNull() if len(ays) == 1 else F.coalesce(*[F.col(f"_p{i}") for i in range(len(ays))]).isNotNull()
    return rows.select("series_id", "t", *[F.when(known, F.coalesce(f"_p{i}", F.lit(0.0))).otherwise(F.lit(prior[i])).alias(f"p_{y}") for i, y in enumerate(ays)])


class Belief:
    """Bayesian filter over pairs of a transducer state and a machine state.

    Edges are {(state, x, y): (next, p)} and {(state, x): (next, p)}, or lists of
    such pairs where a label leads to several states.

    ``mode``: 'restart' begins anew from the stationary distribution where a
    symbol is impossible; 'never' does not settle on one state; 'strict' raises.
    A transducer with a label of several goals doesn't settle in any mode: one
    state is not followed by one state.
    """

    def __init__(self, t_edges: dict, m_edges: dict, pi: dict[tuple, float], ays: list[str], mode: str = "restart") -> None:
        if mode not in ("restart", "never", "strict"):
            raise ValueError(f"unknown mode {mode!r}: restart, never or strict")
        listed = lambda edges: {k: v if isinstance(v, list) else [v] for k, v in edges.items()}
        self.t, self.m, self.pi, self.ays, self.mode = listed(t_edges), listed(m_edges), pi, ays, mode
        single = lambda edges: all(sum(p > 0 for _, p in goals) <= 1 for goals in edges.values())
        self.settles = mode != "never" and single(self.t)
        self.unifilar = single(self.t) and single(self.m)
        self.t_states = sorted({k[0] for k in self.t} | {to for goals in self.t.values() for to, _ in goals} | {k[0] for k in self.pi})
        self.m_states = sorted({k[0] for k in self.m} | {to for goals in self.m.values() for to, _ in goals} | {k[1] for k in self.pi})
        self.states = [(t, m) for t in self.t_states for m in self.m_states]
        self.at = {k: i for i, k in enumerate(self.states)}
        # What was asked of the models before: tables that copies share.
        self.answers, self.emitted, self.moved, self.matrices, self.forecasts = {}, {}, {}, {}, {}
        self.start()

    def anew_from(self, text: str | None) -> Belief:
        """Another belief over the same models, at the start or where ``text`` was written."""
        b = copy.copy(self)
        b.start()
        if text is not None:
            b.resume(text)
        return b

    def start(self) -> None:
        self.weights, self.synced = {k: w for k, w in self.pi.items() if w > 0}, None

    def answer(self, t: object, x: str) -> list[float]:
        """The probability of each output in one state of the transducer."""
        found = self.answers.get((t, x))
        if found is None:
            found = self.answers[t, x] = [sum(p for _, p in self.t.get((t, x, y), ())) for y in self.ays]
        return found

    def emits(self, m: object, x: str) -> float:
        found = self.emitted.get((m, x))
        if found is None:
            found = self.emitted[m, x] = sum(q for _, q in self.m.get((m, x), ()))
        return found

    def moves(self, pair: tuple, x: str, y: str) -> list[tuple[tuple, float]]:
        """Where a pair of states goes with a symbol, and its probability."""
        found = self.moved.get((pair, x, y))
        if found is None:
            t, m = pair
            both = (((t_to, m_to), p * q) for t_to, p in self.t.get((t, x, y), ()) for m_to, q in self.m.get((m, x), ()))
            found = self.moved[pair, x, y] = [(to, p) for to, p in both if p > 0]
        return found

    def forecast(self, x: str) -> list[float]:
        if self.synced is not None:
            return self.answer(self.synced, x)
        sums, total = [0.0] * len(self.ays), 0.0
        for (t, m), w in self.weights.items():
            a = w * self.emits(m, x)
            if a:
                total += a
                for i, p in enumerate(self.answer(t, x)):
                    sums[i] += a * p
        return [s / total for s in sums] if total else [float("nan")] * len(self.ays)

    def update(self, x: str, y: str) -> bool:
        """Take a pair in; whether it was impossible."""
        if self.synced is not None:
            for to, p in self.t.get((self.synced, x, y), ()):
                if p > 0:
                    self.synced = to
                    return False
        else:
            moved: dict[tuple, float] = {}
            for pair, w in self.weights.items():
                for to, p in self.moves(pair, x, y):
                    if w * p > 0:
                        moved[to] = moved.get(to, 0.0) + w * p
            total = sum(moved.values())
            if total > 0:
                self.weights = {k: w / total for k, w in moved.items()}
                possible = {t for t, _ in self.weights}
                if len(possible) == 1 and self.settles:
                    self.synced = possible.pop()
                return False
        if self.mode == "strict":
            raise ValueError(f"impossible pair ({x}, {y})")
        self.start()
        return True

    def possible(self) -> list:
        return [self.synced] if self.synced is not None else sorted({t for t, _ in self.weights})

    def written(self) -> str:
        return json.dumps([self.synced, [[*k, w] for k, w in self.weights.items()]])

    def resume(self, text: str) -> None:
        self.synced, weights = json.loads(text)
        self.weights = {(t, m): w for t, m, w in weights}

    # -- a chunk as a map of beliefs

    def maps_of(self, chunks: list[list[tuple[str, str]]]) -> list[dict]:
        return [self.ends_of(pairs) for pairs in chunks] if self.unifilar else self.products_of(chunks)

    def map_of(self, pairs: list[tuple[str, str]]) -> dict:
        return self.maps_of([pairs])[0]

    def ends_of(self, pairs: list[tuple[str, str]]) -> dict:
        """Where each state and pair goes along ``pairs``, and the belief at the end after a fresh start past each death."""
        alone, paths, deaths = self.alone_of(pairs)
        both = []
        for t, m in self.states:
            now, w = (t, m), 0.0
            for i, (x, y) in enumerate(pairs):
                goal = self.moves(now, x, y)
                if not goal:
                    deaths.add(i)
                    both.append([t, m, None, paths[t][i] if i < len(paths[t]) else None, i])
                    break
                now, p = goal[0]
                w += math.log(p)
            else:
                both.append([t, m, *now, w])
        return {"alone": alone, "both": both, "fresh": self.fresh_after(deaths, pairs)}

    @staticmethod
    def one(edges: dict, key: tuple) -> tuple:
        """The goal of a label that has one, and its probability."""
        return next((e for e in edges.get(key, ()) if e[1] > 0), (None, 0.0))

    def alone_of(self, pairs: list[tuple[str, str]]) -> tuple[dict, dict, set[int]]:
        """By transducer state: where it ends or when it dies, and the states on the way (before each pair); all times of death."""
        alone, paths, deaths = {}, {}, set()
        for t in self.t_states:
            here, paths[t] = t, []
            for i, (x, y) in enumerate(pairs):
                paths[t].append(here)
                to, p = self.one(self.t, (here, x, y))
                if p <= 0:
                    deaths.add(i)
                    alone[t] = [None, i]
                    break
                here = to
            else:
                alone[t] = [here, -1]
        return alone, paths, deaths

    def fresh_after(self, deaths: set[int], pairs: list[tuple[str, str]]) -> dict[str, str]:
        """The belief at the end of ``pairs`` after a fresh start past each of some places."""
        fresh: dict[str, str] = {}

        def run(d: int) -> str:
            self.start()
            for i in range(d + 1, len(pairs)):
                if self.update(*pairs[i]):  # from here on it is a fresh start past this place
                    return f"@{i}"
            return self.written()

        todo = sorted(deaths) if self.mode != "strict" else []
        while todo:
            d = todo.pop()
            if str(d) not in fresh:
                text = fresh[str(d)] = run(d)
                if text.startswith("@"):
                    todo.append(int(text[1:]))
        for d in sorted(map(int, fresh), reverse=True):
            if fresh[str(d)].startswith("@"):
                fresh[str(d)] = fresh[fresh[str(d)][1:]]
        return fresh

    # -- many runs side by side, as rows of one table of weights over all pairs of states

    def matrix(self, x: str, y: str) -> np.ndarray:
        found = self.matrices.get((x, y))
        if found is None:
            found = self.matrices[x, y] = np.zeros((len(self.states), len(self.states)))
            for pair, k in self.at.items():
                for to, p in self.moves(pair, x, y):
                    found[k, self.at[to]] += p
        return found

    def forecasting(self, x: str) -> np.ndarray:
        """By pair of states: the probability of the input, then of it with each output."""
        found = self.forecasts.get(x)
        if found is None:
            emits = np.array([self.emits(m, x) for _, m in self.states])
            found = self.forecasts[x] = np.column_stack([emits, emits[:, None] * np.array([self.answer(t, x) for t, _ in self.states])])
        return found

    def products_of(self, chunks: list[list[tuple[str, str]]]) -> list[dict]:
        """For each chunk the rows of its product of matrices, one for each pair of states that may be met: its goals and the logarithm of its scale, or when it dies."""
        out: list[dict] = []
        n = len(self.states)
        size = max(1, PRODUCT_CELLS // (n * n))
        for begin in range(0, len(chunks), size):
            some = chunks[begin : begin + size]
            rows = np.repeat(np.eye(n)[None], len(some), axis=0)
            scale, died = np.zeros((len(some), n)), np.full((len(some), n), -1)
            for i in range(max(map(len, some))):
                for (x, y), own in places_of(some, i).items():
                    moved = rows[own] @ self.matrix(x, y)
                    total = moved.sum(axis=2)
                    alive = total > 0
                    ends = died[own]
                    ends[~alive & (ends < 0)] = i
                    died[own] = ends
                    total[~alive] = 1.0
                    scale[own] += np.log(total)
                    rows[own] = moved / total[:, :, None]
            out += [self.product_row(pairs, rows[c], scale[c], died[c].tolist()) for c, pairs in enumerate(some)]
        return out

    def product_row(self, pairs: list[tuple[str, str]], rows: np.ndarray, scale: np.ndarray, died: list[int]) -> dict:
        alone, paths, deaths = self.alone_of(pairs) if self.settles else ({}, {}, set())
        goals = [[[*self.states[j], p] for j, p in enumerate(row) if p] for row in rows.tolist()]
        ways = []
        for k, ((t, m), end, taken) in enumerate(zip(self.states, died, scale.tolist(), strict=True)):
            before = paths[t][end] if paths and 0 <= end < len(paths[t]) else None
            ways.append([t, m, end, before, taken, goals[k]])
        return {"alone": alone, "product": ways, "fresh": self.fresh_after(deaths | {d for d in died if d >= 0}, pairs)}

    def steps(self, beliefs: list[Belief], runs: list[list[tuple[str, str]]]) -> list[tuple]:
        """Takes each run's pairs into its belief; a row for each pair, run after run."""
        if self.unifilar or self.settles:
            return [b.step(x, y) for b, pairs in zip(beliefs, runs, strict=True) for x, y in pairs]
        weights = np.zeros((len(runs), len(self.states)))
        start = np.zeros(len(self.states))
        for pair, w in self.pi.items():
            start[self.at[pair]] = max(w, 0.0)
        for c, b in enumerate(beliefs):
            for pair, w in b.weights.items():
                weights[c, self.at[pair]] = w
        of_t = np.array([[t == u for u in self.t_states] for t, _ in self.states], dtype=float)
        names: dict[bytes, list] = {}
        out: list[list[tuple]] = [[] for _ in runs]
        for i in range(max(map(len, runs))):
            for (x, y), own in places_of(runs, i).items():
                told = weights[own] @ self.forecasting(x)
                p = np.full((len(own), len(self.ays)), np.nan)
                np.divide(told[:, 1:], told[:, :1], out=p, where=told[:, :1] > 0)
                moved = weights[own] @ self.matrix(x, y)
                total = moved.sum(axis=1)
                dead = total <= 0
                if self.mode == "strict" and dead.any():
                    raise ValueError(f"impossible pair ({x}, {y})")
                total[dead] = 1.0
                moved /= total[:, None]
                moved[dead] = start
                weights[own] = moved
                possible, seen = (moved > 0).astype(float) @ of_t > 0, self.ays.index(y)
                for c, forecast, flags, forbidden in zip(own, p.tolist(), possible, dead.tolist(), strict=True):
                    key = flags.tobytes()
                    if key not in names:
                        names[key] = [t for t, f in zip(self.t_states, flags.tolist(), strict=True) if f]
                    out[c].append((*forecast, forecast[seen], names[key], forbidden))
        for b, row in zip(beliefs, weights.tolist(), strict=True):
            b.weights = {pair: w for pair, w in zip(self.states, row, strict=True) if w > 0}
        return [row for rows in out for row in rows]

    def step(self, x: str, y: str) -> tuple:
        p = self.forecast(x)
        forbidden = self.update(x, y)
        return (*p, p[self.ays.index(y)], self.possible(), forbidden)

    def follow(self, step: dict) -> None:
        """Go through a chunk by its map."""
        if self.synced is not None:
            self.follow_alone(step, self.synced)
            return
        if "product" in step:
            ways = {(t, m): rest for t, m, *rest in step["product"]}
            dead = [(ways[k][0], ways[k][1], k[0]) for k in self.weights if ways[k][0] >= 0]
            alive = [(w, *ways[k][2:]) for k, w in self.weights.items() if ways[k][0] < 0]
        else:
            ways = {(t, m): rest for t, m, *rest in step["both"]}
            dead = [(ways[k][2], ways[k][1], k[0]) for k in self.weights if ways[k][0] is None]
            alive = [(w, ways[k][2], [[*ways[k][:2], 1.0]]) for k, w in self.weights.items() if ways[k][0] is not None]
        if alive:
            top = max(scale for _, scale, _ in alive)
            moved: dict[tuple, float] = {}
            for w, scale, goals in alive:
                for t, m, p in goals:
                    moved[t, m] = moved.get((t, m), 0.0) + w * math.exp(scale - top) * p
            total = sum(moved.values())
            self.weights = {k: w / total for k, w in moved.items() if w > 0}
            possible = {t for t, _ in self.weights}
            if len(possible) == 1 and self.settles:
                self.synced = possible.pop()
            return
        last = max((d for d, _, _ in dead), default=0)
        before = {t for d, t, _ in dead if d == last}
        if len(before) == 1 and last > 0 and self.settles:  # one state was left: it goes on whatever the machine does
            self.follow_alone(step, next(start for d, _, start in dead if d == last))
        else:
            self.anew(step, last)

    def follow_alone(self, step: dict, t: str) -> None:
        to, death = step["alone"].get(t, [None, 0])
        if to is not None:
            self.synced = to
        else:
            self.anew(step, death)

    def anew(self, step: dict, death: int) -> None:
        if self.mode == "strict":
            raise ValueError("impossible pair")
        self.resume(step["fresh"][str(death)])


def places_of(runs: list[list[tuple[str, str]]], i: int) -> dict[tuple[str, str], list[int]]:
    """Which runs have each pair at place ``i``."""
    found: dict[tuple[str, str], list[int]] = {}
    for c, pairs in enumerate(runs):
        if i < len(pairs):
            found.setdefault(pairs[i], []).append(c)
    return found


def runs_of(keys: list[tuple]) -> list[tuple[int, int]]:
    """Where each run of equal keys begins and ends."""
    cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
    return list(zip(cuts, cuts[1:], strict=False)) if keys else []


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[list[pd.DataFrame]]:
    """Sorted rows as lists of whole groups: the last group of a batch waits for the next one."""
    waiting: list[pd.DataFrame] = []
    at = None
    for rows in batches:
        groups, told = [], list(zip(*(rows[k].tolist() for k in keys), strict=True))
        for a, b in runs_of(told):
            if told[a] != at:
                if waiting:
                    groups.append(pd.concat(waiting) if len(waiting) > 1 else waiting[0])
                at, waiting = told[a], []
            waiting.append(rows.iloc[a:b])
        yield groups
    if waiting:
        yield [pd.concat(waiting) if len(waiting) > 1 else waiting[0]]


def folded(
    symbols: DataFrame,
    chunk: int,
    maps_of: Callable[[list[list[tuple]]], list[str]],
    compose: Callable[[list[str]], list[str]],
    begin: Callable[[str | None], object],
    steps: Callable[[list, list[list[tuple]]], list[tuple]],
    shape: str,
    names: list[str],
) -> DataFrame:
    """Carries a state along each series in order, chunk by chunk.

    ``maps_of`` writes what the (x, y) of each of some chunks do, ``compose`` what
    each chunk of a series is met in, given the chunks' maps in order; ``begin``
    makes the state from that (None at the start of a series), ``steps`` takes the
    pairs of some runs into their states and returns the columns ``names`` of each
    pair, run after run.  Chunks are rows in order, many to a task: none of the
    three passes calls Python for a chunk alone.
    """
    key = symbols.schema["series_id"].dataType.simpleString()
    placed = symbols.select("series_id", "t", "x", "y", F.floor(F.col("t") / chunk).alias("part"))
    # Only series of more than one chunk need maps, and their last chunk's isn't used.
    sizes = symbols.groupBy("series_id").agg(F.max("t").alias("last")).where(F.col("last") >= chunk)
    long = placed.join(sizes, "series_id").where(F.col("part") < F.floor(F.col("last") / chunk))

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, pairs, found = None, [], []

        def written() -> pd.DataFrame:
            told = maps_of([p for _, p in found]) if found else []
            return pd.DataFrame({"series_id": [s for (s, _), _ in found], "part": [p for (_, p), _ in found], "map": told})

        for rows in batches:
            found = []
            told = list(zip(rows["series_id"].tolist(), rows["part"].tolist(), strict=True))
            taken = list(zip(rows["x"].tolist(), rows["y"].tolist(), strict=True))
            for a, b in runs_of(told):
                if told[a] != at:
                    if at is not None:
                        found.append((at, pairs))
                    at, pairs = told[a], []
                pairs += taken[a:b]
            yield written()
        if at is not None:
            found = [(at, pairs)]
            yield written()

    def composed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for groups in whole_groups(batches, ["series_id"]):
            for rows in groups:
                yield pd.DataFrame({"series_id": rows["series_id"], "part": rows["part"] + 1, "begins": compose(rows["map"].tolist())})

    maps = in_order(long.select("series_id", "part", "t", "x", "y")).mapInPandas(mapped, f"series_id {key}, part bigint, map string")
    by_series = maps.repartition("series_id").sortWithinPartitions("series_id", "part")
    begins = by_series.mapInPandas(composed, f"series_id {key}, part bigint, begins string")

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last = None, None
        for rows in batches:
            told = list(zip(rows["series_id"].tolist(), rows["part"].tolist(), strict=True))
            taken, starts = list(zip(rows["x"].tolist(), rows["y"].tolist(), strict=True)), rows["begins"].tolist()
            bounds = runs_of(told)
            states = [last if told[a] == at else begin(starts[a] if isinstance(starts[a], str) else None) for a, _ in bounds]
            times = rows["t"].to_numpy()
            own = times >= 0
            taken = [taken[a + (times[a] < 0) : b] for a, b in bounds]
            frame = pd.DataFrame(steps(states, taken) if bounds else [], columns=names)
            frame.insert(0, "t", times[own])
            frame.insert(0, "series_id", rows["series_id"].to_numpy()[own])
            if bounds:
                at, last = told[-1], states[-1]
            yield frame

    met = met_in(placed, begins, F.lit(None).cast("string"))
    return in_order(met).mapInPandas(replay, f"series_id {key}, t bigint, {shape}")


def folded_states(symbols: DataFrame, states: list[Hashable], first: Hashable, rule: Callable[[Hashable, str, str], tuple[tuple, Hashable]], shape: str, names: list[str], chunk: int = CHUNK) -> DataFrame:
    """Outputs of a rule (state, x, y) -> (columns, state) along each series, for a finite set of states (beside the first)."""

    class Run:
        def __init__(self, state: Hashable) -> None:
            self.state = state

    def maps_of(chunks: list[list[tuple]]) -> list[str]:
        out = []
        for pairs in chunks:
            ends = []
            for state in [first, *states]:
                for x, y in pairs:
                    _, state = rule(state, x, y)
                ends.append(states.index(state))
            out.append(json.dumps(ends))
        return out

    def compose(maps: list[str]) -> list[str]:
        at, out = 0, []
        for m in maps:
            at = json.loads(m)[at] + 1
            out.append(str(at - 1))
        return out

    def steps(runs: list[Run], taken: list[list[tuple]]) -> list[tuple]:
        rows = []
        for run, pairs in zip(runs, taken, strict=True):
            for x, y in pairs:
                out, run.state = rule(run.state, x, y)
                rows.append(out)
        return rows

    return folded(symbols, chunk, maps_of, compose, lambda b: Run(first if b is None else states[int(b)]), steps, shape, names)


def goals_by_label(edges: DataFrame, label: list[str]) -> dict[tuple, list[tuple[str, float]]]:
    """The goals and probabilities of each label of a model's edges; edges between the same states add up."""
    out: dict[tuple, dict[str, float]] = {}
    for r in held(edges.select(*label, "s_to", "p").where("p > 0")):
        goals = out.setdefault((str(r[label[0]]), *(r[c] for c in label[1:])), {})
        goals[str(r["s_to"])] = goals.get(str(r["s_to"]), 0.0) + r["p"]
    return {k: sorted(v.items()) for k, v in out.items()}


def belief_filter(symbols: DataFrame, edges_m: DataFrame, edges_t: DataFrame, pi: DataFrame, ays: list[str], mode: str = "restart", chunk: int = CHUNK) -> DataFrame:
    """series_id, t, p_<y> before each output, p_seen of the one that came, states possible after it, forbidden; ``pi``: t, m, pi."""
    t_edges, m_edges = goals_by_label(edges_t, ["s_from", "x", "y"]), goals_by_label(edges_m, ["s_from", "x"])
    start = {(str(r["t"]), str(r["m"])): r["pi"] for r in held(pi)}
    model = Belief(t_edges, m_edges, start, ays, mode)

    def compose(maps: list[str]) -> list[str]:
        b, out = model.anew_from(None), []
        for m in maps:
            b.follow(json.loads(m))
            out.append(b.written())
        return out

    names = [f"p_{y}" for y in ays]
    shape = ", ".join(f"`{n}` double" for n in names) + ", p_seen double, states array<string>, forbidden boolean"
    return folded(symbols, chunk, lambda chunks: [json.dumps(m) for m in model.maps_of(chunks)], compose, model.anew_from, model.steps, shape, [*names, "p_seen", "states", "forbidden"])


def next_symbol(edges_m: DataFrame, pi: DataFrame, past: str) -> DataFrame:
    """x, p: the machine's next symbol after ``past`` from every state it may have begun in; no row if the past is impossible.  ``pi``: state, pi.

    Only edges with the observed symbols are joined.
    """
    now = pi.where("pi > 0").select(F.col("state").alias("s"), F.col("pi").alias("w"))
    steps = edges_m.where("p > 0").select(F.col("s_from").alias("s"), "x", "s_to", "p")
    for symbol in past:
        now = now.join(steps.where(F.col("x") == symbol), "s").groupBy(F.col("s_to").alias("s")).agg(F.sum(F.col("w") * F.col("p")).alias("w"))
    following = now.join(steps, "s").groupBy("x").agg(F.sum(F.col("w") * F.col("p")).alias("w"))
    return following.select("x", (F.col("w") / F.sum("w").over(Window.partitionBy(F.lit(1)))).alias("p"))  # one row per symbol


def next_output(edges_m: DataFrame, edges_t: DataFrame, pi: DataFrame, xs: str, past: str) -> DataFrame:
    """y, p: P(y | inputs ``xs``, outputs ``past``), the current input being the last; no row if impossible."""
    from .algebra import _pairs

    moves = _pairs(edges_m, edges_t).select(F.col("t_from").alias("t"), F.col("m_from").alias("m"), "x", "y", "t_to", "m_to", (F.col("p_m") * F.col("p_t")).alias("p"))
    now = pi.where("pi > 0").select("t", "m", F.col("pi").alias("w"))
    for x, y in zip(xs, past, strict=False):
        step = moves.where((F.col("x") == x) & (F.col("y") == y))
        now = now.join(step, ["t", "m"]).groupBy(F.col("t_to").alias("t"), F.col("m_to").alias("m")).agg(F.sum(F.col("w") * F.col("p")).alias("w"))
    last = now.join(moves.where(F.col("x") == xs[-1]), ["t", "m"]).groupBy("y").agg(F.sum(F.col("w") * F.col("p")).alias("w")).where("w > 0")
    return last.select("y", (F.col("w") / F.sum("w").over(Window.partitionBy(F.lit(1)))).alias("p"))
