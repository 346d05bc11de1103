"""Causal-state inference: histories with equal next-output distributions become states.

Counting is a distributed aggregation; what a model needs of it is bounded by
the words observed, whatever the length of the series.  The clustering itself
depends on order (a state's counts grow as histories join it), so each model is
one ordered task of a grouped map; models (data sets, lengths, levels,
replicates) run side by side.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.small import pinned
from ..functions.stats import homogeneity_test
from .counts import morphs_from_filtered, word_counts
from .graph import NoRecurrentPart, history_transitions, recurrent

History = tuple[str, str]
Morph = list[list[float]]


@dataclass
class Clustering:
    """Histories by state while they are being sorted; states in order of creation, histories in order of joining."""

    counts: dict[tuple[str, str], int]
    axs: list[str]
    ays: list[str]
    length: int
    alpha: float = 0.001
    kind: str = "chi2"
    current_input: bool = True
    past_outputs: list[str] | None = None
    members: dict[int, list[History]] = field(default_factory=dict)
    sums: dict[int, Morph] = field(default_factory=dict)
    made: int = 0

    def morph(self, h: History) -> Morph:
        """Counts of outputs after a history, a row per current input (one row if that isn't conditioned on)."""
        if self.current_input:
            return [[self.counts.get((h[0] + x, h[1] + y), 0) for y in self.ays] for x in self.axs]
        return [[self.counts.get((h[0], h[1] + y), 0) for y in self.ays]]

    def add(self, state: int, m: Morph, sign: int = 1) -> None:
        self.sums[state] = [[a + sign * b for a, b in zip(r, s, strict=True)] for r, s in zip(self.sums[state], m, strict=True)]

    def open(self, h: History, m: Morph) -> int:
        state, self.made = self.made, self.made + 1
        self.members[state], self.sums[state] = [h], [list(r) for r in m]
        return state

    def drop(self, state: int, h: History) -> None:
        self.members[state].remove(h)
        if self.members[state]:
            self.add(state, self.morph(h), -1)
        else:
            del self.members[state], self.sums[state]

    def grow(self) -> None:
        """Lengthen histories one pair at a time; each child stays with its parent, joins its best match, or opens a state."""
        self.open(("", ""), self.morph(("", "")))
        for depth in range(self.length):
            for state in list(self.members):
                for parent in [h for h in self.members.get(state, []) if max(len(h[0]), len(h[1])) == depth]:
                    self.split(state, parent)

    def split(self, state: int, parent: History) -> None:
        stayed = False
        for y in self.past_outputs or self.ays:
            for x in self.axs:
                child = (x + parent[0], y + parent[1])
                m = self.morph(child)
                if not any(map(any, m)):
                    continue
                differs, _ = homogeneity_test(m, self.sums[state], self.alpha, self.kind)
                home = state if not differs else self.match(m, state)
                stayed |= home == state
                if home is None:
                    self.open(child, m)
                else:
                    self.members[home].append(child)
                    self.add(home, m)
        if not stayed:
            self.drop(state, parent)

    def match(self, m: Morph, besides: int) -> int | None:
        """The other state least unlike ``m``, the first of equals, if it is not rejected."""
        best, best_p = None, self.alpha
        for other, s in self.sums.items():
            if other != besides:
                p = homogeneity_test(m, s, self.alpha, self.kind)[1]
                if p is not None and p > best_p:
                    best, best_p = other, p
        return best

    def trim(self) -> None:
        for state in list(self.members):
            for h in [h for h in self.members[state] if len(h[0]) < self.length - 1]:
                self.drop(state, h)

    # -- transitions

    def owners(self) -> dict[History, int]:
        return {h: s for s, hs in self.members.items() for h in hs}

    def following(self, h: History, x: str, y: str) -> History:
        """The history after ``h`` and a pair; full-length ones lose their oldest pair."""
        cut = 1 if len(h[0]) >= self.length else 0
        return h[0][cut:] + x, h[1][cut:] + y

    def steps(self) -> Iterable[tuple[int, str, str, int]]:
        """(state, x, y, next state) by the histories that speak for each state, in their order."""
        owner = self.owners()
        for state, hs in self.members.items():
            short = [h for h in hs if len(h[0]) == self.length - 1]
            for h in short or hs:
                for x in self.axs:
                    for y in self.past_outputs or self.ays:
                        to = owner.get(self.following(h, x, y))
                        if to is not None:
                            yield state, x, y, to

    def keep_recurrent(self) -> None:
        edges = {(a, b) for a, _, _, b in self.steps()}
        kept = recurrent(list(self.members), edges)
        for state in [s for s in self.members if s not in kept]:
            del self.members[state], self.sums[state]

    def determinise(self) -> None:
        """Split states until all histories of a state agree on the next state for each pair.

        What is still to be looked at lies in a heap, in the order of states and
        pairs.  A split puts back the two states it leaves, and by an inverse index
        the pairs of those states whose histories lead to one that moved; what was
        found in order and isn't put back is still in order.
        """
        labels = [(x, y) for x in self.axs for y in self.past_outputs or self.ays]
        members = {s: dict.fromkeys(hs) for s, hs in self.members.items()}
        owner = self.owners()
        leading: dict[History, list[tuple[History, int]]] = {}
        for h in owner:
            for i, pair in enumerate(labels):
                if (goal := self.following(h, *pair)) in owner:
                    leading.setdefault(goal, []).append((h, i))
        heap = [(s, i) for s in members for i in range(len(labels))]
        heapq.heapify(heap)
        waiting = set(heap)

        def again(state: int, label: int) -> None:
            if (state, label) not in waiting:
                waiting.add((state, label))
                heapq.heappush(heap, (state, label))

        while heap:
            state, label = heapq.heappop(heap)
            waiting.discard((state, label))
            goals = [(h, owner.get(self.following(h, *labels[label]))) for h in members[state]]
            known = [(h, g) for h, g in goals if g is not None]
            other = next((g for _, g in known if g != known[0][1]), None)
            if other is None:
                continue
            moving = [h for h, g in known if g == other]
            fresh = self.open(moving[0], self.morph(moving[0]))
            for h in moving[1:]:
                self.add(fresh, self.morph(h))
            for h in moving:
                self.add(state, self.morph(h), -1)
                del members[state][h]
                owner[h] = fresh
            members[fresh] = dict.fromkeys(moving)
            for i in range(len(labels)):
                again(state, i)
                again(fresh, i)
            for h in moving:
                for before, i in leading.get(h, ()):
                    again(owner[before], i)
        self.members = {s: list(hs) for s, hs in members.items()}

    def run(self) -> Clustering:
        self.grow()
        self.trim()
        self.keep_recurrent()
        self.determinise()
        self.keep_recurrent()
        return self


def canonical(states: list[int], steps: dict[tuple[int, str, str], int], first: int) -> str:
    """A text equal for machines of one topology: states renamed in the order a walk from ``first`` meets them."""
    name, todo, lines = {first: 0}, [first], []
    for here in todo:
        for (s, x, y), to in sorted(steps.items(), key=lambda kv: kv[0][1:]):
            if s != here:
                continue
            if to not in name:
                name[to] = len(name)
                todo.append(to)
            lines.append(f"{name[here]}>{name[to]}:{y}|{x}")
    return f"{len(states)};" + ";".join(lines)


def clustering_of(rows: pd.DataFrame, axs: list[str], ays: list[str], length: int, **options: object) -> Clustering:
    counts = {(x, y): n for x, y, n in zip(rows["xs"], rows["ys"], rows["n"].tolist(), strict=True)}
    return Clustering(counts, axs, ays, length, **options).run()


def infer(words: DataFrame, axs: list[str], ays: list[str], length: int, alpha: float = 0.001, kind: str = "chi2", current_input: bool = True, output_memoryless: bool = False, skip_transient: bool = False) -> DataFrame:
    """histories(model_id, state, ord, xs, ys) from word counts (model_id, xs, ys, n); one task per model.

    States are numbered from 0 in order of creation.  A model without any
    recurrent state raises, or with ``skip_transient`` has no rows.
    """
    options = {"alpha": alpha, "kind": kind, "current_input": current_input, "past_outputs": ["n"] if output_memoryless else None}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names = ["model_id", "state", "ord", "xs", "ys"]
        try:
            found = clustering_of(rows, axs, ays, length, **options)
        except NoRecurrentPart:
            if skip_transient:
                return pd.DataFrame([], columns=names)
            raise
        return pd.DataFrame([(rows["model_id"].iloc[0], k, i, *h) for k, hs in enumerate(found.members.values()) for i, h in enumerate(hs)], columns=names)

    shape = f"model_id {words.schema['model_id'].dataType.simpleString()}, state int, ord int, xs string, ys string"
    return words.select("model_id", "xs", "ys", "n").groupBy("model_id").applyInPandas(run, shape)


def morphs(histories: DataFrame, words: DataFrame) -> DataFrame:
    """model_id, state, x, y, n: next-output counts summed over each state's histories."""
    nexts = words.select("model_id", F.expr("left(xs, length(ys) - 1)").alias("hx"), F.expr("left(ys, length(ys) - 1)").alias("hy"), F.expr("right(xs, 1)").alias("x"), F.expr("right(ys, 1)").alias("y"), "n")
    own = histories.select("model_id", "state", F.col("xs").alias("hx"), F.col("ys").alias("hy"))
    return own.join(nexts, ["model_id", "hx", "hy"]).groupBy("model_id", "state", "x", "y").agg(F.sum("n").alias("n"))


def emission(morph: DataFrame) -> DataFrame:
    """The counts with p = P(y | x, state)."""
    from pyspark.sql import Window

    return morph.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("model_id", "state", "x")))


def edges(transitions: DataFrame, morph: DataFrame) -> DataFrame:
    """model_id, s_from, x, y, s_to, p: transitions with their probabilities."""
    p = emission(morph).select("model_id", F.col("state").alias("s_from"), "x", "y", "p")
    return transitions.join(p, ["model_id", "s_from", "x", "y"]).select("model_id", "s_from", "x", "y", "s_to", "p")


@dataclass
class Model:
    """A fitted model as tables: histories(model_id, state, ord, xs, ys), transitions(.., s_from, x, y, s_to), morph(.., state, x, y, n), edges(.., s_from, x, y, s_to, p)."""

    histories: DataFrame
    transitions: DataFrame
    morph: DataFrame
    edges: DataFrame
    length: int

    def save(self, path: str) -> None:
        for name in MODEL_TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        self.edges.sparkSession.range(1).selectExpr(f"{self.length} AS length").write.mode("overwrite").parquet(f"{path}/length")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        return cls(*[read(name) for name in MODEL_TABLES], read("length").first()["length"])


MODEL_TABLES = ("histories", "transitions", "morph", "edges")


def fitted(symbols: DataFrame, axs: list[str], ays: list[str], length: int, alpha: float = 0.001, kind: str = "chi2", longest: int | None = None, reestimate: bool = False, model_id: str = "model") -> Model:
    """The model of a symbol table, its words counted once (to ``longest``, if that is more than ``length``).

    ``reestimate`` counts outputs anew by the states that filtering assigns to
    each position, instead of by the histories that make up a state.
    """
    words = pinned(word_counts(symbols, longest or length)).withColumn("model_id", F.lit(model_id))
    return fitted_words(words.where(F.col("k") <= length + 1), axs, ays, length, alpha, kind, symbols if reestimate else None)


def fitted_words(words: DataFrame, axs: list[str], ays: list[str], length: int, alpha: float = 0.001, kind: str = "chi2", refilter: DataFrame | None = None, skip_transient: bool = False) -> Model | None:
    """The model of counted words of one model_id; outputs counted anew along ``refilter``, if given.

    A model without any recurrent state raises, or with ``skip_transient`` is None.
    """
    from .filters import SuffixModel, filter_states

    found = pinned(infer(words, axs, ays, length, alpha, kind, skip_transient=skip_transient))
    if skip_transient and not found.head(1):
        return None
    emissions = found.sparkSession.createDataFrame([(x, y) for x in axs for y in ays], "x string, y string")
    transitions = pinned(history_transitions(found, emissions, length))
    morph = morphs(found, words)
    if refilter is not None:
        model = SuffixModel.read(found, transitions, length)
        model_id = found.select("model_id").first()[0]
        counted = morphs_from_filtered(filter_states(refilter, model), refilter)
        morph = counted.select(F.lit(model_id).alias("model_id"), F.col("state").cast("int").alias("state"), "x", "y", "n")
    morph = pinned(morph)
    return Model(found, transitions, morph, pinned(edges(transitions, morph)), length)
