"""State graphs: transitions of histories, strong components, recurrent parts, word maps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.small import HELD_ROWS, pinned, settled


class NoRecurrentPart(ValueError):
    """Every state of a model is transient: data too short or too varied for the length asked for."""


def strong_components(nodes: list, edges: set[tuple]) -> dict:
    """Component number of each node; two nodes share one if each reaches the other."""
    out: dict[int, list[int]] = {n: [] for n in nodes}
    back: dict[int, list[int]] = {n: [] for n in nodes}
    for a, b in edges:
        out[a].append(b)
        back[b].append(a)
    finished: list[int] = []
    seen: set[int] = set()
    for n in nodes:
        stack = [(n, iter(out[n]))] if n not in seen else []
        seen.add(n)
        while stack:
            here, rest = stack[-1]
            following = next((x for x in rest if x not in seen), None)
            if following is None:
                finished.append(here)
                stack.pop()
            else:
                seen.add(following)
                stack.append((following, iter(out[following])))
    label: dict[int, int] = {}
    for n in reversed(finished):
        if n in label:
            continue
        todo, label[n] = [n], n
        while todo:
            for x in back[todo.pop()]:
                if x not in label:
                    label[x] = n
                    todo.append(x)
    least: dict[int, int] = {}
    for n, c in label.items():
        least[c] = min(least.get(c, n), n)
    return {n: least[c] for n, c in label.items()}


def recurrent(nodes: list[int], edges: set[tuple[int, int]]) -> set[int]:
    """States of the component that none leaves; of several, of the one with the most states, then the least number."""
    label = strong_components(nodes, edges)
    leaving = {a for a, b in edges if label[a] != label[b]}
    kept = [n for n in nodes if n not in leaving]
    inner = {(a, b) for a, b in edges if a not in leaving and b not in leaving}
    label = strong_components(kept, inner)
    sizes: dict[int, int] = {}
    for c in label.values():
        sizes[c] = sizes.get(c, 0) + 1
    if not sizes:
        raise NoRecurrentPart("every state is transient: no recurrent part")
    best = min(sizes, key=lambda c: (-sizes[c], c))
    return {n for n in kept if label[n] == best}


def history_transitions(histories: DataFrame, emissions: DataFrame, length: int, memoryless: bool = False) -> DataFrame:
    """model_id, s_from, x, y, s_to from ``histories(model_id, state, ord, xs, ys)``.

    ``memoryless``: past outputs are masked, so every output leads to the same state.

    A history of full length loses its oldest pair first.  A state that owns
    histories of length L - 1 moves by these only; of several, the last counts.
    """
    sized = histories.withColumn("len", F.length("ys"))
    short = F.max((F.col("len") == length - 1).cast("int")).over(Window.partitionBy("model_id", "state"))
    used = sized.withColumn("short", short).where((F.col("short") == 0) | (F.col("len") == length - 1))
    grown = used.join(F.broadcast(pinned(emissions.select("x", "y"))))  # as many rows as histories times emissions
    seen = F.lit("n") if memoryless else F.col("y")
    drop = F.when(F.col("len") >= length, 2).otherwise(1)
    nexts = grown.select("model_id", F.col("state").alias("s_from"), "ord", "x", "y", F.substring(F.concat("xs", "x"), drop, F.lit(length)).alias("nx"), F.substring(F.concat("ys", seen), drop, F.lit(length)).alias("ny"))
    goals = histories.select("model_id", F.col("state").alias("s_to"), F.col("xs").alias("nx"), F.col("ys").alias("ny"))
    found = nexts.join(goals, ["model_id", "nx", "ny"])
    return found.groupBy("model_id", "s_from", "x", "y").agg(F.max_by("s_to", "ord").alias("s_to"))


def components_of(edges: DataFrame) -> DataFrame:
    """model_id, state, component, recurrent for edge tables (model_id, s_from, s_to): one task per model."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted({*part["s_from"], *part["s_to"]})
        pairs = set(zip(part["s_from"].tolist(), part["s_to"].tolist(), strict=True))
        label, kept = strong_components(nodes, pairs), recurrent(nodes, pairs)
        return pd.DataFrame({"model_id": part["model_id"].iloc[0], "state": nodes, "component": [label[n] for n in nodes], "recurrent": [n in kept for n in nodes]})

    shape = f"model_id {edges.schema['model_id'].dataType.simpleString()}, state bigint, component bigint, recurrent boolean"
    lean = edges.select("model_id", F.col("s_from").cast("long").alias("s_from"), F.col("s_to").cast("long").alias("s_to")).distinct()
    return lean.groupBy("model_id").applyInPandas(run, shape)


def reachable(edges: DataFrame) -> DataFrame:
    """s_from, s_to: all pairs joined by a path; only pairs found in the last round are lengthened.

    As many rows as there are pairs: for components see :func:`mutual_components`,
    for what a few states lead to :func:`reachable_from`.
    """
    direct = pinned(edges.select("s_from", "s_to").distinct())
    step = direct.select(F.col("s_from").alias("s_to"), F.col("s_to").alias("s_next"))
    found = fresh = direct
    while fresh.head(1):
        longer = fresh.join(step, "s_to").select("s_from", F.col("s_next").alias("s_to")).distinct()
        fresh = pinned(longer.join(found, ["s_from", "s_to"], "left_anti"))
        found = pinned(found.unionByName(fresh))
    return found


def reachable_from(edges: DataFrame, states: DataFrame) -> DataFrame:
    """state: ``states(state)`` and all that they lead to, a frontier at a time."""
    step = pinned(edges.select("s_from", "s_to").distinct())
    found = fresh = pinned(states.select("state").distinct())
    while fresh.head(1):
        met = fresh.join(step, fresh["state"] == step["s_from"]).select(F.col("s_to").alias("state")).distinct()
        fresh = pinned(met.join(found, "state", "left_anti"))
        found = pinned(found.unionByName(fresh))
    return found


# -- strong components of a graph of any size, without a bound on the length of paths


def _turned(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))


def _trimmed(pairs: DataFrame) -> DataFrame:
    """Without the edges of states that none leads to or that lead to none: each is a component of its own."""
    inner = pairs.join(pairs.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
    return inner.join(pairs.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")


def _merged(pairs: DataFrame, salt: int) -> DataFrame | None:
    """into, state: states with one way out that merge with where it leads; None if no state has one way out.

    Which of a chain's states go is drawn anew each round; none of them is the
    goal of another one, so that a round can be undone by itself.
    """
    ones = settled(pairs.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b")).where("n = 1").select("a", "b"))
    if not ones.head(1):
        return None
    drawn = lambda c: F.xxhash64(c, F.lit(salt))
    going = ones.where(drawn("a") > drawn("b"))
    return settled(going.join(going.select(F.col("a").alias("b")), "b", "left_anti").select(F.col("b").alias("into"), F.col("a").alias("state")))


def _without_chains(pairs: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """Edges among the states left when no state has one way out or one way in.

    A state with one way out is in the component of where that leads if one of
    the states that lead to it is.  ``rounds`` gets a table per round: state, into,
    near (those states), from which :func:`_told` reads it once they are known.
    """
    salt, idle = 0, 0
    while idle < 2 and pairs.head(1):
        salt += 1
        turned = salt % 2 == 0
        way = _turned(pairs) if turned else pairs
        merged = _merged(way, salt)
        if merged is None:
            idle += 1
            continue
        idle = 0
        rounds.append(settled(way.join(merged, way["b"] == merged["state"]).select("state", "into", F.col("a").alias("near"))))
        gone = merged.select(F.col("state").alias("a"))
        moved = way.join(gone, "a", "left_anti").join(merged, F.col("b") == merged["state"], "left").select("a", F.coalesce("into", "b").alias("b")).where("a <> b").distinct()
        pairs = settled(_trimmed(_turned(moved) if turned else moved))
    return pairs


def _coloured(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """state, root of the components found in one sweep, and the edges inside what is left.

    Each state takes the least state that leads to it; of one colour, those that
    lead back to that state are its component.
    """
    colours = settled(pairs.select(F.col("a").alias("state")).unionByName(pairs.select(F.col("b").alias("state"))).distinct().withColumn("colour", F.col("state")))
    while True:
        offered = pairs.join(colours.select(F.col("state").alias("a"), F.col("colour").alias("offer")), "a").groupBy(F.col("b").alias("state")).agg(F.min("offer").alias("offer"))
        better = settled(colours.join(offered, "state").where(F.col("offer") < F.col("colour")).select("state", "offer"))
        if not better.head(1):
            break
        colours = settled(colours.join(better, "state", "left").select("state", F.coalesce("offer", "colour").alias("colour")))
    one, two = (colours.select(F.col("state").alias(c), F.col("colour").alias(f"colour_{c}")) for c in "ab")
    inner = settled(pairs.join(one, "a").join(two, "b").where("colour_a = colour_b").select("a", "b", F.col("colour_a").alias("colour")))
    found = fresh = settled(colours.where("state = colour"))
    while fresh.head(1):
        back = inner.join(fresh.select(F.col("state").alias("b"), "colour"), ["b", "colour"]).select(F.col("a").alias("state"), "colour").distinct()
        fresh = settled(back.join(found, "state", "left_anti"))
        found = settled(found.unionByName(fresh))
    left = inner.select("a", "b").join(found.select(F.col("state").alias("a")), "a", "left_anti").join(found.select(F.col("state").alias("b")), "b", "left_anti")
    return found.select("state", F.col("colour").alias("root")), settled(_trimmed(left.select("a", "b")))


def _told(rounds: list[DataFrame], known: DataFrame) -> DataFrame:
    """``known(state, root)`` with the states that the rounds merged, the last round first; who isn't there is alone."""
    for merged in reversed(rounds):
        root = lambda c: known.select(F.col("state").alias(c), F.col("root").alias(f"root_{c}"))
        both = merged.join(root("into"), "into", "left").join(root("near"), "near", "left")
        both = both.select("state", F.coalesce("root_into", "into").alias("root"), F.coalesce("root_near", "near").alias("other"))
        inside = both.where("root = other").groupBy("state").agg(F.first("root").alias("root"))
        goals = inside.select(F.col("root").alias("state"), "root")  # a component of two: its root is not listed yet
        known = settled(known.unionByName(inside).unionByName(goals).distinct())
    return known


def _in_one_task(direct: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = {(a, b) for part in batches for a, b in zip(part["a"].tolist(), part["b"].tolist(), strict=True)}
        label = strong_components(sorted({s for pair in pairs for s in pair}), pairs)
        yield pd.DataFrame({"state": list(label), "component": list(label.values())})

    kind = direct.schema["a"].dataType.simpleString()
    return direct.coalesce(1).mapInPandas(run, f"state {kind}, component {kind}")  # as many rows as its caller has checked


def mutual_components(edges: DataFrame, held_rows: int = HELD_ROWS) -> DataFrame:
    """state, component (its least state): states that lead to each other, whatever the length of the way.

    A model's graph, of up to ``held_rows`` edges, is one task.  In a larger one
    states without a way in or out are trimmed, chains are merged in a number of
    rounds that grows with the logarithm of their length, and the rest is settled
    by colours; all of it in joins over the edges, until nothing changes.
    """
    direct = settled(edges.select(F.col("s_from").alias("a"), F.col("s_to").alias("b")).distinct())
    if direct.count() <= held_rows:
        return _in_one_task(direct)
    nodes = direct.select(F.col("a").alias("state")).unionByName(direct.select(F.col("b").alias("state"))).distinct()
    left, rounds = settled(_trimmed(direct.where("a <> b"))), []
    known = direct.sparkSession.createDataFrame([], nodes.select("state", F.col("state").alias("root")).schema)
    while (left := _without_chains(left, rounds)).head(1):
        found, left = _coloured(left)
        known = known.unionByName(found)
    known = _told(rounds, settled(known))
    named = known.join(known.groupBy("root").agg(F.min("state").alias("component")), "root").select("state", "component")
    return nodes.join(named, "state", "left").select("state", F.coalesce("component", "state").alias("component"))


def without_transients(edges: DataFrame, held_rows: int = HELD_ROWS) -> DataFrame:
    """Edges among states whose component none of their edges leaves."""
    parts = pinned(mutual_components(edges, held_rows))
    a = parts.select(F.col("state").alias("s_from"), F.col("component").alias("c_from"))
    b = parts.select(F.col("state").alias("s_to"), F.col("component").alias("c_to"))
    leaving = edges.join(a, "s_from").join(b, "s_to").where("c_from <> c_to").select("s_from").distinct()
    kept = edges.join(leaving, "s_from", "left_anti")
    return kept.join(leaving.select(F.col("s_from").alias("s_to")), "s_to", "left_anti").select(*edges.columns)


def largest_component(edges: DataFrame, held_rows: int = HELD_ROWS) -> DataFrame:
    """Edges of the component with the most states; of equals, of the one with the least state."""
    parts = pinned(mutual_components(edges, held_rows))
    best = parts.groupBy("component").agg(F.count("*").alias("size")).agg(F.min(F.struct((-F.col("size")).alias("size"), "component")).alias("best")).select("best.component")
    states = parts.join(F.broadcast(best), "component", "left_semi").select("state")  # one row is broadcast
    inner = edges.join(states.withColumnRenamed("state", "s_from"), "s_from", "left_semi")
    return inner.join(states.withColumnRenamed("state", "s_to"), "s_to", "left_semi").select(*edges.columns)


def recurrent_part(edges: DataFrame, held_rows: int = HELD_ROWS) -> DataFrame:
    """Transient states go; of what is left the largest component stays."""
    return largest_component(pinned(without_transients(edges, held_rows)), held_rows)


def map_words(words: DataFrame, edges_t: DataFrame, length: int, states: DataFrame) -> DataFrame:
    """xs, ys, state reached from the first state in which the word is possible (null if none).

    ``states``: state, idx gives their order; an edge's probability doesn't matter.
    """
    step = edges_t.select(F.col("s_from").alias("s"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("s_to"))
    symbols = lambda df, i: df.withColumns({"_x": F.substring("xs", i, 1), "_y": F.substring("ys", i, 1)})
    first = step.join(F.broadcast(pinned(states)).select(F.col("state").alias("s"), F.col("idx").alias("start")), "s")
    # A word meets the states that have an edge for its first symbols, not all.
    now = symbols(words.select("xs", "ys").distinct(), 1).join(first, ["_x", "_y"]).select("xs", "ys", "start", F.col("s_to").alias("s"))
    for i in range(2, length + 1):
        now = symbols(now, i).join(step, ["s", "_x", "_y"]).select("xs", "ys", "start", F.col("s_to").alias("s"))
    reached = now.groupBy("xs", "ys").agg(F.min_by("s", "start").alias("state"))
    return words.select("xs", "ys").distinct().join(reached, ["xs", "ys"], "left")


def word_map(spark, edges_t: DataFrame, length: int, states: DataFrame) -> DataFrame:
    """x_num, y_num, state for all pairs of binary words: a word as a fraction, the newest symbol first."""
    half = spark.range(1 << length).select(F.lpad(F.bin("id"), length, "0").alias("w"))
    words = half.select(F.col("w").alias("xs")).crossJoin(half.select(F.col("w").alias("ys")))  # every pair of words is what is asked for
    fraction = lambda c: F.conv(F.reverse(c), 2, 10).cast("double") / float(1 << length)
    return map_words(words, edges_t, length, states).where("state is not null").select(fraction("xs").alias("x_num"), fraction("ys").alias("y_num"), "state")


def remove_state(histories: DataFrame, state: int) -> DataFrame:
    return histories.where(F.col("state") != state)
