"""Choice of the history length, and parametric bootstrap of a machine's measures."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.small import held, pinned, shared_folder
from ..functions.stats import entropy
from .algebra import stationary_exact
from .counts import word_counts
from .encode import constant_input, split_train_test
from .filters import Belief, belief_filter
from .graph import NoRecurrentPart, history_transitions
from .infer import Clustering, Model, canonical, edges, fitted, fitted_words, infer, morphs
from .measures import TooManyMixedStates, measure_models, measures, symbol_matrices
from .simulate import Walker, generator, simulate_machine


#: Symbols of a replicate that one task simulates and counts by itself.
LONG_REPLICATE = 1 << 16


def counts_of(series: list[str], length: int) -> dict[tuple[str, str], int]:
    """Word counts of strings under a constant input, for models fitted inside one task."""
    counts: dict[tuple[str, str], int] = {}
    for ys in series:
        for t in range(len(ys) - length):
            for k in range(1, length + 2):
                key = ("0" * k, ys[t : t + k])
                counts[key] = counts.get(key, 0) + 1
    return counts


def machine_edges(found: Clustering) -> list[tuple[int, str, int, float]]:
    """s_from, y, s_to, p of a clustering under a constant input."""
    goal: dict[tuple[int, str], int] = {}
    for s, _, y, to in found.steps():
        goal[s, y] = to
    out = []
    for s, rows in found.sums.items():
        total = sum(rows[0])
        out += [(s, y, goal[s, y], n / total) for y, n in zip(found.ays, rows[0], strict=True) if n and (s, y) in goal]
    return out


def topology(found: Clustering) -> str:
    steps = {(s, x, y): to for s, x, y, to in found.steps()}
    first = min(found.owners().items())[1]
    return canonical(list(found.members), steps, first)


def log_likelihood(moves: list[tuple[int, str, int, float]], series: list[str], ays: list[str]) -> float:
    """Log probability of the strings under the belief filter, unsettled steps included; -inf if impossible."""
    states, mats = symbol_matrices(moves)
    pi = stationary_exact(sum(mats.values()))
    t_edges = {(a, "0", y): (b, p) for a, y, b, p in moves}
    start = {(s, 0): float(w) for s, w in zip(states, pi, strict=True)}
    total = 0.0
    for ys in series:
        b = Belief(t_edges, {(0, "0"): (0, 1.0)}, start, ays)
        for y in ys:
            p = b.forecast("0")[ays.index(y)]
            b.update("0", y)
            total += math.log(p) if p > 0 else -math.inf
    return total


def choose_length(spark: SparkSession, series: list[str], ays: list[str], longest: int, alpha: float = 0.001, kind: str = "chi2", held_out: bool = False) -> DataFrame:
    """length, states, loglik, score, topology for each history length, a task per length.

    The score is BIC over the whole series, or the mean log loss on the second
    half of each with the model of the first half.  The best length has the
    least score; see :func:`best_length` for ties of topology.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        length = int(rows["length"].iloc[0])
        fit = [s[: len(s) // 2] for s in series] if held_out else series
        test = [s[len(s) // 2 :] for s in series] if held_out else series
        try:
            found = Clustering(counts_of(fit, longest), ["0"], ays, length, alpha, kind).run()
            ll = log_likelihood(machine_edges(found), test, ays)
        except NoRecurrentPart:
            return pd.DataFrame({"length": [length], "states": [0], "loglik": [-math.inf], "score": [math.inf], "topology": [""]})
        n = sum(map(len, test))
        score = -ll / n if held_out else -2 * ll + len(found.members) * (len(ays) - 1) * math.log(n)
        return pd.DataFrame({"length": [length], "states": [len(found.members)], "loglik": [ll], "score": [score], "topology": [topology(found)]})

    lengths = spark.range(1, longest + 1).select(F.col("id").cast("int").alias("length"))
    return lengths.groupBy("length").applyInPandas(run, "length int, states int, loglik double, score double, topology string")


def choose_length_of(symbols: DataFrame, ays: list[str], longest: int, alpha: float = 0.001, kind: str = "chi2", held_out: bool = False) -> DataFrame:
    """length, states, loglik, score, topology for symbol tables of any size under a constant input.

    Counts are taken once, at the longest length; each length's machine is
    inferred from them and its likelihood summed by the distributed belief
    filter.  The score is BIC over all symbols, or the mean log loss on the second
    half of each series with the model of the first halves.  A length without a
    recurrent part, or that finds a symbol impossible, has an infinite score.
    """
    spark = symbols.sparkSession
    fit = test = constant_input(symbols)
    if held_out:
        halves = split_train_test(fit)
        cut = halves.where("part = 'train'").groupBy("series_id").agg(F.count("*").alias("_first"))
        fit = halves.where("part = 'train'").drop("part")
        late = halves.where("part = 'test'").join(cut, "series_id", "left")
        test = late.select("series_id", (F.col("t") - F.coalesce("_first", F.lit(0))).alias("t"), "x", "y")
    shared_folder(spark)
    kept = test.checkpoint()  # each length goes over these symbols again, not over what they are made of
    words = pinned(word_counts(fit if held_out else kept, longest)).withColumn("model_id", F.lit("model"))
    test, n = kept, kept.count()
    rows = []
    for length in range(1, longest + 1):
        model = fitted_words(words.where(F.col("k") <= length + 1), ["0"], ays, length, alpha, kind, skip_transient=True)
        if model is None:
            rows.append((length, 0, -math.inf, math.inf, ""))
            continue
        edges_t = model.edges.select(F.col("s_from").cast("string").alias("s_from"), "x", "y", F.col("s_to").cast("string").alias("s_to"), "p")
        table = sorted((r["s_from"], r["y"], r["s_to"], r["p"]) for r in held(edges_t))
        states, mats = symbol_matrices(table)
        pi = stationary_exact(sum(mats.values()))
        start = spark.createDataFrame([(s, "M", float(p)) for s, p in zip(states, pi, strict=True)], "t string, m string, pi double")
        one = spark.createDataFrame([("M", "0", "M", 1.0)], "s_from string, x string, s_to string, p double")
        seen = belief_filter(test, one, edges_t, start, ays)
        ll = seen.agg(F.sum(F.when(F.col("p_seen") > 0, F.log("p_seen")).otherwise(float("-inf")))).first()[0] or 0.0
        owners = {(r["xs"], r["ys"]): r["state"] for r in held(model.histories)}
        shape = canonical(sorted(set(owners.values())), {(int(a), "0", y): int(b) for a, y, b, _ in table}, min(owners.items())[1])
        count = len(set(owners.values()))
        score = -ll / max(n, 1) if held_out else -2 * ll + count * (len(ays) - 1) * math.log(max(n, 1))
        rows.append((length, count, float(ll), float(score), shape))
    return spark.createDataFrame(rows, "length int, states int, loglik double, score double, topology string")


def best_length(scores: DataFrame) -> int:
    """The least score's length, then the shortest with as many states and the same topology."""
    rows = {r["length"]: r for r in scores.collect()}  # one row per length
    best = min(rows.values(), key=lambda r: (r["score"], r["length"]))
    return min(r["length"] for r in rows.values() if r["states"] == best["states"] and r["topology"] == best["topology"])


def bootstrap(spark: SparkSession, moves: list[tuple[object, str, object, float]], ays: list[str], length: int, size: int, replicates: int, alpha: float = 0.001, seed: int = 0) -> DataFrame:
    """boot_id, cmu, hmu, excess, failed: a machine simulated, inferred and measured anew per replicate, a task for each group.

    A replicate without a recurrent part, or with too many mixed states, has failed; any other error raises.
    """

    def run(batches):
        walker = Walker(moves)
        for rows in batches:
            out = []
            for b in rows["boot_id"]:
                rng = generator(seed, b)
                ys, _ = walker.run(rng, size, walker.first(rng))
                try:
                    found = Clustering(counts_of(["".join(ys)], length), ["0"], ays, length, alpha).run()
                    if len(found.members) == 1:
                        weights = next(iter(found.sums.values()))[0]
                        out.append((b, 0.0, entropy(weights), 0.0, False))
                    else:
                        m = measures(machine_edges(found))
                        out.append((b, m.cmu, m.hmu, m.excess, False))
                except (NoRecurrentPart, TooManyMixedStates):
                    out.append((b, None, None, None, True))
            yield pd.DataFrame(out, columns=["boot_id", "cmu", "hmu", "excess", "failed"])

    ids = spark.range(replicates).withColumnRenamed("id", "boot_id")
    return ids.mapInPandas(run, "boot_id bigint, cmu double, hmu double, excess double, failed boolean")


def bootstrap_tables(spark: SparkSession, moves: list[tuple[object, str, object, float]], ays: list[str], length: int, size: int, replicates: int, alpha: float = 0.001, seed: int = 0) -> DataFrame:
    """The replicates of :func:`bootstrap` for long series: their symbols are a table, counted by chunks, and only their words meet in a task.

    Columns and draws are the same.
    """
    symbols = simulate_machine(spark, moves, replicates, size, seed)
    words = pinned(word_counts(symbols, length, by=["series_id"])).withColumnRenamed("series_id", "model_id")
    found = pinned(infer(words, ["0"], ays, length, alpha, skip_transient=True))
    emissions = spark.createDataFrame([("0", y) for y in ays], "x string, y string")
    told_states = pinned(found.groupBy("model_id").agg(F.countDistinct("state").alias("states")))
    morph = pinned(morphs(found, words).join(told_states, "model_id"))
    # What one state does next is all there is to know of it, whether or not its histories lead on.
    share = F.col("n") / F.sum("n").over(Window.partitionBy("model_id"))
    alone = morph.where("states = 1").select("model_id", share.alias("p")).where("p > 0").groupBy("model_id").agg((-F.sum(F.col("p") * F.log2("p"))).alias("hmu"))
    alone = alone.select("model_id", F.lit(0.0).alias("cmu"), (F.col("hmu") + 0.0).alias("hmu"), F.lit(0.0).alias("excess"))
    machines = edges(history_transitions(found, emissions, length), morph.where("states > 1").drop("states"))
    several = measure_models(machines.select("model_id", "s_from", F.col("y").alias("x"), "s_to", "p"), skip_too_many=True)
    told = alone.unionByName(several.select("model_id", "cmu", "hmu", "excess"))
    ids = spark.range(replicates).withColumnRenamed("id", "boot_id")
    both = ids.join(told, ids["boot_id"] == told["model_id"], "left")
    return both.select("boot_id", "cmu", "hmu", "excess", F.col("model_id").isNull().alias("failed"))


@dataclass
class Bootstrap:
    """The chosen length, the model, its measures (one row), and those of the replicates."""

    length: int
    model: Model
    measures: DataFrame
    replicates: DataFrame


def bootstrap_of(symbols: DataFrame, ays: list[str], longest: int, replicates: int, size: int | None = None, alpha: float = 0.001, seed: int = 0, length: int | None = None) -> Bootstrap:
    """End to end: choose the length (unless given), fit, measure, simulate the fitted machine, fit and measure each replicate.

    ``size``: symbols of a replicate; as many as were observed unless given.
    """
    observed = constant_input(symbols)
    best = length or best_length(choose_length_of(observed, ays, longest, alpha))
    model = fitted(observed, ["0"], ays, best, alpha, longest=longest)
    moves = sorted((r["s_from"], r["y"], r["s_to"], r["p"]) for r in held(model.edges))
    machine = model.edges.select("model_id", F.col("s_from").cast("string").alias("s_from"), F.col("y").alias("x"), F.col("s_to").cast("string").alias("s_to"), "p")
    symbols_each = size or observed.count()
    draw = bootstrap if symbols_each <= LONG_REPLICATE else bootstrap_tables
    drawn = draw(symbols.sparkSession, moves, ays, best, symbols_each, replicates, alpha, seed)
    return Bootstrap(best, model, measure_models(machine), drawn)


def interval(thetas: DataFrame, measure: str, level: float = 0.95) -> DataFrame:
    """measure, low, high, n, n_failed: a central percentile interval of a column; failures are counted, not used."""
    n, failed, (low, high) = _quantiles(thetas, measure, [(1 - level) / 2, (1 + level) / 2])
    return thetas.sparkSession.createDataFrame([(measure, low, high, n, failed)], "measure string, low double, high double, n long, n_failed long")


#: Share of ranks by which the values beside a quantile are bounded; twice and more what percentile_approx may be wrong by.
RANK_ERROR = 4e-4


def _quantiles(thetas: DataFrame, measure: str, shares: list[float], error: float = RANK_ERROR) -> tuple[int, int, list[float | None]]:
    """How many values and nulls there are, and exact quantiles, between two values where the rank is.

    Approximate quantiles on both sides of each bound it; only the values between
    them are put in order, and all before them are counted.
    """
    value = F.col(measure).cast("double")
    sides = [b for q in shares for b in (max(q - error, 0.0), min(q + error, 1.0))]
    told = thetas.agg(F.count(measure).alias("n"), F.count_if(F.col(measure).isNull()).alias("failed"), F.percentile_approx(value, sides, 10000).alias("b")).first()
    n, failed = told["n"], told["failed"]
    if not n:
        return n, failed, [None] * len(shares)
    bounds = [(None if q - error <= 0 else told["b"][2 * i], None if q + error >= 1 else told["b"][2 * i + 1]) for i, q in enumerate(shares)]
    under = lambda b: F.lit(False) if b is None else value < b
    over = lambda b: F.lit(False) if b is None else value > b
    values = thetas.where(F.col(measure).isNotNull())
    before = values.agg(*[F.count_if(under(a)).alias(f"b{i}") for i, (a, _) in enumerate(bounds)]).first()
    found: list[float | None] = []
    for i, (q, (a, b)) in enumerate(zip(shares, bounds, strict=True)):
        counted = values.where(~under(a) & ~over(b)).groupBy(value.alias("v")).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) + before[f"b{i}"]  # a small share of the values
        rank = q * (n - 1)
        first, last = math.floor(rank), math.ceil(rank)
        ranked = counted.select("v", upto.alias("upto"))
        r = ranked.agg(F.min(F.when(F.col("upto") > first, F.col("v"))).alias("low"), F.min(F.when(F.col("upto") > last, F.col("v"))).alias("high")).first()
        if before[f"b{i}"] > first or r["high"] is None:  # the bounds were wrong by more than they may be
            return _quantiles(thetas, measure, shares, error * 10)
        found.append(r["low"] if r["low"] == r["high"] else (last - rank) * r["low"] + (rank - first) * r["high"])
    return n, failed, found


#: Ranges into which values are cut to be ranked side by side.
RANGES = 64


def confidence_curve(thetas: DataFrame, measure: str, ranges: int = RANGES) -> DataFrame:
    """theta, ecdf, cc = |2 ecdf - 1|, p = 1 - cc at each distinct value.

    Values are ranked inside ranges between quantiles, plus the counts of the ranges before.
    """
    values = thetas.where(F.col(measure).isNotNull()).groupBy(F.col(measure).alias("theta")).agg(F.count("*").alias("n"))
    bounds = values.agg(F.percentile_approx("theta", [i / ranges for i in range(1, ranges)]).alias("b")).first()["b"] or []
    within = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col("theta"))) if bounds else F.lit(0)
    placed = values.withColumn("range", within)
    sizes = placed.groupBy("range").agg(F.sum("n").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per range
    offsets = sizes.select(F.col("range").alias("_range"), before.alias("before"), F.sum("size").over(Window.partitionBy(F.lit(1))).alias("all"))
    ranked = placed.join(F.broadcast(offsets), placed["range"] == offsets["_range"])
    upto = Window.partitionBy("range").orderBy("theta").rowsBetween(Window.unboundedPreceding, 0)
    ecdf = (F.col("before") + F.sum("n").over(upto)) / F.col("all")
    cc = F.abs(2 * ecdf - 1)
    return ranked.select("theta", ecdf.alias("ecdf"), cc.alias("cc"), (1 - cc).alias("p"))


def quantile(thetas: DataFrame, measure: str, q: float) -> DataFrame:
    return thetas.sparkSession.createDataFrame([(_quantiles(thetas, measure, [q])[2][0],)], "theta double")


__all__ = ["best_length", "bootstrap", "bootstrap_of", "bootstrap_tables", "choose_length", "choose_length_of", "confidence_curve", "interval", "quantile"]
