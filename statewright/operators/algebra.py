"""Model algebra: joins over the edge tables of machines and transducers.

``edges_m(s_from, x, s_to, p)`` is a machine that emits x; ``edges_t(s_from, x,
y, s_to, p)`` a transducer that answers y to x.  A mixed state is a pair of a
transducer state and a machine state.  Tables are as large as the models.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.small import numbered, pinned, shared_folder

#: States of a chain that is solved on the driver: a dense matrix of 8 MB.
STATES_HELD = 1000
#: Lazy steps between two solutions of the chain of blocks, and such rounds at most.
SMOOTHING, ROUNDS = 4, 200


def machine_from_counts(words: DataFrame, order: int) -> DataFrame:
    """The Markov machine whose states are the last ``order`` outputs: s_from, x (the output), s_to, p."""
    rows = words.where(F.col("k") == order + 1).groupBy("ys").agg(F.sum("n").alias("n"))
    rows = rows.select(F.expr(f"left(ys, {order})").alias("s_from"), F.expr("right(ys, 1)").alias("x"), F.expr(f"right(ys, {order})").alias("s_to"), "n")
    return rows.select("s_from", "x", "s_to", (F.col("n") / F.sum("n").over(Window.partitionBy("s_from"))).alias("p"))


def transducer_from_counts(words: DataFrame, order: int) -> DataFrame:
    """The transducer whose states are the last ``order`` outputs: s_from, x, y, s_to, p."""
    rows = words.where(F.col("k") == order + 1)
    rows = rows.select(F.expr(f"left(ys, {order})").alias("s_from"), F.expr("right(xs, 1)").alias("x"), F.expr("right(ys, 1)").alias("y"), F.expr(f"right(ys, {order})").alias("s_to"), "n")
    rows = rows.groupBy("s_from", "x", "y", "s_to").agg(F.sum("n").alias("n"))
    return rows.select("s_from", "x", "y", "s_to", (F.col("n") / F.sum("n").over(Window.partitionBy("s_from", "x"))).alias("p"))


def _pairs(edges_m: DataFrame, edges_t: DataFrame) -> DataFrame:
    m = edges_m.select(F.col("s_from").alias("m_from"), "x", F.col("s_to").alias("m_to"), F.col("p").alias("p_m"))
    t = edges_t.select(F.col("s_from").alias("t_from"), "x", "y", F.col("s_to").alias("t_to"), F.col("p").alias("p_t"))
    return m.join(t, "x")


def mixed_matrix(edges_m: DataFrame, edges_t: DataFrame) -> DataFrame:
    """t_from, m_from, t_to, m_to, p."""
    return _pairs(edges_m, edges_t).groupBy("t_from", "m_from", "t_to", "m_to").agg(F.sum(F.col("p_m") * F.col("p_t")).alias("p"))


def output_matrix(edges_m: DataFrame, edges_t: DataFrame) -> DataFrame:
    """The mixed matrix split by output: t_from, m_from, y, t_to, m_to, p."""
    return _pairs(edges_m, edges_t).groupBy("t_from", "m_from", "y", "t_to", "m_to").agg(F.sum(F.col("p_m") * F.col("p_t")).alias("p"))


def machine_matrix(edges_m: DataFrame, normalise: bool = True, by_symbol: bool = False) -> DataFrame:
    """s_from, (x,) s_to, p: a machine's state matrix, rows rescaled to one if asked."""
    p = F.col("p") / F.sum("p").over(Window.partitionBy("s_from")) if normalise else F.col("p")
    keys = ["s_from", "x", "s_to"] if by_symbol else ["s_from", "s_to"]
    return edges_m.withColumn("p", p).groupBy(*keys).agg(F.sum("p").alias("p"))


def uniform_machine(edges_m: DataFrame) -> DataFrame:
    """The same topology with the symbols of each state alike."""
    seen = edges_m.where("p > 0")
    return seen.withColumn("p", 1.0 / F.count("*").over(Window.partitionBy("s_from")))


def stationary(matrix: DataFrame, source: list[str], target: list[str], tolerance: float = 1e-13, states_most: int = STATES_HELD, rounds: int = ROUNDS) -> DataFrame:
    """The state columns ``source`` and pi, with pi P = pi; source and target name the state columns.

    A model of up to ``states_most`` states is solved on the driver.  A larger one
    is aggregated and disaggregated by turns: its states, in order, are put into
    that many blocks, the chain of the blocks is solved, each block gets its share,
    and lazy steps (half a chance to stay, so that periods die out) even out what is
    inside and between blocks.  So it takes few rounds where single steps would have
    to carry weight all the way round.  It ends when a round moves no state by
    ``tolerance``, and raises if ``rounds`` of them don't get there.
    """
    matrix = pinned(matrix.select(*source, *target, "p"))
    back = [F.col(t).alias(s) for s, t in zip(source, target, strict=True)]
    states = matrix.select(*source).unionByName(matrix.select(*back)).distinct()
    names = states.orderBy(*source).limit(states_most + 1).collect()
    if len(names) <= states_most:
        at = {tuple(r): i for i, r in enumerate(names)}
        dense, width = np.zeros((len(at), len(at))), len(source)
        for r in matrix.collect():  # at most as many rows as pairs of those states
            dense[at[tuple(r[:width])], at[tuple(r[width : 2 * width])]] += r["p"]
        pi = stationary_exact(dense) if len(at) else []
        shape = StructType([*[matrix.schema[c] for c in source], StructField("pi", DoubleType())])
        return matrix.sparkSession.createDataFrame([(*r, float(w)) for r, w in zip(names, pi, strict=True)], shape)
    shared_folder(matrix.sparkSession)
    states = numbered(states, source, "_n").checkpoint()
    total = states.count()
    placed = states.select(*source, F.col("_n").alias("i"), F.floor(F.col("_n") * states_most / total).alias("block"))
    ends = placed.select(*[F.col(s).alias(t) for s, t in zip(source, target, strict=True)], F.col("i").alias("j"), F.col("block").alias("to_block"))
    moves = matrix.join(placed, source).join(ends, target).select("i", "block", "j", "to_block", "p").checkpoint()
    now = placed.select("i", "block", F.lit(1.0 / total).alias("pi"))
    stay = placed.select("i", "block")
    for _ in range(rounds):
        inside = pinned(now.groupBy("block").agg(F.sum("pi").alias("mass")))
        flows = moves.join(now.select("i", "pi"), "i").groupBy("block", "to_block").agg(F.sum(F.col("pi") * F.col("p")).alias("flow"))
        coarse = np.zeros((states_most, states_most))
        for r in flows.collect():  # at most as many rows as pairs of blocks
            coarse[r["block"], r["to_block"]] = r["flow"]
        mass = np.zeros(states_most)
        for r in inside.collect():  # a row per block
            mass[r["block"]] = r["mass"]
        used = np.flatnonzero(mass > 0)
        chain = coarse[np.ix_(used, used)]
        shares = stationary_exact(chain / chain.sum(axis=1, keepdims=True))
        scales = matrix.sparkSession.createDataFrame([(int(b), float(w / mass[b])) for b, w in zip(used, shares, strict=True)], "block bigint, scale double")
        before = now.join(F.broadcast(scales), "block").select("i", "block", (F.col("pi") * F.col("scale")).alias("pi")).checkpoint()
        now = before
        for _ in range(SMOOTHING):
            moved = now.join(moves.select("i", "j", "p"), "i").groupBy(F.col("j").alias("i")).agg(F.sum(F.col("pi") * F.col("p")).alias("moved"))
            now = stay.join(now.select("i", "pi"), "i", "left").join(moved, "i", "left").select("i", "block", ((F.coalesce("pi", F.lit(0.0)) + F.coalesce("moved", F.lit(0.0))) / 2).alias("pi"))
        now = now.checkpoint()
        gap = now.select("i", F.col("pi").alias("after")).join(before, "i").agg(F.max(F.abs(F.col("after") - F.col("pi")))).first()[0]
        if gap is None or gap <= tolerance:
            return placed.join(now.select("i", "pi"), "i").select(*source, "pi")
    raise ArithmeticError(f"not stationary after {rounds} rounds: the last one still moved a state by {gap:.3g}")


def stationary_exact(matrix: np.ndarray) -> np.ndarray:
    """Stationary row vector of a row-stochastic matrix: least squares on pi P = pi, sum pi = 1."""
    n = len(matrix)
    system = np.vstack([matrix.T - np.eye(n), np.ones(n)])
    pi = np.linalg.lstsq(system, np.append(np.zeros(n), 1.0), rcond=None)[0].clip(0)
    return pi / pi.sum()


def marginal(pi: DataFrame, keep: str, name: str = "state") -> DataFrame:
    return pi.groupBy(F.col(keep).alias(name)).agg(F.sum("pi").alias("pi"))


def conditional_measures(pi: DataFrame, edges_m: DataFrame, edges_t: DataFrame) -> DataFrame:
    """c_x: entropy of the transducer's states; h_x: entropy rate of outputs given inputs.  ``pi``: t, m, pi."""
    t_states = pi.groupBy("t").agg(F.sum("pi").alias("q")).where("q > 0").agg((-F.sum(F.col("q") * F.log2("q"))).alias("c_x"))
    m = edges_m.select(F.col("s_from").alias("m"), "x", F.col("p").alias("p_m"))
    t = edges_t.select(F.col("s_from").alias("t"), "x", F.col("p").alias("p_t")).where("p_t > 0")
    rate = pi.join(m, "m").join(t, ["t", "x"]).agg((-F.sum(F.col("pi") * F.col("p_m") * F.col("p_t") * F.log2("p_t"))).alias("h_x"))
    return t_states.join(F.broadcast(rate))


def word_probabilities(edges_m: DataFrame, pi: DataFrame, length: int) -> DataFrame:
    """word, p of every word of the machine up to ``length`` symbols; ``pi``: state, pi."""
    now = pi.select(F.col("state").alias("s"), F.lit("").alias("word"), F.col("pi").alias("w"))
    out: DataFrame | None = None
    edges = pinned(edges_m).where("p > 0").select(F.col("s_from").alias("s"), "x", "s_to", "p")
    for _ in range(length):
        now = pinned(now).join(edges, "s").groupBy(F.concat("word", "x").alias("word"), F.col("s_to").alias("s")).agg(F.sum(F.col("w") * F.col("p")).alias("w"))
        level = now.groupBy("word").agg(F.sum("w").alias("p"))
        out = level if out is None else out.unionByName(level)
    return out


def word_probability(edges_m: DataFrame, pi: DataFrame, word: str) -> DataFrame:
    """word, p of one word (0 if the machine can't make it): only its own edges are joined."""
    now = pi.select(F.col("state").alias("s"), F.col("pi").alias("w"))
    for symbol in word:
        step = edges_m.where(F.col("x") == symbol).select(F.col("s_from").alias("s"), "s_to", "p")
        now = now.join(step, "s").groupBy(F.col("s_to").alias("s")).agg(F.sum(F.col("w") * F.col("p")).alias("w"))
    return now.agg(F.lit(word).alias("word"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("p"))


def block_measures(words: DataFrame) -> DataFrame:
    """length, h_block (entropy of words), h_gain (entropy of the next symbol), excess (so far), from (word, p)."""
    blocks = words.where("p > 0").groupBy(F.length("word").alias("length")).agg((-F.sum(F.col("p") * F.log2("p"))).alias("h_block"))
    order = Window.orderBy("length")  # as many rows as word lengths
    gains = blocks.withColumn("h_gain", F.col("h_block") - F.coalesce(F.lag("h_block").over(order), F.lit(0.0)))
    return gains.select("length", "h_block", "h_gain", (F.col("h_block") - F.col("length") * F.col("h_gain")).alias("excess"))


def forecast(edges_m: DataFrame, edges_t: DataFrame, start: DataFrame, steps: int) -> DataFrame:
    """step, y, p: distributions of the outputs 1 to ``steps`` ahead; ``start``: t, m, w."""
    now, out = start.select("t", "m", "w"), None
    step = output_matrix(edges_m, edges_t).select(F.col("t_from").alias("t"), F.col("m_from").alias("m"), "y", "t_to", "m_to", "p")
    for k in range(1, steps + 1):
        moved = now.join(step, ["t", "m"]).select("y", F.col("t_to").alias("t"), F.col("m_to").alias("m"), (F.col("w") * F.col("p")).alias("w"))
        level = moved.groupBy("y").agg(F.sum("w").alias("p")).select(F.lit(k).alias("step"), "y", "p")
        out = level if out is None else out.unionByName(level)
        now = moved.groupBy("t", "m").agg(F.sum("w").alias("w"))
    return out
