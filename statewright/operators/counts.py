"""Joint n-gram counts of input and output, and what follows from them.

A window starts at every t that has L more symbols after it; all prefixes of a
window are counted, so every prefix length has the same total.  Windows are cut
per (series, chunk) with a halo of L symbols, so that a long series is counted
by many tasks; series shorter than a chunk are not copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.small import pinned, shared_folder

CHUNK = 1 << 16


def windows(symbols: DataFrame, length: int, chunk: int = CHUNK) -> DataFrame:
    """series_id, t, xs, ys of every window of ``length`` + 1 symbols."""
    own = F.floor(F.col("t") / chunk)
    # The first symbols of a chunk are also the end of windows that start in the one before.
    places = F.when((F.col("t") % chunk < length) & (F.col("t") >= chunk), F.array(own, own - 1)).otherwise(F.array(own))
    spread = symbols.select("series_id", "t", "x", "y", F.explode(places).alias("_chunk"))
    ahead = Window.partitionBy("series_id", "_chunk").orderBy("t")
    join = lambda c: F.concat(*[F.col(c) if i == 0 else F.lead(c, i).over(ahead) for i in range(length + 1)])
    cut = spread.select("series_id", "t", "_chunk", join("x").alias("xs"), join("y").alias("ys"))
    return cut.where(F.col("ys").isNotNull() & (F.floor(F.col("t") / chunk) == F.col("_chunk"))).select("series_id", "t", "xs", "ys")


def full_words(symbols: DataFrame, length: int, by: list[str] | None = None) -> DataFrame:
    return windows(symbols, length).groupBy(*(by or []), "xs", "ys").agg(F.count("*").alias("n"))


def _prefixes(full: DataFrame, length: int, past: int = 0) -> DataFrame:
    """Counts of all prefixes from counts of whole windows; ``past`` symbols of y are left off."""
    k = F.explode(F.sequence(F.lit(1), F.lit(length + 1))).alias("k")
    keep = [c for c in full.columns if c not in ("xs", "ys", "n")]
    cut = full.select(*keep, "xs", "ys", "n", k)
    cut = cut.select(*keep, "k", F.expr("left(xs, k)").alias("xs"), F.expr(f"left(ys, k - {past})").alias("ys"), "n")
    return cut.groupBy(*keep, "k", "xs", "ys").agg(F.sum("n").alias("n"))


def word_counts(symbols: DataFrame, length: int, method: int = 1, by: list[str] | None = None) -> DataFrame:
    """k, xs, ys, n for k = 1 to L + 1.

    Method 1 counts whole windows and sums their prefixes: what is shuffled after
    the first aggregation is the distinct words.  Method 0 rolls the windows up.
    """
    if method == 1:
        return _prefixes(full_words(symbols, length, by), length)
    if method != 0:
        raise ValueError("method is 0 (rollup) or 1 (widest words first)")
    pairs = [f"e{i}" for i in range(1, length + 2)]
    cut = windows(symbols, length).select(*[F.concat(F.substring("xs", i, 1), F.substring("ys", i, 1)).alias(f"e{i}") for i in range(1, length + 2)])
    rolled = cut.rollup(*pairs).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    word = F.concat(*[F.coalesce(F.col(e), F.lit("")) for e in pairs])
    half = lambda first: F.array_join(F.transform(F.sequence(F.lit(first), F.length("w"), F.lit(2)), lambda i: F.substring(F.col("w"), i, F.lit(1))), "")
    words = rolled.where(F.length(word) > 0).select(word.alias("w"), "n")
    return words.select((F.length("w") / 2).cast("int").alias("k"), half(1).alias("xs"), half(2).alias("ys"), "n")


def marginal_counts(words: DataFrame) -> DataFrame:
    """k, xs, ys (one symbol shorter), n: the last output summed out."""
    return words.groupBy("k", "xs", F.expr("left(ys, k - 1)").alias("ys")).agg(F.sum("n").alias("n"))


def words_and_margins(symbols: DataFrame, length: int) -> DataFrame:
    """k, xs, past, y (null in a row that sums over the last output), margin, n: words and their margins from one shuffle."""
    k = F.explode(F.sequence(F.lit(1), F.lit(length + 1))).alias("k")
    cut = full_words(symbols, length).select("xs", "ys", "n", k)
    cut = cut.select("k", F.expr("left(xs, k)").alias("xs"), F.expr("left(ys, k - 1)").alias("past"), F.expr("substring(ys, k, 1)").alias("y"), "n")
    keys = [F.col(c) for c in ("k", "xs", "past", "y")]
    both = cut.groupingSets([keys, keys[:3]], *keys).agg(F.grouping("y").cast("boolean").alias("margin"), F.sum("n").alias("n"))
    return both.select("k", "xs", "past", "y", "margin", "n")


def revised_counts(words: DataFrame, deltas: DataFrame) -> DataFrame:
    """k, xs, ys, n after signed changes (k, xs, ys, n) of the counts; words that are gone are left out.

    Only the two count tables are read, not the series.  A count that would fall
    below nothing raises: something was withdrawn that never was counted.
    """
    summed = words.select("k", "xs", "ys", "n").unionByName(deltas.select("k", "xs", "ys", "n")).groupBy("k", "xs", "ys").agg(F.sum("n").alias("n"))
    left = F.when(F.col("n") < 0, F.raise_error(F.concat(F.lit("withdrawn more often than counted: "), "xs", F.lit(","), "ys"))).otherwise(F.col("n"))
    return summed.withColumn("n", left).where("n > 0")


def word_deltas(length: int, added: DataFrame | None = None, withdrawn: DataFrame | None = None) -> DataFrame:
    """k, xs, ys, n: what whole series that come or go do to the counts of words."""
    if added is None and withdrawn is None:
        raise ValueError("nothing was added or withdrawn")
    parts = [word_counts(symbols, length).withColumn("n", F.col("n") * sign) for symbols, sign in ((added, 1), (withdrawn, -1)) if symbols is not None]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def appended_deltas(symbols: DataFrame, since: DataFrame, length: int, chunk: int = CHUNK) -> DataFrame:
    """k, xs, ys, n: what symbols from ``since(series_id, first)`` on add to the counts of the series so far.

    Only the new symbols and the ``length`` before them are cut into windows; a
    series that isn't in ``since`` has nothing new.
    """
    late = symbols.join(since, "series_id").where(F.col("t") >= F.col("first") - length).select("series_id", "t", "x", "y")
    return _prefixes(windows(late, length, chunk).groupBy("xs", "ys").agg(F.count("*").alias("n")), length)


def long_word_counts(symbols: DataFrame, width: int) -> DataFrame:
    """xs, ys, n of all words of ``width`` symbols: integers are shuffled, words are spelt out once each.

    A word of twice the length is the pair of the names of its halves; equal
    pairs get one name, a whole number.  The widths are powers of two up to the
    largest in ``width``, and a word is named by those that make it up.  Names are
    written to the checkpoint folder before they are used: they don't change.
    """
    if width < 1:
        raise ValueError("a word has one symbol at least")
    shared_folder(symbols.sparkSession)
    spelt = symbols.select("x", "y").distinct().withColumn("name", F.monotonically_increasing_id()).checkpoint()
    words = spelt.select("name", F.col("x").alias("xs"), F.col("y").alias("ys"))
    names = symbols.join(spelt, ["x", "y"]).select("series_id", "t", "name").checkpoint()
    whole, done, span = None, 0, 1  # names of words of ``done`` symbols, made of the bits of width met so far
    whole_words = None
    while span <= width:
        if width & span:
            if whole is None:
                whole, whole_words, done = names, words, span
            else:
                whole, whole_words = _joined(whole, whole_words, names, words, done)
                done += span
        if 2 * span <= width:
            names, words = _joined(names, words, names, words, span)
        span *= 2
    counted = whole.groupBy("name").agg(F.count("*").alias("n"))
    return counted.join(whole_words, "name").select("xs", "ys", "n")


def _joined(first: DataFrame, first_words: DataFrame, second: DataFrame, second_words: DataFrame, apart: int) -> tuple[DataFrame, DataFrame]:
    """Names and spelling of words that are one of ``first`` and then, ``apart`` symbols on, one of ``second``."""
    after = second.select("series_id", (F.col("t") - apart).alias("t"), F.col("name").alias("right"))
    pairs = first.withColumnRenamed("name", "left").join(after, ["series_id", "t"]).select("series_id", "t", "left", "right")
    told = pairs.select("left", "right").distinct().withColumn("name", F.monotonically_increasing_id()).checkpoint()
    names = pairs.join(told, ["left", "right"]).select("series_id", "t", "name").checkpoint()
    one = first_words.select(F.col("name").alias("left"), F.col("xs").alias("x1"), F.col("ys").alias("y1"))
    two = second_words.select(F.col("name").alias("right"), F.col("xs").alias("x2"), F.col("ys").alias("y2"))
    words = told.join(one, "left").join(two, "right").select("name", F.concat("x1", "x2").alias("xs"), F.concat("y1", "y2").alias("ys"))
    return names, words


def conditional(words: DataFrame) -> DataFrame:
    """k, xs, past (outputs before), y, n, p: the distribution of the next output."""
    base = words.select("k", "xs", F.expr("left(ys, k - 1)").alias("past"), F.expr("right(ys, 1)").alias("y"), "n")
    total = F.sum("n").over(Window.partitionBy("k", "xs", "past"))
    return base.select("k", "xs", "past", "y", "n", (F.col("n") / total).alias("p"))


def past_only_counts(symbols: DataFrame, length: int) -> DataFrame:
    """Words whose input ends one step before the output: no conditioning on the current input."""
    full = full_words(symbols, length)
    cut = full.select(F.explode(F.sequence(F.lit(1), F.lit(length + 1))).alias("k"), "xs", "ys", "n")
    return cut.select("k", F.expr("left(xs, k - 1)").alias("xs"), F.expr("left(ys, k)").alias("ys"), "n").groupBy("k", "xs", "ys").agg(F.sum("n").alias("n"))


def output_memoryless_counts(symbols: DataFrame, length: int) -> DataFrame:
    """Past outputs masked by n; the last output stays."""
    words = past_only_counts(symbols, length)
    return words.select("k", "xs", F.expr("concat(repeat('n', k - 1), right(ys, 1))").alias("ys"), "n").groupBy("k", "xs", "ys").agg(F.sum("n").alias("n"))


def input_memoryless_counts(symbols: DataFrame, length: int) -> DataFrame:
    """Inputs masked by n."""
    words = past_only_counts(symbols, length)
    return words.select("k", F.expr("repeat('n', k - 1)").alias("xs"), "ys", "n").groupBy("k", "xs", "ys").agg(F.sum("n").alias("n"))


def joint_encoded_counts(symbols: DataFrame, length: int) -> DataFrame:
    """Words as lists of joint symbol numbers (x number times outputs, plus y number), with counts."""
    from .encode import emission_symbols

    codes = F.broadcast(pinned(emission_symbols(symbols)))  # rows: product of the alphabets
    full = full_words(symbols, length)
    letters = full.select("xs", "ys", "n", F.explode(F.sequence(F.lit(1), F.lit(length + 1))).alias("i"))
    letters = letters.select("xs", "ys", "n", "i", F.expr("substring(xs, i, 1)").alias("x"), F.expr("substring(ys, i, 1)").alias("y")).join(codes, ["x", "y"])
    coded = letters.groupBy("xs", "ys", "n").agg(F.array_sort(F.collect_list(F.struct("i", "e_idx"))).alias("w"))
    return coded.select(F.array_join(F.transform("w", lambda s: s["e_idx"].cast("string")), ",").alias("word"), "n")


def stochastic_matrix(words: DataFrame, outputs: list[str], k: int) -> DataFrame:
    """xs, past, one column per output with P(y | x, past) or 'na', and the counts."""
    rows = conditional(words.where(F.col("k") == k))
    pivoted = rows.groupBy("xs", "past").pivot("y", outputs).agg(F.first("p").alias("p"), F.first("n").alias("n"))
    shown = [F.coalesce(F.format_number(f"{y}_p", 6), F.lit("na")).alias(f"p_{y}") for y in outputs]
    return pivoted.select("xs", "past", *shown, *[F.coalesce(f"{y}_n", F.lit(0)).cast("long").alias(f"n_{y}") for y in outputs])


def history_distribution(words: DataFrame, xs: str, past: str) -> DataFrame:
    """y, n, p after one history (the current input is the last of ``xs``)."""
    return conditional(words.where(F.col("k") == len(xs))).where((F.col("xs") == xs) & (F.col("past") == past)).select("y", "n", "p")


def state_props(filtered: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per state: visits, share, and the entropy of its outputs; from (series_id, t, state) and symbols."""
    both = filtered.where("state is not null").join(symbols, ["series_id", "t"])
    cells = both.groupBy("state", "x", "y").agg(F.count("*").alias("n"))
    row = Window.partitionBy("state", "x")
    parts = cells.select("state", "n", (-F.col("n") * F.log2(F.col("n") / F.sum("n").over(row))).alias("bits"))
    states = parts.groupBy("state").agg(F.sum("n").alias("visits"), F.sum("bits").alias("bits"))
    total = states.agg(F.sum("visits").alias("all"))
    return states.join(F.broadcast(total)).select("state", "visits", (F.col("visits") / F.col("all")).alias("share"), (F.col("bits") / F.col("visits")).alias("output_entropy"))


def complexity(props: DataFrame) -> DataFrame:
    """Entropy of the empirical state distribution, and the entropy rate it weighs."""
    return props.agg((-F.sum(F.col("share") * F.log2("share"))).alias("c_y"), F.sum(F.col("share") * F.col("output_entropy")).alias("h_y"))


def morphs_from_filtered(filtered: DataFrame, symbols: DataFrame) -> DataFrame:
    """state, x, y, n re-estimated from states assigned to positions."""
    both = filtered.where("state is not null").join(symbols, ["series_id", "t"])
    return both.groupBy("state", "x", "y").agg(F.count("*").alias("n"))


def topological(morph: DataFrame) -> DataFrame:
    """Seen symbols alike: counts replaced by their sign."""
    return morph.withColumn("n", F.signum("n").cast("long"))


def masked(column: str, mark: str = "n") -> Column:
    return F.expr(f"repeat('{mark}', length({column}))")
