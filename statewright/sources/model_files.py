"""Model files written and read by executors: graph text, state listings, generator tables.

A table may hold any number of models; each becomes one file in a folder of its
own (``model_id=<id>``), written by one task and committed by Spark as a whole.
Lines are made where the rows are.  Files are read by Spark's text reader, so
they may lie wherever Spark reads; ``path`` tells the models apart again, and
:func:`model_of` takes a model's id out of it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import significant
from .models import GRAPH_HEAD

DIALECTS = ("transducer", "machine", "machine-lines", "memoryless")
END = "\\l"  # ends a label of several


def _numbers(all_digits: bool) -> Column:
    """A formatter of probabilities: all digits, or three significant ones where ``single`` isn't set."""

    @F.pandas_udf("string")
    def shown(p: pd.Series, single: pd.Series) -> pd.Series:
        return pd.Series([repr(float(v)) if all_digits or s else significant(v) for v, s in zip(p, single, strict=True)], dtype=object)

    return shown


def state_name(n: Column) -> Column:
    """0 to 25: A to Z; then the letter repeated."""
    return F.repeat(F.char(65 + n % 26), (F.floor(n / 26) + 1).cast("int"))


def write_lines(lines: DataFrame, path: str) -> None:
    """``lines(model_id, at, text)``: a file per model, its lines in the order of ``at`` (an array); what was there is replaced."""
    placed = lines.repartition("model_id").sortWithinPartitions("model_id", "at")
    placed.select("model_id", F.col("text").alias("value")).write.mode("overwrite").partitionBy("model_id").text(path)


def model_of(path: Column) -> Column:
    """The model's id in a file's path: escaped once as a folder's name, and once more as part of a path."""
    plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    return plain(plain(F.regexp_extract(path, r"model_id=([^/]*)/", 1)))


def write_pairs(symbols: DataFrame, path: str, files: int = 16) -> None:
    """Series as text under ``path``/X and ``path``/Y: a line per series, in so many files, the n-th line of one with the n-th of the other.

    The series dealt to a file by their number are put in the same order on both
    sides, so :func:`.models.pair_series` finds each pair again.
    """
    from ..operators.encode import to_strings

    wide = to_strings(symbols).withColumn("model_id", F.lpad(F.pmod(F.xxhash64("series_id"), F.lit(files)).cast("string"), 4, "0"))
    for role in ("X", "Y"):
        write_lines(wide.select("model_id", F.array(F.col("series_id").cast("string")).alias("at"), F.col(role).alias("text")), f"{path}/{role}")


def graph_table(edges: DataFrame, dialect: str = "transducer", all_digits: bool = False, one_line_per_pair: bool = True) -> DataFrame:
    """model_id, at, text: the lines of graph text of ``edges(model_id, s_from, x, y, s_to, p)``, states numbered from 0.

    Labels are ``y|x:p``, for machines ``y:p``, by output, then input, with three
    significant digits unless all are asked for.  The labels of a pair of states
    share a line, each ended by a backslash and l; 'machine' and tables with
    ``one_line_per_pair`` off have a line for each, without that end.  A model of
    one state has a line for each possible label, with all digits.  Unknown
    probabilities are left out.
    """
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect {dialect!r}: {', '.join(DIALECTS)}")
    shared = one_line_per_pair and dialect != "machine"
    known = edges.where(F.col("p").isNotNull() & ~F.isnan("p"))
    ends = edges.groupBy("model_id").agg(F.least(F.min("s_from"), F.min("s_to")).alias("low"), F.greatest(F.max("s_from"), F.max("s_to")).alias("high"))
    sized = known.join(ends, "model_id").withColumn("single", (F.col("low") == F.col("high")) & F.lit(shared)).where("not single or p > 0")
    name = F.col("y") if dialect.startswith("machine") else F.concat("y", F.lit("|"), "x")
    labelled = sized.select("model_id", "s_from", "s_to", "x", "y", "single", F.concat(name, F.lit(":"), _numbers(all_digits)("p", "single")).alias("label"))
    own = F.when(F.col("single") | F.lit(not shared), F.struct("y", "x"))  # null: all of a pair of states together
    labels = F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "label"))), lambda r: F.concat(r["label"], F.lit(END if shared else "")))
    lines = labelled.groupBy("model_id", "s_from", "s_to", own.alias("own")).agg(F.array_join(labels, "").alias("label"))
    text = F.concat(state_name(F.col("s_from")), F.lit(" -> "), state_name(F.col("s_to")), F.lit(' [label = "'), "label", F.lit('"];'))
    place = F.array(F.lit("1"), F.lpad(F.col("s_from").cast("string"), 10, "0"), F.lpad(F.col("s_to").cast("string"), 10, "0"), F.coalesce(F.col("own.y"), F.lit("")), F.coalesce(F.col("own.x"), F.lit("")))
    models = edges.select("model_id").distinct()
    frame = [(["0", str(i)], line) for i, line in enumerate(GRAPH_HEAD)] + [(["2"], "}")]
    around = F.explode(F.array(*[F.struct(F.array(*map(F.lit, at)).alias("at"), F.lit(line).alias("text")) for at, line in frame])).alias("line")
    return lines.select("model_id", place.alias("at"), text.alias("text")).unionByName(models.select("model_id", around).select("model_id", "line.at", "line.text"))


def write_graphs(edges: DataFrame, path: str, dialect: str = "transducer", all_digits: bool = False, one_line_per_pair: bool = True) -> None:
    write_lines(graph_table(edges, dialect, all_digits, one_line_per_pair), path)


def listing_table(histories: DataFrame, emissions: DataFrame, transitions: DataFrame, axs: list[str], ays: list[str], memoryless: bool = False) -> DataFrame:
    """model_id, at, text: a state listing of histories(model_id, state, xs, ys), emissions(.., state, x, y, p) and transitions(.., s_from, x, y, s_to).

    Histories go by length, then name.  A pair without a probability has 0.0, one
    without a goal NULL.  ``memoryless``: outputs don't depend on the current
    input, and past outputs are masked: ``P(y)`` on one line (``emissions`` has
    state, y, p), and a transition for each input with the output n.
    """
    states = histories.select("model_id", "state").distinct()
    width = lambda c: F.lpad(c.cast("string"), 10, "0")
    head = states.select("model_id", "state", F.array(F.lit("0")).alias("at"), F.concat(F.lit("State number: "), F.col("state").cast("string")).alias("text"))
    own = histories.select("model_id", "state", F.array(F.lit("1"), width(F.length("xs")), "xs", "ys").alias("at"), F.concat("xs", F.lit(", "), "ys").alias("text"))
    asked = [("", y) for y in ays] if memoryless else [(x, y) for x in axs for y in ays]
    keys = ["y"] if memoryless else ["x", "y"]
    given = emissions.groupBy("model_id", "state").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", *keys), "p"))).alias("p"))
    goals = transitions.select("model_id", F.col("s_from").alias("state"), F.concat_ws("|", "x", F.lit("n") if memoryless else F.col("y")).alias("k"), "s_to").distinct()
    goals = goals.groupBy("model_id", "state").agg(F.map_from_entries(F.collect_list(F.struct("k", F.col("s_to").cast("string")))).alias("to"))
    told = states.join(given, ["model_id", "state"], "left").join(goals, ["model_id", "state"], "left")
    shown = _numbers(True)
    with_p = told
    for i, (x, y) in enumerate(asked):
        with_p = with_p.withColumn(f"_p{i}", shown(F.coalesce(F.col("p")[y if memoryless else f"{x}|{y}"], F.lit(0.0)), F.lit(True)))
    cell = lambda i, x, y: F.concat(F.lit(f"P({y}) = " if memoryless else f"P({y}|{x},state) = "), F.col(f"_p{i}"), F.lit("\t"))
    rows = [asked] if memoryless else [[(x, y) for y in ays] for x in axs]
    texts, n = [], 0
    for row in rows:
        texts.append(F.concat(*[cell(n + j, x, y) for j, (x, y) in enumerate(row)]))
        n += len(row)
    moves = [(x, "n") for x in axs] if memoryless else asked
    move = F.concat(F.lit("transitions: "), *[F.concat(F.lit(f"T(({x}, {y})) = "), F.coalesce(F.col("to")[f"{x}|{y}"], F.lit("NULL")), F.lit("\t")) for x, y in moves])
    after = [F.concat(F.lit("distribution: "), texts[0])] if memoryless else [F.lit("distribution: "), *texts]
    after += [move, F.lit("P(State) = ..."), F.lit("")]
    body = F.posexplode(F.array(*after)).alias("i", "text")
    rest = with_p.select("model_id", "state", body).select("model_id", "state", F.array(F.lit("2"), width(F.col("i"))).alias("at"), "text")
    every = head.unionByName(own).unionByName(rest)
    return every.select("model_id", F.concat(F.array(width(F.col("state"))), "at").alias("at"), "text")


def write_listings(histories: DataFrame, emissions: DataFrame, transitions: DataFrame, path: str, axs: list[str], ays: list[str], memoryless: bool = False) -> None:
    write_lines(listing_table(histories, emissions, transitions, axs, ays, memoryless), path)


def read_listings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Histories (path, state, xs, ys), emissions (.., state, x, y, p; x null where outputs don't depend on it) and transitions (.., s_from, x, y, s_to) of state listings."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split("value", "(?m)^State number: ").alias("blocks"))
    blocks = files.select("path", F.posexplode("blocks").alias("i", "block")).where("i > 0")
    parts = blocks.select(
        "path", F.regexp_extract("block", r"^(\d+)", 1).cast("int").alias("state"), F.regexp_extract("block", r"(?s)^\d+\s*\n(.*?)distribution:", 1).alias("histories"),
        F.regexp_extract("block", r"(?s)distribution:(.*?)transitions:", 1).alias("given"), F.regexp_extract("block", r"transitions:([^\n]*)", 1).alias("moves"),
    )
    lines = parts.select("path", "state", F.explode(F.split("histories", "\n")).alias("h")).where(F.col("h").contains(","))
    histories = lines.select("path", "state", F.trim(F.split("h", ",")[0]).alias("xs"), F.trim(F.split("h", ",")[1]).alias("ys"))
    field = lambda c, i, pattern: F.regexp_extract(c, pattern, i)
    cells = parts.select("path", "state", F.explode(F.regexp_extract_all("given", F.lit(r"(P\([^)]*\) = \S+)"), 1)).alias("c"))
    pattern = r"P\(([^|)]*)(?:\|([^,)]*),state)?\) = (\S+)"
    emissions = cells.select("path", "state", F.when(F.col("c").contains("|"), field("c", 2, pattern)).alias("x"), field("c", 1, pattern).alias("y"), field("c", 3, pattern).cast("double").alias("p"))
    moves = parts.select("path", F.col("state").alias("s_from"), F.explode(F.regexp_extract_all("moves", F.lit(r"(T\(\([^)]*\)\) = \S+)"), 1)).alias("c"))
    pattern = r"T\(\(([^,]*), ([^)]*)\)\) = (\S+)"
    found = moves.select("path", "s_from", field("c", 1, pattern).alias("x"), field("c", 2, pattern).alias("y"), field("c", 3, pattern).alias("to")).where("to <> 'NULL'")
    return histories, emissions, found.select("path", "s_from", "x", "y", F.col("to").cast("int").alias("s_to")).distinct()


def generator_table(rules: DataFrame) -> DataFrame:
    """model_id, at, text of generators ``rules(model_id, state, xs, ys, p)``: the probability of a one after the last inputs and outputs."""
    states = rules.groupBy("model_id", "state").agg(F.sort_array(F.collect_list(F.concat("xs", F.lit(", "), "ys"))).alias("h"), F.max("p").alias("p"))
    shown = states.withColumn("p", _numbers(True)("p", F.lit(True)))
    lines = F.concat(F.array(F.concat(F.lit("State "), "state")), "h", F.array(F.concat(F.lit("P(X = 1 | S = s) = "), "p")))
    return shown.select("model_id", "state", F.posexplode(lines).alias("i", "text")).select("model_id", F.array("state", F.lpad(F.col("i").cast("string"), 10, "0")).alias("at"), "text")


def read_generators(spark: SparkSession, path: str) -> DataFrame:
    """path, state, xs, ys, p of generator tables: blocks ``State s``, the histories ``x, y``, ``P(X = 1 | S = s) = p``."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split("value", "(?m)^State ").alias("blocks"))
    blocks = files.select("path", F.posexplode("blocks").alias("i", "block")).where("i > 0")
    parts = blocks.select("path", F.regexp_extract("block", r"^(\S+)", 1).alias("state"), F.regexp_extract("block", r"=\s*([0-9.eE+-]+)\s*$", 1).cast("double").alias("p"), F.explode(F.regexp_extract_all("block", F.lit(r"(?m)^(\w+,[ \t]*\w+)[ \t]*$"), 1)).alias("h"))
    return parts.select("path", "state", F.trim(F.split("h", ",")[0]).alias("xs"), F.trim(F.split("h", ",")[1]).alias("ys"), "p")


def numbered_states(histories: DataFrame) -> DataFrame:
    """model_id, state, n: states numbered from 0 in their order; a model's states are few."""
    return histories.select("model_id", "state").distinct().withColumn("n", F.row_number().over(Window.partitionBy("model_id").orderBy("state")) - 1)
