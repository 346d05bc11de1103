"""Model files: graph text with labelled edges, state listings, generator tables; series text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.small import held, pinned
from ..functions.stats import significant, state_label

EDGE = r'^\s*(\S+)\s*->\s*(\S+)\s*\[label = "(.*)"\];?\s*$'

GRAPH_HEAD = ["digraph {", "node [shape = circle];"]


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line, text of every line, numbered from 0 in each file; a file is read by as many tasks as it has blocks."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("text"))
    within = F.row_number().over(Window.partitionBy("path", "_block").orderBy("_at")) - 1
    sizes = rows.groupBy("path", "_block").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per block
    offsets = sizes.select("path", "_block", before.alias("_before"))
    return rows.withColumn("_within", within).join(offsets, ["path", "_block"]).select("path", (F.col("_within") + F.col("_before")).cast("long").alias("line"), "text")


def read_series(spark: SparkSession, path: str, every_line: bool = False) -> DataFrame:
    """path, line, text: the first line of each file, or with ``every_line`` each line as a realisation of its own."""
    rows = numbered_lines(spark, path).withColumn("text", F.trim("text"))
    return rows.where(F.col("text") != "") if every_line else rows.where(F.col("line") == 0)


def pair_series(x: DataFrame, y: DataFrame) -> DataFrame:
    """series_id, X, Y of two line tables: the n-th file of one (by path) goes with the n-th of the other, line by line.

    A line without its partner, or of another length, raises.  ``series_id`` is
    the line, plus 2^32 times the file's number.
    """

    def numbered(lines: DataFrame, name: str) -> DataFrame:
        files = pinned(lines.select("path").distinct()).select("path", F.row_number().over(Window.orderBy("path")).alias("file"))  # one row per file
        return lines.join(F.broadcast(files), "path").select((F.col("file") - 1).cast("long").alias("file"), "line", F.col("text").alias(name))

    both = numbered(x, "X").join(numbered(y, "Y"), ["file", "line"], "full")
    ok = F.length("X") == F.length("Y")
    checked = F.when(F.coalesce(ok, F.lit(False)), F.col("X")).otherwise(F.raise_error(F.lit("series differ in number or length")))
    return both.select((F.shiftleft("file", 32) + F.col("line")).alias("series_id"), checked.alias("X"), "Y")


def edge_lines(text: DataFrame) -> DataFrame:
    """path, line, s_from, s_to, label from rows (path, line, text): the lines that are edges."""
    part = lambda i: F.regexp_extract("text", EDGE, i)
    return text.where(F.col("text").contains("->")).select("path", "line", part(1).alias("s_from"), part(2).alias("s_to"), part(3).alias("label"))


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line, text of each file; a model's file is small, so it is read whole to number its lines."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split("value", "\r?\n").alias("lines"))
    return files.select("path", F.posexplode("lines").alias("line", "text"))


def labels_of(lines: DataFrame) -> DataFrame:
    """path, line, s_from, x, y, s_to, p from edge lines with labels ``y|x:p``."""
    parts = lines.select("path", "line", "s_from", "s_to", F.explode(F.filter(F.split("label", r"\\l"), lambda s: F.trim(s) != "")).alias("one"))
    get = lambda i: F.regexp_extract("one", r"^(.*?)\|(.*?):(.*)$", i)
    return parts.select("path", "line", "s_from", get(2).alias("x"), get(1).alias("y"), "s_to", get(3).cast("double").alias("p"))


def graph_lines(edges: DataFrame, places: int = 6) -> DataFrame:
    """text: one edge line per pair of states of ``edges(s_from, x, y, s_to, p)``, labels by input, then output."""
    one = F.concat(F.col("y"), F.lit("|"), F.col("x"), F.lit(":"), F.format_string(f"%.{places}f", "p"), F.lit("\\l"))
    shown = edges.where("p > 0").select("s_from", "s_to", F.struct("x", "y", one.alias("one")).alias("label"))
    joined = shown.groupBy("s_from", "s_to").agg(F.array_join(F.transform(F.array_sort(F.collect_list("label")), lambda r: r["one"]), "").alias("label"))
    return joined.select(F.concat(F.col("s_from"), F.lit(" -> "), F.col("s_to"), F.lit(' [label = "'), F.col("label"), F.lit('"];')).alias("text"))


def read_transducer(spark: SparkSession, path: str) -> DataFrame:
    """path, line, s_from, x, y, s_to, p of labels ``y|x:p``, each ended by a literal backslash and l."""
    return labels_of(edge_lines(file_lines(spark, path)))


def read_machine(spark: SparkSession, path: str, dialect: str = "transducer") -> DataFrame:
    """path, line, s_from, x (the emitted symbol), s_to, p.

    Dialects: 'machine' has one ``x:p`` per edge, 'machine-lines' several ended
    by a backslash and l, 'transducer' ignores the input part of ``x|input:p``.
    """
    lines = edge_lines(file_lines(spark, path))
    if dialect == "machine":
        parts = lines.withColumn("one", F.col("label"))
    elif dialect in ("machine-lines", "transducer"):
        parts = lines.select("path", "line", "s_from", "s_to", F.explode(F.filter(F.split("label", r"\\l"), lambda s: F.trim(s) != "")).alias("one"))
    else:
        raise ValueError(f"unknown dialect {dialect!r}")
    pattern = r"^(.*?)\|.*:(.*)$" if dialect == "transducer" else r"^(.*?):(.*)$"
    return parts.select("path", "line", "s_from", F.regexp_extract("one", pattern, 1).alias("x"), "s_to", F.regexp_extract("one", pattern, 2).cast("double").alias("p"))


def state_order(edges: DataFrame) -> DataFrame:
    """path, state, idx in order of first appearance in the file."""
    seen = edges.select("path", F.col("s_from").alias("state"), (F.col("line") * 2).alias("at")).unionByName(edges.select("path", F.col("s_to").alias("state"), (F.col("line") * 2 + 1).alias("at")))
    first = seen.groupBy("path", "state").agg(F.min("at").alias("at"))
    return first.select("path", "state", (F.row_number().over(Window.partitionBy("path").orderBy("at")) - 1).alias("idx"))


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """path, state, xs, ys of a state listing: one row per history (the empty one reads ``, ``)."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.explode(F.slice(F.split("value", "State number: "), 2, 1_000_000)).alias("block"))
    head = files.select("path", F.regexp_extract("block", r"^(\d+)", 1).cast("int").alias("state"), F.regexp_extract("block", r"(?s)^\d+\s*\n(.*?)distribution:", 1).alias("body"))
    lines = head.select("path", "state", F.explode(F.split("body", "\n")).alias("h")).where(F.col("h").contains(","))
    return lines.select("path", "state", F.trim(F.split("h", ",")[0]).alias("xs"), F.trim(F.split("h", ",")[1]).alias("ys"))


def read_generator(text: str) -> dict[tuple[str, str], float]:
    """Probability of a one by (last inputs, last outputs), from blocks ``State s`` / ``x, y`` / ``P(X = 1 | S = s) = p``."""
    out: dict[tuple[str, str], float] = {}
    for block in re.split(r"^State .*$", text, flags=re.M)[1:]:
        p = float(re.search(r"=\s*([0-9.eE+-]+)\s*$", block.strip())[1])
        for x, y in re.findall(r"^(\w+),\s*(\w+)\s*$", block, flags=re.M):
            out[x, y] = p
    return out


def null_machine(spark: SparkSession) -> DataFrame:
    """The machine that emits 0 for ever: one state, one edge."""
    return spark.createDataFrame([("A", "0", "A", 1.0)], "s_from string, x string, s_to string, p double")


def graph_text(edges: list[tuple[int, str, str, int, float | None]], all_digits: bool = False, one_line_per_pair: bool = True, dialect: str = "transducer") -> str:
    """Graph text of (s_from, x, y, s_to, p): labels ``y|x:p``, with three significant digits unless all are asked for.

    Edges of one pair of states share a line, each label ended by a backslash
    and l; otherwise each has a line of its own, without that end.  A model of one
    state has a line per possible label, with all digits.  Unknown probabilities
    are left out.  Dialects: 'machine' writes ``y:p``, 'memoryless' and
    'transducer' ``y|x:p``.
    """
    if dialect not in ("transducer", "machine", "memoryless"):
        raise ValueError(f"unknown dialect {dialect!r}")
    single = len({s for a, _, _, b, _ in edges for s in (a, b)}) == 1 and one_line_per_pair
    number = (lambda p: repr(float(p))) if all_digits or single else significant
    lines: dict[tuple[int, int], list[str]] = {}
    for a, x, y, b, p in edges:
        if p is not None and p == p and (p > 0 or not single):
            lines.setdefault((a, b), []).append(f"{y}:{number(p)}" if dialect == "machine" else f"{y}|{x}:{number(p)}")
    out = list(GRAPH_HEAD)
    for (a, b), labels in lines.items():
        ended = [f"{x}\\l" for x in labels]
        for text in (ended if single else ["".join(ended)]) if one_line_per_pair else labels:
            out.append(f'{state_label(a)} -> {state_label(b)} [label = "{text}"];')
    return "\n".join([*out, "}"])


def model_edges(histories: DataFrame, transitions: DataFrame, morph: DataFrame) -> list[tuple[int, str, str, int, float | None]]:
    """(s_from, x, y, s_to, p) of a fitted model in the order of states, outputs and inputs, for :func:`graph_text`."""
    counts = {(r["state"], r["x"], r["y"]): r["n"] for r in held(morph.select("state", "x", "y", "n"))}
    rows = held(transitions.select("s_from", "x", "y", "s_to"))
    total: dict[tuple[int, str], int] = {}
    for (s, x, _), n in counts.items():
        total[s, x] = total.get((s, x), 0) + n
    order = {s: i for i, s in enumerate(sorted({r["state"] for r in held(histories.select("state").distinct())}))}
    out = [(order[r["s_from"]], r["x"], r["y"], order[r["s_to"]], counts.get((r["s_from"], r["x"], r["y"]), 0) / total[r["s_from"], r["x"]] if total.get((r["s_from"], r["x"])) else None) for r in rows]
    return sorted(out, key=lambda e: (e[0], e[3], e[2], e[1]))


def states_text(histories: list[tuple[int, str, str]], morph: dict[tuple[int, str, str], float], steps: dict[tuple[int, str, str], int], axs: list[str], ays: list[str]) -> str:
    """State listing: histories by length and name, the distribution, the transitions (NULL where there are none)."""
    blocks = []
    for s in sorted({h[0] for h in histories}):
        own = sorted(((x, y) for k, x, y in histories if k == s), key=lambda h: (len(h[0]), h))
        dist = "".join(f"P({y}|{x},state) = {morph.get((s, x, y), 0.0)}\t" + ("\n" if y == ays[-1] else "") for x in axs for y in ays)
        moves = "".join(f"T(({x}, {y})) = {steps.get((s, x, y), 'NULL')}\t" for x in axs for y in ays)
        blocks.append(f"State number: {s}\n" + "".join(f"{x}, {y}\n" for x, y in own) + f"distribution: \n{dist}transitions: {moves}\nP(State) = ...\n")
    return "\n".join(blocks)


def write_series(symbols: DataFrame, path: str) -> None:
    """One line of output symbols per series."""
    from ..operators.encode import to_strings

    to_strings(symbols).select(F.col("Y").alias("value")).write.mode("overwrite").text(path)
