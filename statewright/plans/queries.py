"""The registered queries over the synthetic tables, and SQL that states the same results."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.small import pinned, removed, shared_folder
from ..functions.stats import state_label
from ..operators import algebra, counts, encode, filters, graph, hypothesis, infer, measures, metrics, selection, simulate
from ..operators.intervals import cumulative_intervals, interval_join
from ..sources import model_files, models

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
DIGITS = 6


def query(sql: str | None = None) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    """Registers a query under its name; doubles are rounded so that orders of summation don't show."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[F.round(c, DIGITS).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])

        QUERIES[f.__name__] = rounded
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# -- inputs


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbols of users: x tells values of 30 and more, y is the event's first letter."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "event_type", "value")
    return encode.encode(table, "user_id", ["ts", "event_id"], F.substring("event_type", 1, 1), F.when(F.col("value") >= 30, "1").otherwise("0"), bucket=F.to_date("ts"))


def binary_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with y 1 for purchases and views."""
    return events(spark, sf_dir).withColumn("y", F.when(F.col("y").isin("p", "v"), "1").otherwise("0"))


def pair_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of single pairs and of two in a row: the only look at the events that the models below take."""
    return pinned(counts.word_counts(binary_events(spark, sf_dir), 1))


def machine_of(words: DataFrame) -> DataFrame:
    """The Markov machine of the inputs."""
    return algebra.machine_from_counts(words.select("k", F.col("xs").alias("ys"), "n"), 1)


def models_of_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The machine of the inputs and the transducer of the outputs, from one count."""
    words = pair_words(spark, sf_dir)
    return pinned(machine_of(words)), pinned(algebra.transducer_from_counts(words, 1))


def machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return machine_of(pair_words(spark, sf_dir))


def transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pinned(algebra.transducer_from_counts(pair_words(spark, sf_dir), 1))


def letter_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pinned(algebra.machine_from_counts(counts.word_counts(encode.constant_input(events(spark, sf_dir)), 1), 1))


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
ORDER_ORDER = ["o_orderdate", "o_orderkey"]


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", *LINE_ORDER, "l_returnflag", "l_linestatus")
    return encode.encode(table, "l_orderkey", LINE_ORDER, F.col("l_returnflag"), F.col("l_linestatus"))


def line_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y, after of an order's lines."""
    return encode.followers(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_orderkey", LINE_ORDER, "l_returnflag")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", *ORDER_ORDER, "o_orderstatus")
    return encode.encode(table, "o_custkey", ORDER_ORDER, F.col("o_orderstatus"))


def order_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y, after of a customer's orders."""
    return encode.followers(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_custkey", ORDER_ORDER, "o_orderstatus")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role")
    return encode.encode(table, "conv_id", ["turn"], F.substring("role", 1, 1))


S = """s AS (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t,
 CASE WHEN value >= 30 THEN '1' ELSE '0' END AS x, substr(event_type, 1, 1) AS y FROM events)"""
B = S + """, b AS (SELECT series_id, t, x, CASE WHEN y IN ('p', 'v') THEN '1' ELSE '0' END AS y FROM s)"""
LINES = """s AS (SELECT l_orderkey AS series_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS t,
 l_linestatus AS x, l_returnflag AS y FROM lineitem)"""
ORDERS = """s AS (SELECT o_custkey AS series_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS t, '0' AS x, o_orderstatus AS y FROM orders)"""
TALKS = """s AS (SELECT conv_id AS series_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS t, '0' AS x, substr(role, 1, 1) AS y FROM conversations)"""


def windows_sql(length: int, source: str = "s", x: str = "x", y: str = "y") -> str:
    word = lambda c: " || ".join([c, *[f"lead({c}, {i}) OVER w" for i in range(1, length + 1)]])
    return f"f AS (SELECT * FROM (SELECT series_id, t, {word(x)} AS xs, {word(y)} AS ys FROM {source} WINDOW w AS (PARTITION BY series_id ORDER BY t)) WHERE ys IS NOT NULL)"


def words_sql(length: int, source: str = "s", x: str = "x", y: str = "y") -> str:
    return windows_sql(length, source, x, y) + f", g AS (SELECT k::INT AS k, left(xs, k) AS xs, left(ys, k) AS ys, count(*) AS n FROM f, range(1, {length + 2}) r(k) GROUP BY ALL)"


CONST = "c AS (SELECT series_id, t, '0' AS x, y FROM s)"
M = """mw AS (SELECT x AS a, lead(x) OVER (PARTITION BY series_id ORDER BY t) AS b FROM b),
m AS (SELECT a AS s_from, b AS x, b AS s_to, count(*) / sum(count(*)) OVER (PARTITION BY a) AS p FROM mw WHERE b IS NOT NULL GROUP BY a, b)"""
T = """tw AS (SELECT y AS a, lead(x) OVER w AS x, lead(y) OVER w AS b FROM b WINDOW w AS (PARTITION BY series_id ORDER BY t)),
tr AS (SELECT a AS s_from, x, b AS y, b AS s_to, count(*) / sum(count(*)) OVER (PARTITION BY a, x) AS p FROM tw WHERE b IS NOT NULL GROUP BY a, x, b)"""
MT = f"WITH {B}, {M}, {T}"
LETTERS = f"""{S}, lw AS (SELECT y AS a, lead(y) OVER (PARTITION BY series_id ORDER BY t) AS b FROM s),
l AS (SELECT a AS s_from, b AS x, b AS s_to, count(*) / sum(count(*)) OVER (PARTITION BY a) AS p FROM lw WHERE b IS NOT NULL GROUP BY a, b)"""

# -- series


@query(f"WITH {S} SELECT * FROM s")
def symbols_encode(spark, sf):
    return events(spark, sf)


@query(f"WITH {LINES} SELECT * FROM s")
def lineitem_symbols(spark, sf):
    return lineitems(spark, sf)


@query(f"WITH {S} SELECT series_id, t, '0' AS x, y FROM s")
def const_input(spark, sf):
    return encode.constant_input(events(spark, sf))


@query(f"WITH {S} SELECT * FROM s WHERE t < 20")
def prefix_limit(spark, sf):
    """The prefix operator itself: the first 20 symbols of each series."""
    return encode.first_symbols(events(spark, sf), 20)


@query(f"WITH {S} SELECT s.*, CASE WHEN t < floor(count(*) OVER (PARTITION BY series_id) * 0.5) THEN 'train' ELSE 'test' END AS part FROM s")
def train_test_split(spark, sf):
    return encode.split_train_test(events(spark, sf))


@query(f"WITH {S} SELECT 'y' AS role, y AS symbol, (row_number() OVER (ORDER BY y) - 1)::INT AS idx FROM (SELECT DISTINCT y FROM s)")
def alphabet(spark, sf):
    return encode.alphabet(events(spark, sf), "y")


@query(f"WITH {S}, ax AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i FROM (SELECT DISTINCT x FROM s)), ay AS (SELECT y, row_number() OVER (ORDER BY y) - 1 AS j FROM (SELECT DISTINCT y FROM s)) SELECT x, y, i * (SELECT count(*) FROM ay) + j AS e_idx FROM ax, ay")
def emission_product(spark, sf):
    return encode.emission_symbols(events(spark, sf))


@query(f"WITH {S} SELECT series_id, string_agg(x, '' ORDER BY t) AS \"X\", string_agg(y, '' ORDER BY t) AS \"Y\" FROM s GROUP BY 1")
def series_strings(spark, sf):
    return encode.to_strings(events(spark, sf))


@query(f"WITH {S} SELECT * FROM s")
def strings_round_trip(spark, sf):
    return encode.explode_strings(encode.to_strings(events(spark, sf)))


# -- counts


@query(f"WITH {S}, {words_sql(3)} SELECT * FROM g")
def word_counts_m0(spark, sf):
    return counts.word_counts(events(spark, sf), 3, method=0)


@query(f"WITH {S}, {words_sql(3)} SELECT * FROM g")
def word_counts_m1(spark, sf):
    return counts.word_counts(events(spark, sf), 3)


@query(f"WITH {S}, {words_sql(5)} SELECT * FROM g")
def word_counts_l5(spark, sf):
    return counts.word_counts(events(spark, sf), 5)


@query(f"WITH {S}, {words_sql(3)} SELECT k, xs, left(ys, k - 1) AS ys, sum(n)::BIGINT AS n FROM g GROUP BY ALL")
def marg_counts(spark, sf):
    return counts.marginal_counts(counts.word_counts(events(spark, sf), 3))


@query(f"WITH {S}, {words_sql(3)} SELECT k, xs, left(ys, k - 1) AS past, right(ys, 1) AS y, grouping(right(ys, 1)) = 1 AS margin, sum(n)::BIGINT AS n FROM g GROUP BY GROUPING SETS ((k, xs, left(ys, k - 1), right(ys, 1)), (k, xs, left(ys, k - 1)))")
def words_with_margins(spark, sf):
    """Words and the sums over their last output, by grouping sets."""
    return counts.words_and_margins(events(spark, sf), 3)


@query(f"WITH {S}, f0 AS (SELECT series_id FROM s WHERE t = 0 AND y = 'p'), n0 AS (SELECT series_id, t, CASE WHEN series_id IN (FROM f0) THEN '0' ELSE x END AS x, y FROM s), {words_sql(3, 'n0')} SELECT * FROM g")
def counts_after_retraction(spark, sf):
    """Series that begin with a purchase are withdrawn and come again with their inputs masked; the others aren't counted again."""
    symbols = events(spark, sf)
    first = symbols.where("t = 0 and y = 'p'").select("series_id")
    changed = symbols.join(first, "series_id", "left_semi")
    return counts.revised_counts(counts.word_counts(symbols, 3), counts.word_deltas(3, encode.constant_input(changed), changed))


@query(f"WITH {S}, {words_sql(3)} SELECT * FROM g")
def counts_after_append(spark, sf):
    """The symbols of the second half of each series arrive after the first half was counted."""
    halves = encode.split_train_test(events(spark, sf))
    before = halves.where("part = 'train'").drop("part")
    since = halves.where("part = 'test'").groupBy("series_id").agg(F.min("t").alias("first"))
    return counts.revised_counts(counts.word_counts(before, 3), counts.appended_deltas(halves.drop("part"), since, 3))


def long_words_sql(width: int) -> str:
    return f"SELECT string_agg(b.x, '' ORDER BY b.t) AS xs, string_agg(b.y, '' ORDER BY b.t) AS ys FROM b a JOIN b ON b.series_id = a.series_id AND b.t BETWEEN a.t AND a.t + {width - 1} GROUP BY a.series_id, a.t HAVING count(*) = {width}"


@query(f"WITH {B}, f AS ({long_words_sql(33)}) SELECT xs, ys, count(*) AS n FROM f GROUP BY ALL")
def word_counts_l32(spark, sf):
    """Words of 33 pairs, by names of words of doubling length."""
    return counts.long_word_counts(binary_events(spark, sf), 33)


@query(f"WITH {LINES}, b AS (FROM s), f AS ({long_words_sql(3)}) SELECT xs, ys, count(*) AS n FROM f GROUP BY ALL")
def word_counts_named(spark, sf):
    """Words of three pairs of line items, by names."""
    return counts.long_word_counts(lineitems(spark, sf), 3)


@query(f"WITH {LINES}, {words_sql(2)} SELECT * FROM g")
def multiline_counts(spark, sf):
    return counts.word_counts(lineitems(spark, sf), 2)


@query(
    "WITH s AS (SELECT 0::BIGINT AS series_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS t, '0' AS x, substr(event_type, 1, 1) AS y FROM events), " + words_sql(3) + " SELECT * FROM g"
)
def single_series_counts(spark, sf):
    """All events as one series: ranked by day, counted by chunk."""
    table = spark.read.parquet(f"{sf}/events.parquet").select("ts", "event_id", "event_type")
    one = encode.encode(table, F.lit(0).cast("long"), ["ts", "event_id"], F.substring("event_type", 1, 1), bucket=F.to_date("ts"))
    full = counts.windows(one, 3, chunk=4096).groupBy("xs", "ys").agg(F.count("*").alias("n"))
    return counts._prefixes(full, 3)


@query(f"WITH {S}, {words_sql(2)} SELECT k, xs, left(ys, k - 1) AS past, right(ys, 1) AS y, n, round(n / sum(n) OVER (PARTITION BY k, xs, left(ys, k - 1)), 6) AS p FROM g")
def conditional_probs(spark, sf):
    return counts.conditional(counts.word_counts(events(spark, sf), 2))


@query(f"WITH {TALKS}, {words_sql(2)} SELECT k, xs, left(ys, k - 1) AS past, right(ys, 1) AS y, n, round(n / sum(n) OVER (PARTITION BY k, xs, left(ys, k - 1)), 6) AS p FROM g")
def conversation_conditional(spark, sf):
    return counts.conditional(counts.word_counts(conversations(spark, sf), 2))


@query(f"WITH {S}, {words_sql(2)} SELECT right(ys, 1) AS y, n, round(n / sum(n) OVER (), 6) AS p FROM g WHERE xs = '01' AND left(ys, 1) = 'p' AND k = 2")
def history_distribution(spark, sf):
    return counts.history_distribution(counts.word_counts(events(spark, sf), 2), "01", "p")


@query(
    f"WITH {B}, {words_sql(2, 'b')}, q AS (SELECT xs, left(ys, 2) AS past, sum(n) FILTER (right(ys, 1) = '0') AS a, sum(n) FILTER (right(ys, 1) = '1') AS b FROM g WHERE k = 3 GROUP BY 1, 2) "
    "SELECT xs, past, CASE WHEN a IS NULL THEN 'na' ELSE printf('%.6f', a / (a + coalesce(b, 0))) END AS p_0, CASE WHEN b IS NULL THEN 'na' ELSE printf('%.6f', b / (b + coalesce(a, 0))) END AS p_1, coalesce(a, 0)::BIGINT AS n_0, coalesce(b, 0)::BIGINT AS n_1 FROM q"
)
def stochastic_matrix(spark, sf):
    return counts.stochastic_matrix(counts.word_counts(binary_events(spark, sf), 2), ["0", "1"], 3)


PAST = windows_sql(3) + ", g AS (SELECT k::INT AS k, left(xs, k - 1) AS xs, left(ys, k) AS ys, count(*) AS n FROM f, range(1, 5) r(k) GROUP BY ALL)"


@query(f"WITH {S}, {PAST} SELECT * FROM g")
def legacy_counts(spark, sf):
    return counts.past_only_counts(events(spark, sf), 3)


@query(f"WITH {S}, {PAST} SELECT k, xs, repeat('n', k - 1) || right(ys, 1) AS ys, sum(n)::BIGINT AS n FROM g GROUP BY ALL")
def memoryless_counts(spark, sf):
    return counts.output_memoryless_counts(events(spark, sf), 3)


@query(f"WITH {S}, {PAST} SELECT k, repeat('n', k - 1) AS xs, ys, sum(n)::BIGINT AS n FROM g GROUP BY ALL")
def input_memoryless_counts(spark, sf):
    return counts.input_memoryless_counts(events(spark, sf), 3)


@query(
    f"WITH {B}, e AS (SELECT series_id, t, (x::INT * 2 + y::INT)::VARCHAR AS c FROM b), "
    "f AS (SELECT c || ',' || lead(c, 1) OVER w || ',' || lead(c, 2) OVER w AS word FROM e WINDOW w AS (PARTITION BY series_id ORDER BY t)) SELECT word, count(*) AS n FROM f WHERE word IS NOT NULL GROUP BY 1"
)
def joint_encoded_counts(spark, sf):
    return counts.joint_encoded_counts(binary_events(spark, sf), 2)


# -- tests

PAIRS = f"""WITH {B}, {words_sql(2, "b")},
r AS (SELECT k, left(xs, k - 1) AS hx, left(ys, k - 1) AS hy, right(xs, 1) AS x, right(ys, 1) AS y, n FROM g),
c AS (SELECT DISTINCT k, hx, hy, x, o.y FROM r, (SELECT DISTINCT y FROM r) o WHERE k > 1),
q AS (SELECT c.hx AS xs, c.hy AS past, c.x, c.y, coalesce(a.n, 0) AS n_child, coalesce(p.n, 0) AS n_parent
      FROM c LEFT JOIN r a ON a.hx = c.hx AND a.hy = c.hy AND a.x = c.x AND a.y = c.y LEFT JOIN r p ON p.hx = substr(c.hx, 2) AND p.hy = substr(c.hy, 2) AND p.x = c.x AND p.y = c.y)"""
SIZED = """, z AS (SELECT *, sum(n_child) OVER w AS a, sum(n_parent) OVER w AS b, (n_child + n_parent) / (sum(n_child) OVER w + sum(n_parent) OVER w) AS o FROM q WINDOW w AS (PARTITION BY xs, past, x))"""


@query(PAIRS + " SELECT xs, past, x, y, n_child::BIGINT AS n_child, n_parent::BIGINT AS n_parent FROM q")
def history_parent_pairs(spark, sf):
    return hypothesis.parent_pairs(counts.word_counts(binary_events(spark, sf), 2))


@query(
    PAIRS
    + SIZED
    + """, st AS (SELECT xs, past, sum(CASE WHEN o > 0 THEN (n_child - o * a) ** 2 / (o * a) + (n_parent - o * b) ** 2 / (o * b) ELSE 0 END) AS stat, count(DISTINCT x) AS df FROM z WHERE a > 0 AND b > 0 GROUP BY 1, 2)
SELECT xs, past, round(stat, 6) AS stat, df, CASE df WHEN 1 THEN stat > 10.827566170662733 WHEN 2 THEN stat > 13.815510557964274 ELSE false END AS reject FROM st"""
)
def chi2_stat(spark, sf):
    return hypothesis.rejected(hypothesis.homogeneity_stats(hypothesis.parent_pairs(counts.word_counts(binary_events(spark, sf), 2))))


# Critical values of chi-squared at 0.001, from tables, for 1 to 16 degrees of freedom.
TABLED = "[10.828, 13.816, 16.266, 18.467, 20.515, 22.458, 24.322, 26.124, 27.877, 29.588, 31.264, 32.909, 34.528, 36.123, 37.697, 39.252]"
WIDE = f"""WITH v AS (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t,
 CASE WHEN value < 15 THEN '0' WHEN value < 30 THEN '1' WHEN value < 60 THEN '2' ELSE '3' END AS x, substr(event_type, 1, 1) AS y FROM events), {words_sql(1, "v")},
""" + PAIRS[PAIRS.index("r AS (SELECT k, left") :]


@query(
    WIDE
    + SIZED
    + f""", st AS (SELECT xs, past, sum(CASE WHEN o > 0 THEN (n_child - o * a) ** 2 / (o * a) + (n_parent - o * b) ** 2 / (o * b) ELSE 0 END) AS stat, count(DISTINCT x) * 4 AS df FROM z WHERE a > 0 AND b > 0 GROUP BY 1, 2)
SELECT xs, past, round(stat, 6) AS stat, df, stat > {TABLED}[df] AS reject FROM st"""
)
def chi2_stat_wide(spark, sf):
    """Four inputs and five outputs: up to 16 degrees of freedom."""
    value = F.col("value")
    x = F.when(value < 15, "0").when(value < 30, "1").when(value < 60, "2").otherwise("3")
    table = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "ts", "event_id", "event_type", "value")
    symbols = encode.encode(table, "user_id", ["ts", "event_id"], F.substring("event_type", 1, 1), x, bucket=F.to_date("ts"))
    return hypothesis.rejected(hypothesis.homogeneity_stats(hypothesis.parent_pairs(counts.word_counts(symbols, 1))))


@query(
    PAIRS
    + SIZED
    + """ SELECT xs, past, round(sum((CASE WHEN n_child > 0 THEN 2 * n_child * ln(n_child / (o * a)) ELSE 0 END) + (CASE WHEN n_parent > 0 THEN 2 * n_parent * ln(n_parent / (o * b)) ELSE 0 END)), 6) AS stat, count(DISTINCT x) AS df
FROM z WHERE a > 0 AND b > 0 GROUP BY 1, 2"""
)
def g_stat(spark, sf):
    return hypothesis.homogeneity_stats(hypothesis.parent_pairs(counts.word_counts(binary_events(spark, sf), 2)), "G")


@query(
    PAIRS
    + """, h AS (SELECT xs, past, y, sum(n_child) AS m1, sum(n_parent) AS m2 FROM q GROUP BY 1, 2, 3), i AS (SELECT *, sum(m1) OVER w AS s1, sum(m2) OVER w AS s2 FROM h WINDOW w AS (PARTITION BY xs, past))
SELECT xs, past, round(sum(CASE WHEN m1 + m2 > 0 THEN (sqrt(s2 / s1) * m1 - sqrt(s1 / s2) * m2) ** 2 / (m1 + m2) ELSE 0 END), 6) AS stat, count(*) - 1 AS df FROM i WHERE s1 > 0 AND s2 > 0 GROUP BY 1, 2"""
)
def legacy_chi2_stat(spark, sf):
    return hypothesis.two_histogram_stats(hypothesis.parent_pairs(counts.word_counts(binary_events(spark, sf), 2)))


@query(
    PAIRS
    + SIZED
    + """, st AS (SELECT xs, past, sum(CASE WHEN o > 0 THEN (n_child - o * a) ** 2 / (o * a) + (n_parent - o * b) ** 2 / (o * b) ELSE 0 END) AS stat, count(DISTINCT x) AS df FROM z WHERE a > 0 AND b > 0 GROUP BY 1, 2)
SELECT xs, past, round(exp(-stat / 2), 6) AS p FROM st WHERE df = 2"""
)
def chi2_p_two_degrees(spark, sf):
    stats = hypothesis.homogeneity_stats(hypothesis.parent_pairs(counts.word_counts(binary_events(spark, sf), 2))).where("df = 2")
    return stats.select("xs", "past", hypothesis.even_tail(F.col("stat"), 1).alias("p"))


# -- histories and graphs


@query(
    f"WITH {B}, {words_sql(2, 'b')}, h AS (SELECT DISTINCT left(xs, k - 1) AS xs, left(ys, k - 1) AS ys FROM g WHERE k = 2), a AS (SELECT DISTINCT x FROM b), o AS (SELECT DISTINCT y FROM b) "
    "SELECT a.x || h.xs AS xs, o.y || h.ys AS ys FROM h, a, o WHERE EXISTS (SELECT 1 FROM g WHERE k = 3 AND left(g.xs, 2) = a.x || h.xs AND left(g.ys, 2) = o.y || h.ys)"
)
def history_children(spark, sf):
    words = counts.word_counts(binary_events(spark, sf), 2)
    marg = counts.marginal_counts(words)
    parents = marg.where("k = 2").select(F.expr("left(xs, 1)").alias("hx"), F.col("ys").alias("hy")).distinct()
    grown = parents.join(F.broadcast(encode.emission_symbols(binary_events(spark, sf)).select("x", "y")))  # times the emissions
    child = grown.select(F.concat("x", "hx").alias("xs"), F.concat("y", "hy").alias("ys"))
    occurring = marg.where("k = 3").select(F.expr("left(xs, 2)").alias("xs"), "ys").distinct()
    return child.join(occurring, ["xs", "ys"], "left_semi")


MARKOV2 = f"{S}, {CONST}, {words_sql(2, 'c')}"


@query(f"WITH {MARKOV2} SELECT left(ys, 2) AS s_from, right(ys, 1) AS x, right(ys, 2) AS s_to, round(n / sum(n) OVER (PARTITION BY left(ys, 2)), 6) AS p FROM g WHERE k = 3")
def order2_markov(spark, sf):
    return algebra.machine_from_counts(counts.word_counts(encode.constant_input(events(spark, sf)), 2), 2)


STATUS = f"WITH RECURSIVE {ORDERS}, {words_sql(1)}, e AS (SELECT DISTINCT left(ys, 1) AS s_from, right(ys, 1) AS s_to FROM g WHERE k = 2), q AS (SELECT s_from, s_to FROM e UNION SELECT q.s_from, e.s_to FROM q JOIN e ON q.s_to = e.s_from)"


def status_edges(spark: SparkSession, sf: str) -> DataFrame:
    return algebra.machine_from_counts(counts.word_counts(orders(spark, sf), 1), 1).select("s_from", "s_to")


@query(STATUS + " SELECT * FROM q")
def reachability(spark, sf):
    return graph.reachable(status_edges(spark, sf))


@query(STATUS + ", n AS (SELECT s_from AS state FROM e UNION SELECT s_to FROM e) SELECT state, least(state, coalesce((SELECT min(a.s_to) FROM q a JOIN q b ON a.s_from = b.s_to AND a.s_to = b.s_from WHERE a.s_from = state), state)) AS component FROM n")
def strong_components(spark, sf):
    return graph.mutual_components(status_edges(spark, sf))


LINEFLOW = f"WITH RECURSIVE {LINES}, w AS (SELECT series_id, y AS a, coalesce(lead(y) OVER (PARTITION BY series_id ORDER BY t), 'end') AS b FROM s), e AS (SELECT DISTINCT a AS s_from, b AS s_to FROM w UNION SELECT 'end', 'end'), q AS (SELECT s_from, s_to FROM e UNION SELECT q.s_from, e.s_to FROM q JOIN e ON q.s_to = e.s_from)"


@query(LINEFLOW + " SELECT * FROM e WHERE EXISTS (SELECT 1 FROM q WHERE q.s_from = e.s_to AND q.s_to = e.s_from) AND NOT EXISTS (SELECT 1 FROM q WHERE q.s_from = e.s_from AND NOT EXISTS (SELECT 1 FROM q b WHERE b.s_from = q.s_to AND b.s_to = e.s_from))")
def remove_transients(spark, sf):
    edges = line_flow(spark, sf).select(F.col("y").alias("s_from"), F.coalesce("after", F.lit("end")).alias("s_to")).distinct()
    edges = pinned(edges).unionByName(spark.createDataFrame([("end", "end")], "s_from string, s_to string"))
    return graph.without_transients(edges)


FLOWS = """WITH RECURSIVE li AS (SELECT l_orderkey AS series_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS t, 'l' || l_returnflag AS y FROM lineitem),
od AS (SELECT o_custkey AS series_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS t, 'o' || o_orderstatus AS y FROM orders),
w AS (SELECT y AS a, lead(y) OVER (PARTITION BY series_id ORDER BY t) AS b FROM li UNION ALL SELECT y, lead(y) OVER (PARTITION BY series_id ORDER BY t) FROM od),
e AS (SELECT DISTINCT a AS s_from, b AS s_to FROM w WHERE b IS NOT NULL UNION SELECT 'start', 'lR' UNION SELECT 'end', 'end'),
q AS (SELECT s_from, s_to FROM e UNION SELECT q.s_from, e.s_to FROM q JOIN e ON q.s_to = e.s_from),
n AS (SELECT s_from AS state FROM e UNION SELECT s_to FROM e),
c AS (SELECT n.state, coalesce((SELECT min(a.s_to) FROM q a JOIN q b ON a.s_from = b.s_to AND a.s_to = b.s_from WHERE a.s_from = n.state), n.state) AS component FROM n),
lv AS (SELECT DISTINCT e.s_from FROM e JOIN c x ON x.state = e.s_from JOIN c y ON y.state = e.s_to WHERE x.component <> y.component),
k AS (SELECT component, count(*) AS size FROM c WHERE state NOT IN (SELECT s_from FROM lv) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)"""


@query(FLOWS + " SELECT e.* FROM e WHERE s_from IN (SELECT state FROM c JOIN k USING (component)) AND s_to IN (SELECT state FROM c JOIN k USING (component))")
def recurrent_component(spark, sf):
    """Of two flows, a sink and a transient start the largest closed component."""
    marked = lambda flow, mark: flow.select(F.concat(F.lit(mark), "y").alias("s_from"), F.concat(F.lit(mark), "after").alias("s_to"))
    seen = marked(line_flow(spark, sf), "l").unionByName(marked(order_flow(spark, sf), "o")).where("s_to is not null").distinct()
    more = spark.createDataFrame([("start", "lR"), ("end", "end")], "s_from string, s_to string")
    return graph.recurrent_part(pinned(seen.unionByName(more)))


# Each order leads to the customer's next one; where the last one is finished, it leads back to the order in the middle.
RINGS = """WITH RECURSIVE o AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderstatus AS st, row_number() OVER w AS i, count(*) OVER (PARTITION BY o_custkey) AS n, lead(o_orderkey) OVER w AS z
 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
e AS (SELECT k AS s_from, z AS s_to FROM o WHERE z IS NOT NULL UNION SELECT l.k, m.k FROM o l JOIN o m ON l.c = m.c AND m.i = (l.n + 1) // 2 WHERE l.i = l.n AND l.st = 'F'),
q AS (SELECT s_from, s_to FROM e UNION SELECT q.s_from, e.s_to FROM q JOIN e ON q.s_to = e.s_from)"""


def ring_edges(spark: SparkSession, sf: str) -> DataFrame:
    table = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    own, order = Window.partitionBy("o_custkey"), Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    placed = table.select("o_custkey", "o_orderkey", "o_orderstatus", F.row_number().over(order).alias("i"), F.count("*").over(own).alias("n"), F.lead("o_orderkey").over(order).alias("z"))
    on = placed.where("z is not null").select(F.col("o_orderkey").alias("s_from"), F.col("z").alias("s_to"))
    middle = placed.where("i = (n + 1) div 2").select("o_custkey", F.col("o_orderkey").alias("s_to"))
    back = placed.where("i = n and o_orderstatus = 'F'").join(middle, "o_custkey").select(F.col("o_orderkey").alias("s_from"), "s_to")
    return on.unionByName(back)


@query(RINGS + " SELECT n.state, least(n.state, coalesce((SELECT min(a.s_to) FROM q a JOIN q b ON a.s_from = b.s_to AND a.s_to = b.s_from WHERE a.s_from = n.state), n.state)) AS component FROM (SELECT s_from AS state FROM e UNION SELECT s_to FROM e) n")
def order_rings(spark, sf):
    """Components of a graph with long ways: some orders of a customer lead round, those before them don't come back."""
    return graph.mutual_components(ring_edges(spark, sf))


@query(RINGS + " SELECT DISTINCT s_to AS state FROM q JOIN (SELECT min(k) AS first FROM o WHERE i = 1 AND st = 'P') f ON s_from = first UNION SELECT min(k) FROM o WHERE i = 1 AND st = 'P' HAVING count(*) > 0")
def orders_reached(spark, sf):
    """What the first order of one customer leads to: a frontier, not all pairs."""
    edges = ring_edges(spark, sf)
    starts = edges.join(edges.select(F.col("s_to").alias("s_from")).distinct(), "s_from", "left_anti").select("s_from").distinct()
    pending = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("s_from"))
    alone = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", "o_orderkey").groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("s_from")).where("n = 1").select("s_from")
    first = starts.unionByName(alone).join(pending, "s_from", "left_semi").agg(F.min("s_from").alias("state")).where("state is not null")
    return graph.reachable_from(edges, first)


@query(
    f"{MT}, h AS (SELECT lpad(bin(a.i), 3, '0') AS w FROM range(8) a(i)), st AS (SELECT s_from AS state, row_number() OVER (ORDER BY s_from) AS i FROM (SELECT DISTINCT s_from FROM tr)), "
    "z AS (SELECT x.w AS xs, y.w AS ys, t3.s_to AS state, row_number() OVER (PARTITION BY x.w, y.w ORDER BY st.i) AS o FROM h x, h y, st JOIN tr t1 ON t1.s_from = st.state JOIN tr t2 ON t2.s_from = t1.s_to JOIN tr t3 ON t3.s_from = t2.s_to WHERE t1.x || t2.x || t3.x = x.w AND t1.y || t2.y || t3.y = y.w) "
    "SELECT (substr(xs, 3, 1)::INT * 4 + substr(xs, 2, 1)::INT * 2 + substr(xs, 1, 1)::INT) / 8 AS x_num, (substr(ys, 3, 1)::INT * 4 + substr(ys, 2, 1)::INT * 2 + substr(ys, 1, 1)::INT) / 8 AS y_num, state FROM z WHERE o = 1"
)
def wordmap(spark, sf):
    t = transducer(spark, sf)
    states = t.select(F.col("s_from").alias("state")).distinct().withColumn("idx", F.row_number().over(Window.orderBy("state")))  # one row per state
    return graph.word_map(spark, t, 3, states)


@query(
    f"{MT}, w AS (SELECT DISTINCT xs, ys FROM (SELECT x || lead(x) OVER v AS xs, y || lead(y) OVER v AS ys FROM b WINDOW v AS (PARTITION BY series_id ORDER BY t)) WHERE ys IS NOT NULL), "
    "z AS (SELECT xs, ys, t2.s_to AS state, row_number() OVER (PARTITION BY xs, ys ORDER BY t1.s_from) AS o FROM w JOIN tr t1 ON t1.x = left(xs, 1) AND t1.y = left(ys, 1) JOIN tr t2 ON t2.s_from = t1.s_to AND t2.x = right(xs, 1) AND t2.y = right(ys, 1)) SELECT w.xs, w.ys, z.state FROM w LEFT JOIN z ON z.xs = w.xs AND z.ys = w.ys AND z.o = 1"
)
def map_words(spark, sf):
    t = transducer(spark, sf)
    states = t.select(F.col("s_from").alias("state")).distinct().withColumn("idx", F.row_number().over(Window.orderBy("state")))  # one row per state
    return graph.map_words(counts.windows(binary_events(spark, sf), 1).select("xs", "ys"), t, 2, states)


@query("SELECT n::BIGINT AS n, repeat(chr((65 + n % 26)::INT), (n // 26 + 1)::INT) AS label FROM range(100) r(n)")
def state_labels(spark, sf):
    return spark.range(100).select(F.col("id").alias("n"), F.expr("repeat(chr(65 + id % 26), int(id div 26 + 1))").alias("label"))


# -- algebra


@query(f"{MT} SELECT s_from, x, s_to, round(p, 6) AS p FROM m")
def input_machine(spark, sf):
    return machine(spark, sf)


@query(f"{MT} SELECT s_from, x, y, s_to, round(p, 6) AS p FROM tr")
def markov_transducer(spark, sf):
    return transducer(spark, sf)


MIXED = f"{MT}, j AS (SELECT tr.s_from AS t_from, m.s_from AS m_from, tr.x, y, tr.s_to AS t_to, m.s_to AS m_to, m.p * tr.p AS p FROM m JOIN tr USING (x))"


@query(MIXED + " SELECT t_from, m_from, t_to, m_to, round(sum(p), 6) AS p FROM j GROUP BY ALL")
def mixed_matrix(spark, sf):
    return algebra.mixed_matrix(*models_of_events(spark, sf))


@query(MIXED + " SELECT t_from, m_from, y, t_to, m_to, round(sum(p), 6) AS p FROM j GROUP BY ALL")
def output_matrix(spark, sf):
    return algebra.output_matrix(*models_of_events(spark, sf))


@query(f"WITH {LETTERS} SELECT s_from, s_to, round(sum(p), 6) AS p FROM l GROUP BY ALL")
def machine_matrix(spark, sf):
    return algebra.machine_matrix(letter_machine(spark, sf))


@query(f"WITH {LETTERS} SELECT s_from, x, s_to, round(p, 6) AS p FROM l")
def machine_matrix_by_symbol(spark, sf):
    return algebra.machine_matrix(letter_machine(spark, sf), normalise=False, by_symbol=True)


@query(f"WITH {MARKOV2}, e AS (SELECT left(ys, 2) AS s_from, right(ys, 1) AS x, right(ys, 2) AS s_to FROM g WHERE k = 3) SELECT s_from, x, s_to, round(1.0::DOUBLE / count(*) OVER (PARTITION BY s_from), 6) AS p FROM e")
def uniform_machine(spark, sf):
    return algebra.uniform_machine(algebra.machine_from_counts(counts.word_counts(encode.constant_input(events(spark, sf)), 2), 2))


# The limit of lazy steps, by squaring (P + I) / 2 eight times: 256 steps.
LIMIT = """, k0 AS MATERIALIZED (SELECT s_from, s_to, sum(p) / 2 AS p FROM (SELECT s_from, s_to, p FROM {e} UNION ALL SELECT DISTINCT s_from, s_from, 1.0::DOUBLE FROM {e}) GROUP BY 1, 2)""" + "".join(
    f", k{i} AS MATERIALIZED (SELECT a.s_from, b.s_to, sum(a.p * b.p) AS p FROM k{i - 1} a JOIN k{i - 1} b ON a.s_to = b.s_from GROUP BY 1, 2)" for i in range(1, 9)
) + ", st AS (SELECT s_to AS state, avg(p) AS pi FROM k8 GROUP BY 1)"


@query(f"WITH {LETTERS}{LIMIT.format(e='l')} SELECT state AS s_from, round(pi, 6) AS pi FROM st")
def stationary_distribution(spark, sf):
    return algebra.stationary(letter_machine(spark, sf), ["s_from"], ["s_to"])


@query(f"WITH {LETTERS} SELECT DISTINCT s_from AS state, 0.0::DOUBLE AS gap, 1.0::DOUBLE AS total FROM l")
def stationary_balance(spark, sf):
    """How far pi P is from pi in each state, and the sum of pi: what a stationary distribution is."""
    edges = letter_machine(spark, sf)
    pi = pinned(algebra.stationary(edges, ["s_from"], ["s_to"]))
    moved = pi.join(edges, "s_from").groupBy(F.col("s_to").alias("state")).agg(F.sum(F.col("pi") * F.col("p")).alias("moved"))
    total = pi.agg(F.sum("pi").alias("total"))
    both = pi.join(moved, pi["s_from"] == moved["state"], "left")
    return both.select(F.col("s_from").alias("state"), F.abs(F.round(F.col("pi") - F.coalesce("moved", F.lit(0.0)), 9)).alias("gap"), "pi").join(F.broadcast(total)).select("state", "gap", "total")


MIXED_PI = MIXED + ", mm AS (SELECT t_from || m_from AS s_from, t_to || m_to AS s_to, sum(p) AS p FROM j GROUP BY ALL)" + LIMIT.format(e="mm")


def mixed_pi_of(edges_m: DataFrame, edges_t: DataFrame) -> DataFrame:
    pi = algebra.stationary(algebra.mixed_matrix(edges_m, edges_t), ["t_from", "m_from"], ["t_to", "m_to"])
    return pi.select(F.col("t_from").alias("t"), F.col("m_from").alias("m"), "pi")


@query(MIXED_PI + " SELECT left(state, 1) AS state, round(sum(pi), 6) AS pi FROM st GROUP BY 1")
def stationary_marginal(spark, sf):
    return algebra.marginal(mixed_pi_of(*models_of_events(spark, sf)), "t")


@query(
    MIXED_PI
    + ", q AS (SELECT left(state, 1) AS t, sum(pi) AS pi FROM st GROUP BY 1) SELECT round((SELECT -sum(pi * log2(pi)) FROM q WHERE pi > 0), 6) AS c_x, round((SELECT -sum(k.pi * m.p * tr.p * log2(tr.p)) FROM st k JOIN m ON m.s_from = right(k.state, 1) JOIN tr ON tr.s_from = left(k.state, 1) AND tr.x = m.x), 6) AS h_x"
)
def conditional_measures(spark, sf):
    m, t = models_of_events(spark, sf)
    return algebra.conditional_measures(mixed_pi_of(m, t), m, t)


WORDS3 = f"WITH {LETTERS}{LIMIT.format(e='l')}, p1 AS (SELECT x AS word, s_to, pi * p AS w FROM st JOIN l ON s_from = state), p2 AS (SELECT word || x AS word, l.s_to, w * p AS w FROM p1 JOIN l ON l.s_from = p1.s_to), p3 AS (SELECT word || x AS word, l.s_to, w * p AS w FROM p2 JOIN l ON l.s_from = p2.s_to), wp AS (SELECT word, sum(w) AS p FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3) GROUP BY 1)"


def letter_words(spark: SparkSession, sf: str, length: int = 3) -> DataFrame:
    machine_edges = letter_machine(spark, sf)
    pi = algebra.stationary(machine_edges, ["s_from"], ["s_to"]).select(F.col("s_from").alias("state"), "pi")
    return algebra.word_probabilities(machine_edges, pi, length)


@query(WORDS3 + " SELECT word, round(p, 6) AS p FROM wp")
def word_probs(spark, sf):
    return letter_words(spark, sf)


@query(WORDS3 + " SELECT 'pvp' AS word, round(coalesce((SELECT p FROM wp WHERE word = 'pvp'), 0), 6) AS p")
def word_probability_one(spark, sf):
    machine_edges = letter_machine(spark, sf)
    pi = algebra.stationary(machine_edges, ["s_from"], ["s_to"]).select(F.col("s_from").alias("state"), "pi")
    return algebra.word_probability(machine_edges, pi, "pvp")


@query(WORDS3 + ", h AS (SELECT length(word)::INT AS length, -sum(p * log2(p)) AS h_block FROM wp GROUP BY 1), d AS (SELECT length, h_block, h_block - coalesce(lag(h_block) OVER (ORDER BY length), 0) AS h_gain FROM h) SELECT length, round(h_block, 6) AS h_block, round(h_gain, 6) AS h_gain, round(h_block - length * h_gain, 6) AS excess FROM d")
def block_entropy(spark, sf):
    return algebra.block_measures(letter_words(spark, sf))


@query(f"WITH {S}, {CONST}, {words_sql(4, 'c')}, wp AS (SELECT k, n / sum(n) OVER (PARTITION BY k) AS p FROM g), h AS (SELECT k AS length, -sum(p * log2(p)) AS h_block FROM wp GROUP BY 1), d AS (SELECT length, h_block, h_block - coalesce(lag(h_block) OVER (ORDER BY length), 0) AS h_gain FROM h) SELECT length, round(h_block, 6) AS h_block, round(h_gain, 6) AS h_gain, round(h_block - length * h_gain, 6) AS excess FROM d")
def empirical_entropy_rate(spark, sf):
    words = counts.word_counts(encode.constant_input(events(spark, sf)), 4)
    return algebra.block_measures(words.select(F.col("ys").alias("word"), (F.col("n") / F.sum("n").over(Window.partitionBy("k"))).alias("p")))


@query(WORDS3 + " SELECT right(word, 1) AS x, round(p / sum(p) OVER (), 6) AS p FROM wp WHERE length(word) = 3 AND left(word, 2) = 'pv'")
def predict_presync_machine(spark, sf):
    machine_edges = letter_machine(spark, sf)
    pi = algebra.stationary(machine_edges, ["s_from"], ["s_to"]).select(F.col("s_from").alias("state"), "pi")
    return filters.next_symbol(machine_edges, pi, "pv")


@query(
    MIXED_PI
    + ", a AS (SELECT j.t_to || j.m_to AS state, sum(pi * p) AS w FROM st JOIN j ON state = t_from || m_from WHERE j.x = '0' AND j.y = '1' GROUP BY 1), z AS (SELECT j.y, sum(w * p) AS w FROM a JOIN j ON state = t_from || m_from WHERE j.x = '1' GROUP BY 1) SELECT y, round(w / sum(w) OVER (), 6) AS p FROM z WHERE w > 0"
)
def predict_presync_transducer(spark, sf):
    m, t = models_of_events(spark, sf)
    return filters.next_output(m, t, mixed_pi_of(m, t), "01", "1")


@query(
    MIXED
    + ", w0 AS (SELECT '0' AS t, '0' AS m, 1.0::DOUBLE AS w), w1 AS (SELECT y, t_to AS t, m_to AS m, sum(w * p) AS w FROM w0 JOIN j ON t = t_from AND m = m_from GROUP BY ALL), w2 AS (SELECT j.y, t_to AS t, m_to AS m, sum(w * p) AS w FROM w1 JOIN j ON t = t_from AND m = m_from GROUP BY ALL), w3 AS (SELECT j.y, t_to AS t, m_to AS m, sum(w * p) AS w FROM w2 JOIN j ON t = t_from AND m = m_from GROUP BY ALL) "
    "SELECT step::INT AS step, y, round(sum(w), 6) AS p FROM (SELECT 1 AS step, y, w FROM w1 UNION ALL SELECT 2, y, w FROM w2 UNION ALL SELECT 3, y, w FROM w3) GROUP BY 1, 2"
)
def lstep_forecast(spark, sf):
    start = spark.createDataFrame([("0", "0", 1.0)], "t string, m string, w double")
    return algebra.forecast(*models_of_events(spark, sf), start, 3)


# -- filters and scores


def markov_model(ays: list[str]) -> filters.SuffixModel:
    """The model whose state is the last output, whatever the inputs."""
    states = {(x, y): i for i, y in enumerate(ays) for x in "01"}
    return filters.SuffixModel(states, {(s, x, y): i for s in range(len(ays)) for x in "01" for i, y in enumerate(ays)}, 2)


def markov_emission(spark: SparkSession, sf: str) -> DataFrame:
    return transducer(spark, sf).select(F.col("s_from").cast("long").alias("state"), "x", "y", "p")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    symbols = binary_events(spark, sf)
    return filters.predict(filters.filter_states(symbols, markov_model(["0", "1"])), symbols, markov_emission(spark, sf), ["0", "1"])


FILTERED = f"{MT}, fl AS (SELECT series_id, t, x, y, (lag(y) OVER (PARTITION BY series_id ORDER BY t))::BIGINT AS state FROM b), em AS (SELECT s_from::BIGINT AS state, x, sum(p) FILTER (y = '0') AS p0, sum(p) FILTER (y = '1') AS p1 FROM tr GROUP BY 1, 2), pr AS (SELECT series_id, t, fl.y, fl.state, coalesce(p1, 0.5) AS p, CASE WHEN p0 >= p1 THEN '0' WHEN p1 > p0 THEN '1' END AS y_pred FROM fl LEFT JOIN em ON em.state = fl.state AND em.x = fl.x)"


@query(FILTERED + " SELECT series_id, t, state FROM fl")
def filter_suffix(spark, sf):
    return filters.filter_states(binary_events(spark, sf), markov_model(["0", "1"]), chunk=32)


@query(FILTERED + " SELECT series_id, t, y, state, round(p, 6) AS p, y_pred FROM pr")
def filter_predict(spark, sf):
    return predictions(spark, sf)


@query(FILTERED + " SELECT fl.series_id, fl.t, round(coalesce(p0, 0.5), 6) AS p_0, round(coalesce(p1, 0.5), 6) AS p_1 FROM fl LEFT JOIN em ON em.state = fl.state AND em.x = fl.x")
def filter_prior(spark, sf):
    symbols = binary_events(spark, sf)
    return filters.lagged_prior(filters.filter_states(symbols, markov_model(["0", "1"])), symbols, markov_emission(spark, sf), ["0", "1"])


SCORES = "count(*) FILTER (y = '1' AND y_pred = '1') AS b, count(*) FILTER (y_pred = '1') AS s, count(*) FILTER (y = '1') AS r, avg(coalesce(y = y_pred, false)::INT) AS accuracy, avg(abs((y = '1')::INT - p)) AS tv, avg(-ln(greatest(CASE WHEN y = '1' THEN p ELSE 1 - p END, 1e-12))) AS logloss"


@query(
    FILTERED
    + f", sc AS (SELECT series_id, {SCORES} FROM pr WHERE t >= 2 GROUP BY 1), d AS (SELECT *, CASE WHEN s = 0 THEN 1.0 ELSE b / s END::DOUBLE AS precision, CASE WHEN r = 0 THEN 1.0 ELSE b / r END::DOUBLE AS recall FROM sc) "
    'SELECT series_id, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS "F", round(tv, 6) AS tv, round(logloss, 6) AS logloss FROM d'
)
def metrics_by_series(spark, sf):
    return metrics.evaluate(predictions(spark, sf), list(metrics.METRICS), skip=2)


CONFUSION = FILTERED + ", cf AS (SELECT k / 100 AS threshold, count(*) FILTER (p + 1e-11 >= k / 100 AND y = '1') AS tp, count(*) FILTER (p + 1e-11 >= k / 100 AND y <> '1') AS fp, count(*) FILTER (p + 1e-11 < k / 100 AND y = '1') AS fn, count(*) FILTER (p + 1e-11 < k / 100 AND y <> '1') AS tn FROM pr, range(101) r(k) GROUP BY k)"


@query(CONFUSION + " SELECT round(threshold, 6) AS threshold, tp, fp, fn, tn FROM cf")
def confusion_thresholds(spark, sf):
    return metrics.confusion(predictions(spark, sf))


@query(CONFUSION + ", q AS (SELECT threshold, tp / (tp + fn) AS tpr, fp / (fp + tn) AS fpr FROM cf UNION ALL SELECT 2, 0, 0), z AS (SELECT *, lag(tpr) OVER w AS t0, lag(fpr) OVER w AS f0 FROM q WINDOW w AS (ORDER BY threshold DESC)) SELECT round(sum((fpr - f0) * (tpr + t0) / 2), 6) AS auc FROM z")
def auc(spark, sf):
    return metrics.area_under_curve(metrics.confusion(predictions(spark, sf)))


PROPS = FILTERED + ", ce AS (SELECT state, x, y, count(*) AS n FROM fl WHERE state IS NOT NULL GROUP BY ALL), cb AS (SELECT state, n, -n * log2(n / sum(n) OVER (PARTITION BY state, x)) AS bits FROM ce), pp AS (SELECT state, sum(n)::BIGINT AS visits, sum(n) / sum(sum(n)) OVER () AS share, sum(bits) / sum(n) AS output_entropy FROM cb GROUP BY 1)"


@query(PROPS + " SELECT state, visits, round(share, 6) AS share, round(output_entropy, 6) AS output_entropy FROM pp")
def state_props(spark, sf):
    symbols = binary_events(spark, sf)
    return counts.state_props(filters.filter_states(symbols, markov_model(["0", "1"])), symbols)


@query(PROPS + " SELECT round(-sum(share * log2(share)), 6) AS c_y, round(sum(share * output_entropy), 6) AS h_y FROM pp")
def empirical_complexity(spark, sf):
    symbols = binary_events(spark, sf)
    return counts.complexity(counts.state_props(filters.filter_states(symbols, markov_model(["0", "1"])), symbols))


@query(PROPS + " SELECT * FROM ce")
def morphs_reestimated(spark, sf):
    symbols = binary_events(spark, sf)
    return counts.morphs_from_filtered(filters.filter_states(symbols, markov_model(["0", "1"])), symbols)


@query(PROPS + " SELECT state, x, y, 1::BIGINT AS n FROM ce")
def topological_morph(spark, sf):
    symbols = binary_events(spark, sf)
    return counts.topological(counts.morphs_from_filtered(filters.filter_states(symbols, markov_model(["0", "1"])), symbols))


# After one pair the last output and the last input are known, and with them both states: before, the stationary mixture tells.
BELIEFS = (
    MIXED_PI
    + """, e AS (SELECT s_from AS s, x, sum(p) FILTER (y = '0') AS p0, sum(p) FILTER (y = '1') AS p1 FROM tr GROUP BY 1, 2),
f AS (SELECT m.x, sum(pi * m.p * e.p0) / sum(pi * m.p) AS p0, sum(pi * m.p * e.p1) / sum(pi * m.p) AS p1 FROM st JOIN m ON m.s_from = right(state, 1) JOIN e ON e.s = left(state, 1) AND e.x = m.x GROUP BY 1),
q AS (SELECT b.series_id, b.t, b.y, coalesce(CASE WHEN b.t = 0 THEN f.p0 ELSE e.p0 END, 0) AS p0, coalesce(CASE WHEN b.t = 0 THEN f.p1 ELSE e.p1 END, 0) AS p1
 FROM (SELECT *, lag(y) OVER (PARTITION BY series_id ORDER BY t) AS was FROM b) b JOIN f ON f.x = b.x LEFT JOIN e ON e.s = b.was AND e.x = b.x)
SELECT series_id, t, round(p0, 6) AS p_0, round(p1, 6) AS p_1, round(CASE y WHEN '0' THEN p0 ELSE p1 END, 6) AS p_seen, y AS states, false AS forbidden FROM q"""
)


def beliefs(spark: SparkSession, sf: str, mode: str = "restart", chunk: int = filters.CHUNK) -> DataFrame:
    m, t = models_of_events(spark, sf)
    found = filters.belief_filter(binary_events(spark, sf), m, t, mixed_pi_of(m, t), ["0", "1"], mode, chunk)
    return found.withColumn("states", F.array_join("states", ","))


@query(BELIEFS)
def filter_beliefs(spark, sf):
    return beliefs(spark, sf)


@query(BELIEFS)
def filter_beliefs_chunked(spark, sf):
    """Chunks of 16 symbols, met in the beliefs that the chunks before lead to."""
    return beliefs(spark, sf, chunk=16)


@query(BELIEFS)
def filter_beliefs_unsettled(spark, sf):
    return beliefs(spark, sf, "never", 32)


@query(BELIEFS)
def filter_beliefs_strict(spark, sf):
    return beliefs(spark, sf, "strict")


# Symbols whose last two outputs are the transducer's state and whose last input is the machine's: two steps settle it.
# Rare edges are taken out of the models, so that pairs which they forbid do occur.
FLAGGED = """sym AS (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, substr(event_type, 1, 1) AS x, CASE WHEN value >= 30 THEN '1' ELSE '0' END AS y FROM events)"""
SLOW = f"""WITH RECURSIVE {FLAGGED}, wd AS (SELECT lag(y, 2) OVER v || lag(y) OVER v AS s_from, lag(x) OVER v AS m_from, x, y, lag(y) OVER v || y AS s_to FROM sym WINDOW v AS (PARTITION BY series_id ORDER BY t)),
tw AS (SELECT s_from, x, y, s_to, count(*) / sum(count(*)) OVER (PARTITION BY s_from, x) AS p FROM wd WHERE s_from IS NOT NULL GROUP BY s_from, x, y, s_to),
mw AS (SELECT m_from AS s_from, x, x AS s_to, count(*) / sum(count(*)) OVER (PARTITION BY m_from) AS p FROM wd WHERE m_from IS NOT NULL GROUP BY m_from, x)"""
MIXED_START = ", mm AS (SELECT tw.s_from || '|' || mw.s_from AS s_from, tw.s_to || '|' || mw.s_to AS s_to, sum(tw.p * mw.p) AS p FROM tw JOIN mw USING (x) GROUP BY 1, 2)" + LIMIT.format(e="mm") + ", pi0 AS (SELECT split_part(state, '|', 1) AS t, split_part(state, '|', 2) AS m, pi FROM st)"
#: A step for every symbol of a series: the weights of all pairs of states as one list, a column of the label's matrix for each goal.
BELIEF_RUN = """, pr AS (SELECT t, m, pi, row_number() OVER (ORDER BY t, m) AS k FROM pi0),
mv AS (SELECT a.k, b.k AS j, te.x, te.y, sum(te.p * me.p) AS p FROM te JOIN me USING (x) JOIN pr a ON a.t = te.s_from AND a.m = me.s_from JOIN pr b ON b.t = te.s_to AND b.m = me.s_to GROUP BY ALL),
ab AS (SELECT DISTINCT x, y FROM sym),
ce AS (SELECT ab.x, ab.y, b.k AS j, list(coalesce(mv.p, 0::DOUBLE) ORDER BY a.k) AS col FROM ab CROSS JOIN pr a CROSS JOIN pr b LEFT JOIN mv ON mv.x = ab.x AND mv.y = ab.y AND mv.k = a.k AND mv.j = b.k GROUP BY 1, 2, 3),
mt AS (SELECT x, y, list(col ORDER BY j) AS cols FROM ce GROUP BY 1, 2),
me1 AS (SELECT s_from, x, sum(p) AS q FROM me GROUP BY 1, 2), te1 AS (SELECT s_from, x, coalesce(sum(p) FILTER (y = '0'), 0) AS a0, coalesce(sum(p) FILTER (y = '1'), 0) AS a1 FROM te GROUP BY 1, 2),
fo AS (SELECT ax.x, list(coalesce(q, 0) ORDER BY k) AS tot, list(coalesce(q * a0, 0) ORDER BY k) AS f0, list(coalesce(q * a1, 0) ORDER BY k) AS f1 FROM (SELECT DISTINCT x FROM sym) ax CROSS JOIN pr LEFT JOIN me1 ON me1.s_from = m AND me1.x = ax.x LEFT JOIN te1 ON te1.s_from = t AND te1.x = ax.x GROUP BY 1),
z AS (SELECT list(t ORDER BY k) AS names, list(pi ORDER BY k) AS start FROM pr),
nx AS (SELECT s_from, x, y, min(s_to) AS s_to FROM te GROUP BY 1, 2, 3),
r AS (SELECT series_id, (-1)::BIGINT AS t, start AS b, NULL::VARCHAR AS s, ''::VARCHAR AS y, NULL::DOUBLE AS p_0, NULL::DOUBLE AS p_1, NULL::VARCHAR[] AS seen, false AS forbidden FROM (SELECT DISTINCT series_id FROM sym), z
 UNION ALL
 SELECT series_id, t, b, s, y, p_0, p_1, CASE WHEN s IS NOT NULL THEN [s] ELSE possible END AS seen, forbidden FROM (
  SELECT *, CASE WHEN forbidden THEN NULL WHEN was IS NOT NULL THEN onward WHEN {settles} AND len(possible) = 1 THEN possible[1] END AS s FROM (
   SELECT *, list_sort(list_distinct(list_filter(list_transform(names, lambda n, i: CASE WHEN b[i] > 0 THEN n END), lambda n: n IS NOT NULL))) AS possible FROM (
    SELECT *, CASE WHEN forbidden THEN start WHEN was IS NULL THEN list_transform(moved, lambda v: v / list_sum(moved)) ELSE prior END AS b FROM (
     SELECT *, CASE WHEN was IS NULL THEN list_sum(moved) <= 0 ELSE onward IS NULL END AS forbidden FROM (
      SELECT sym.series_id, sym.t, sym.y, r.b AS prior, r.s AS was, nx.s_to AS onward, names, start, list_transform(cols, lambda c: list_dot_product(r.b, c)) AS moved,
             CASE WHEN r.s IS NOT NULL THEN coalesce(te1.a0, 0) WHEN list_dot_product(r.b, tot) > 0 THEN list_dot_product(r.b, f0) / list_dot_product(r.b, tot) END AS p_0,
             CASE WHEN r.s IS NOT NULL THEN coalesce(te1.a1, 0) WHEN list_dot_product(r.b, tot) > 0 THEN list_dot_product(r.b, f1) / list_dot_product(r.b, tot) END AS p_1
      FROM r JOIN sym ON sym.series_id = r.series_id AND sym.t = r.t + 1 JOIN mt ON mt.x = sym.x AND mt.y = sym.y JOIN fo ON fo.x = sym.x LEFT JOIN nx ON nx.s_from = r.s AND nx.x = sym.x AND nx.y = sym.y LEFT JOIN te1 ON te1.s_from = r.s AND te1.x = sym.x, z))))))
SELECT series_id, t, round(p_0, 6) AS p_0, round(p_1, 6) AS p_1, round(CASE y WHEN '0' THEN p_0 ELSE p_1 END, 6) AS p_seen, array_to_string(seen, ',') AS states, forbidden FROM r WHERE t >= 0"""
PRUNED = ", te AS (SELECT * FROM tw WHERE p >= 0.42), me AS (SELECT * FROM mw WHERE p >= 0.19)"
WHOLE = ", te AS (SELECT * FROM tw), me AS (SELECT * FROM mw)"


def flagged_events(spark: SparkSession, sf: str) -> DataFrame:
    """symbols of users: x is the event's first letter, y tells values of 30 and more."""
    table = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "ts", "event_id", "event_type", "value")
    return encode.encode(table, "user_id", ["ts", "event_id"], F.when(F.col("value") >= 30, "1").otherwise("0"), F.substring("event_type", 1, 1), bucket=F.to_date("ts"))


def slow_beliefs(spark: SparkSession, sf: str, mode: str, chunk: int, pruned: bool = True) -> DataFrame:
    symbols = flagged_events(spark, sf)
    m = pinned(machine_of(counts.word_counts(symbols, 1)))
    t = pinned(algebra.transducer_from_counts(counts.word_counts(symbols, 2), 2))
    return told_beliefs(symbols, m, t, mode, chunk, 0.42 if pruned else 0.0, 0.19 if pruned else 0.0)


def told_beliefs(symbols: DataFrame, m: DataFrame, t: DataFrame, mode: str, chunk: int, least_t: float = 0.0, least_m: float = 0.0) -> DataFrame:
    found = filters.belief_filter(symbols, m.where(F.col("p") >= least_m), t.where(F.col("p") >= least_t), mixed_pi_of(m, t), ["0", "1"], mode, chunk)
    known = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("p_0", "p_1", "p_seen")]
    return found.select("series_id", "t", *known, F.array_join("states", ",").alias("states"), "forbidden")


@query(SLOW + MIXED_START + PRUNED + BELIEF_RUN.replace("{settles}", "true"))
def filter_beliefs_pruned(spark, sf):
    """Settles in two steps, and begins anew at the pairs that the models forbid; chunks of 16 symbols."""
    return slow_beliefs(spark, sf, "restart", 16)


@query(SLOW + MIXED_START + PRUNED + BELIEF_RUN.replace("{settles}", "false"))
def filter_beliefs_pruned_unsettled(spark, sf):
    """Never settles: an input that the machine forbids counts too."""
    return slow_beliefs(spark, sf, "never", 16)


@query(SLOW + MIXED_START + WHOLE + BELIEF_RUN.replace("{settles}", "true"))
def filter_beliefs_two_steps(spark, sf):
    """Raises at an impossible pair, of which whole models have none."""
    return slow_beliefs(spark, sf, "strict", 16, pruned=False)


HIDDEN = """WITH RECURSIVE ev AS (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, CASE WHEN hour(ts) >= 12 THEN '1' ELSE '0' END AS x, CASE WHEN value >= 30 THEN '1' ELSE '0' END AS y, substr(event_type, 1, 1) AS kind FROM events),
sym AS (SELECT series_id, t, x, y FROM ev), wd AS (SELECT lag(kind) OVER v AS s_from, kind AS s_to, lag(x) OVER v AS m_from, x, y FROM ev WINDOW v AS (PARTITION BY series_id ORDER BY t)),
tw AS (SELECT s_from, x, y, s_to, count(*) / sum(count(*)) OVER (PARTITION BY s_from, x) AS p FROM wd WHERE s_from IS NOT NULL GROUP BY s_from, x, y, s_to),
mw AS (SELECT m_from AS s_from, x, x AS s_to, count(*) / sum(count(*)) OVER (PARTITION BY m_from) AS p FROM wd WHERE m_from IS NOT NULL GROUP BY m_from, x)"""


@query(HIDDEN + MIXED_START + WHOLE + BELIEF_RUN.replace("{settles}", "false"))
def filter_beliefs_hidden(spark, sf):
    """A hidden Markov source: the kind of the event is the state, not seen; a label leads to all five kinds."""
    table = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "ts", "event_id", "event_type", "value")
    both = F.concat(F.when(F.hour("ts") >= 12, "1").otherwise("0"), F.substring("event_type", 1, 1))
    told = encode.encode(table, "user_id", ["ts", "event_id"], F.when(F.col("value") >= 30, "1").otherwise("0"), both, bucket=F.to_date("ts"))
    named = told.select("series_id", "t", F.substring("x", 1, 1).alias("x"), "y", F.substring("x", 2, 1).alias("kind"))
    symbols = named.drop("kind")
    before = F.lag("kind").over(Window.partitionBy("series_id").orderBy("t"))
    moves = named.select(before.alias("s_from"), "x", "y", F.col("kind").alias("s_to")).where("s_from is not null").groupBy("s_from", "x", "y", "s_to").agg(F.count("*").alias("n"))
    t = moves.select("s_from", "x", "y", "s_to", (F.col("n") / F.sum("n").over(Window.partitionBy("s_from", "x"))).alias("p"))
    m = machine_of(counts.word_counts(symbols, 1))
    return told_beliefs(symbols, pinned(m), pinned(t), "restart", 16)


# -- inference


def talk_words(spark: SparkSession, sf: str, length: int = 2) -> DataFrame:
    return counts.word_counts(conversations(spark, sf), length).withColumn("model_id", F.lit("talks"))


DELAYED = f"{S}, d AS (SELECT series_id, t, x, coalesce(lag(x) OVER (PARTITION BY series_id ORDER BY t), '0') AS y FROM s)"


def delayed_words(spark: SparkSession, sf: str, length: int = 2) -> DataFrame:
    return counts.word_counts(simulate.delay(inputs(spark, sf)), length).withColumn("model_id", F.lit("delay"))


def last_input(histories: DataFrame) -> DataFrame:
    """States named by the last inputs of their histories; a state with two of them gets both."""
    names = histories.groupBy("state").agg(F.array_join(F.array_sort(F.collect_set(F.expr("right(xs, 1)"))), "").alias("name"))
    return histories.join(F.broadcast(names), "state")


@query(f"WITH {DELAYED}, {words_sql(2, 'd')} SELECT DISTINCT left(xs, k - 1) AS xs, left(ys, k - 1) AS ys, right(left(xs, k - 1), 1) AS state FROM g WHERE k IN (2, 3)")
def causal_states_delay(spark, sf):
    """The states of a channel that answers the input before are its last inputs."""
    found = infer.infer(delayed_words(spark, sf), ["0", "1"], ["0", "1"], 2)
    return last_input(found).select("xs", "ys", F.col("name").alias("state"))


@query(f"WITH {DELAYED}, {words_sql(2, 'd')} SELECT * FROM (SELECT DISTINCT left(xs, k - 1) AS xs, left(ys, k - 1) AS ys, right(left(xs, k - 1), 1) AS state FROM g WHERE k IN (2, 3)) WHERE state <> '0'")
def state_removed(spark, sf):
    """The channel's histories without those of one state."""
    found = pinned(last_input(infer.infer(delayed_words(spark, sf), ["0", "1"], ["0", "1"], 2)))
    gone = found.where("name = '0'").agg(F.min("state")).first()[0]
    return graph.remove_state(found, gone).select("xs", "ys", F.col("name").alias("state"))


@query(f"WITH {DELAYED} SELECT a.x AS s_from, b.x, a.x AS y, b.x AS s_to, 1.0::DOUBLE AS p FROM (SELECT DISTINCT x FROM d) a, (SELECT DISTINCT x FROM d) b")
def causal_state_edges_delay(spark, sf):
    model = infer.fitted(simulate.delay(inputs(spark, sf)), ["0", "1"], ["0", "1"], 2)
    names = last_input(model.histories).select("state", "name").distinct()
    one, two = (names.select(F.col("state").alias(c), F.col("name").alias(f"{c}_name")) for c in ("s_from", "s_to"))
    return model.edges.join(one, "s_from").join(two, "s_to").select(F.col("s_from_name").alias("s_from"), "x", "y", F.col("s_to_name").alias("s_to"), "p")


@query(f"WITH {DELAYED}, q AS (SELECT x, y, lag(x) OVER (PARTITION BY series_id ORDER BY t) AS state, t FROM d) SELECT state, x, y, count(*) AS n FROM q WHERE t >= 1 GROUP BY ALL")
def morphs_refitted_delay(spark, sf):
    """Outputs counted by the states that filtering assigns, from the second symbol on."""
    model = infer.fitted(simulate.delay(inputs(spark, sf)), ["0", "1"], ["0", "1"], 2, reestimate=True)
    names = last_input(model.histories).select("state", "name").distinct()
    return model.morph.join(names, "state").select(F.col("name").alias("state"), "x", "y", "n")


@query(f"WITH {DELAYED} SELECT a.x AS s_from, b.x, c.x AS y, b.x AS s_to FROM (SELECT DISTINCT x FROM d) a, (SELECT DISTINCT x FROM d) b, (SELECT DISTINCT x FROM d) c")
def memoryless_transitions(spark, sf):
    """With past outputs masked every output leads to the state of the input."""
    words = counts.output_memoryless_counts(simulate.delay(inputs(spark, sf)), 2).withColumn("model_id", F.lit("delay"))
    found = pinned(infer.infer(words, ["0", "1"], ["0", "1"], 2, current_input=False, output_memoryless=True))
    emissions = spark.createDataFrame([(x, y) for x in "01" for y in "01"], "x string, y string")
    moves = graph.history_transitions(found, emissions, 2, memoryless=True)
    names = last_input(found).select("state", "name").distinct()
    one, two = (names.select(F.col("state").alias(c), F.col("name").alias(f"{c}_name")) for c in ("s_from", "s_to"))
    return moves.join(one, "s_from").join(two, "s_to").select(F.col("s_from_name").alias("s_from"), "x", "y", F.col("s_to_name").alias("s_to"))


def kept_files(spark: SparkSession, write: Callable[[str], None], read: Callable[[str], DataFrame]) -> DataFrame:
    """What ``read`` makes of files that ``write`` writes to a folder of their own, which goes again: a model's table, held."""
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    write(path)
    try:
        return pinned(read(path))
    finally:
        removed(spark, path)


CYCLE = "(VALUES ('10', '0', '00'), ('00', '1', '01'), ('01', '1', '11'), ('11', '0', '10'))"


@query(f"SELECT s_from, y, s_to, 1.0::DOUBLE AS p FROM {CYCLE} v(s_from, y, s_to)")
def model_round_trip(spark, sf):
    """A fitted model written and read again; states go by their last two symbols."""
    fitted = infer.fitted(simulate.period4(spark, 4000), ["0"], ["0", "1"], 3)

    def read(path: str) -> DataFrame:
        model = infer.Model.load(spark, path)
        names = model.histories.groupBy("state").agg(F.min(F.expr("right(ys, 2)")).alias("name"))
        one, two = (names.select(F.col("state").alias(c), F.col("name").alias(f"{c}_name")) for c in ("s_from", "s_to"))
        return model.edges.join(one, "s_from").join(two, "s_to").select(F.col("s_from_name").alias("s_from"), "y", F.col("s_to_name").alias("s_to"), "p")

    return kept_files(spark, fitted.save, read)


def state_names(histories: DataFrame) -> DataFrame:
    return last_input(histories).select("state", "name").distinct()


@query(f"WITH {DELAYED} SELECT a.x AS s_from, b.x, a.x AS y, b.x AS s_to, 1.0::DOUBLE AS p FROM (SELECT DISTINCT x FROM d) a, (SELECT DISTINCT x FROM d) b")
def model_files_round_trip(spark, sf):
    """Graph text and state listing of a fitted channel, written by executors and read again; states go by the last inputs that the listing has."""
    model = infer.fitted(simulate.delay(inputs(spark, sf)), ["0", "1"], ["0", "1"], 2)

    def write(path: str) -> None:
        model_files.write_graphs(model.edges.where("p > 0"), f"{path}/graph")
        model_files.write_listings(model.histories, infer.emission(model.morph), model.transitions, f"{path}/states", ["0", "1"], ["0", "1"])

    def read(path: str) -> DataFrame:
        histories, _, _ = model_files.read_listings(spark, f"{path}/states/*/*")
        names = state_names(histories).select(model_files.state_name(F.col("state")).alias("state"), "name")
        edges = models.read_transducer(spark, f"{path}/graph/*/*")
        one, two = (names.select(F.col("state").alias(c), F.col("name").alias(f"{c}_name")) for c in ("s_from", "s_to"))
        return edges.join(one, "s_from").join(two, "s_to").select(F.col("s_from_name").alias("s_from"), "x", "y", F.col("s_to_name").alias("s_to"), "p")

    return kept_files(spark, write, read)


@query(f"WITH {DELAYED} SELECT a.x AS state, b.x AS y, (a.x = b.x)::INT::DOUBLE AS p, c.x, c.x AS s_to FROM (SELECT DISTINCT x FROM d) a, (SELECT DISTINCT x FROM d) b, (SELECT DISTINCT x FROM d) c")
def memoryless_listing(spark, sf):
    """The listing of a channel fitted without past outputs, written and read again."""
    words = counts.output_memoryless_counts(simulate.delay(inputs(spark, sf)), 2).withColumn("model_id", F.lit("delay"))
    found = pinned(infer.infer(words, ["0", "1"], ["0", "1"], 2, current_input=False, output_memoryless=True))
    emissions = spark.createDataFrame([(x, y) for x in "01" for y in "01"], "x string, y string")
    moves = graph.history_transitions(found, emissions, 2, memoryless=True)
    nexts = words.select("model_id", F.col("xs"), F.expr("left(ys, length(ys) - 1)").alias("ys"), F.expr("right(ys, 1)").alias("y"), "n")
    seen = found.join(nexts, ["model_id", "xs", "ys"]).groupBy("model_id", "state", "y").agg(F.sum("n").alias("n"))
    shares = seen.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("model_id", "state")))

    def read(path: str) -> DataFrame:
        histories, told, steps = model_files.read_listings(spark, f"{path}/*/*")
        names = state_names(histories)
        goals = names.select(F.col("state").alias("s_to"), F.col("name").alias("goal"))
        onward = steps.join(goals, "s_to").select(F.col("s_from").alias("state"), "x", "goal")
        return told.drop("x").join(onward, "state").join(names, "state").select(F.col("name").alias("state"), "y", "p", "x", F.col("goal").alias("s_to"))

    return kept_files(spark, lambda path: model_files.write_listings(found, shares, moves, path, ["0", "1"], ["0", "1"], memoryless=True), read)


@query(f"WITH {S}, {words_sql(2)} SELECT * FROM g")
def series_files(spark, sf):
    """Words of all series after both sides were written as lines of text and paired again."""

    def read(path: str) -> DataFrame:
        x, y = (models.read_series(spark, f"{path}/{role}/*/*", every_line=True) for role in ("X", "Y"))
        return counts.word_counts(encode.explode_strings(models.pair_series(x, y)), 2)

    return kept_files(spark, lambda path: model_files.write_pairs(events(spark, sf), path), read)


@query(f"WITH {TALKS}, c AS (SELECT series_id, string_agg(y, '' ORDER BY t) AS text FROM s GROUP BY 1) SELECT arg_min(text, series_id) AS text FROM c GROUP BY left(text, 1)")
def first_lines(spark, sf):
    """Conversations as lines of text, a file for each role that begins them; the first line of each file is its series."""
    wide = encode.to_strings(conversations(spark, sf))
    lines = wide.select(F.left("Y", F.lit(1)).alias("model_id"), F.array(F.lpad(F.col("series_id").cast("string"), 20, "0")).alias("at"), F.col("Y").alias("text"))
    return kept_files(spark, lambda path: model_files.write_lines(lines, path), lambda path: models.read_series(spark, f"{path}/*/*").select("text"))


@query(f"WITH {LETTERS}, n AS (SELECT s AS letter, chr((64 + row_number() OVER (ORDER BY s))::INT) AS name FROM (SELECT s_from AS s FROM l UNION SELECT s_to FROM l)) SELECT a.name AS s_from, x, b.name AS s_to, round(p, 6) AS p FROM l JOIN n a ON a.letter = s_from JOIN n b ON b.letter = s_to")
def machine_file(spark, sf):
    """The machine of the letters as graph text with a label a line, and read again."""
    edges = letter_machine(spark, sf)
    letters = edges.select(F.col("s_from").alias("state")).unionByName(edges.select(F.col("s_to").alias("state"))).distinct().withColumn("model_id", F.lit("letters"))
    numbers = model_files.numbered_states(letters).select("state", "n")
    one, two = (numbers.select(F.col("state").alias(c), F.col("n").alias(f"{c}_n")) for c in ("s_from", "s_to"))
    told = edges.join(one, "s_from").join(two, "s_to").select(F.lit("letters").alias("model_id"), F.col("s_from_n").alias("s_from"), F.lit("0").alias("x"), F.col("x").alias("y"), F.col("s_to_n").alias("s_to"), "p")
    read = lambda path: models.read_machine(spark, f"{path}/*/*", "machine").select("s_from", "x", "s_to", "p")
    return kept_files(spark, lambda path: model_files.write_graphs(told, path, "machine", all_digits=True), read)


@query(f"WITH {B}, w AS (SELECT lag(x) OVER v AS xs, lag(y) OVER v AS ys, y FROM b WINDOW v AS (PARTITION BY series_id ORDER BY t)) SELECT xs, ys, round(avg((y = '1')::INT), 6) AS p FROM w WHERE xs IS NOT NULL GROUP BY 1, 2")
def generator_file(spark, sf):
    """The probability of a one after the last pair, as a generator's table, written and read again."""
    pairs = counts.word_counts(binary_events(spark, sf), 1).where("k = 2")
    last = pairs.groupBy(F.expr("left(xs, 1)").alias("xs"), F.expr("left(ys, 1)").alias("ys")).agg((F.sum(F.when(F.expr("right(ys, 1)") == "1", F.col("n")).otherwise(0)) / F.sum("n")).alias("p"))
    rules = last.select(F.lit("events").alias("model_id"), F.concat(F.lit("S"), "xs", "ys").alias("state"), "xs", "ys", "p")
    read = lambda path: model_files.read_generators(spark, f"{path}/*/*").select("xs", "ys", "p")
    return kept_files(spark, lambda path: model_files.write_lines(model_files.generator_table(rules), path), read)


@query()
def causal_states(spark, sf):
    """Histories of the causal states of conversations."""
    words = talk_words(spark, sf)
    return infer.infer(words, ["0"], ["a", "s", "u"], 2)


@query()
def causal_state_edges(spark, sf):
    words = talk_words(spark, sf)
    found = infer.infer(words, ["0"], ["a", "s", "u"], 2)
    emissions = spark.createDataFrame([("0", y) for y in "asu"], "x string, y string")
    return infer.edges(graph.history_transitions(found, emissions, 2), infer.morphs(found, words))


DELAY_STATES = f"WITH {DELAYED}, {words_sql(2, 'd')} SELECT DISTINCT left(xs, k - 1) AS xs, left(ys, k - 1) AS ys, right(left(xs, k - 1), 1) AS state FROM g WHERE k IN (2, 3)"


@query(DELAY_STATES)
def causal_states_transducer(spark, sf):
    """The same by the G test."""
    return last_input(infer.infer(delayed_words(spark, sf), ["0", "1"], ["0", "1"], 2, kind="G")).select("xs", "ys", F.col("name").alias("state"))


@query(DELAY_STATES)
def causal_states_past_only(spark, sf):
    """Without the current input: the older formalism."""
    words = counts.past_only_counts(simulate.delay(inputs(spark, sf)), 2).withColumn("model_id", F.lit("delay"))
    return last_input(infer.infer(words, ["0", "1"], ["0", "1"], 2, current_input=False)).select("xs", "ys", F.col("name").alias("state"))


@query(f"WITH {DELAYED}, {words_sql(2, 'd')} SELECT DISTINCT left(xs, k - 1) AS xs, repeat('n', k - 1) AS ys, right(left(xs, k - 1), 1) AS state FROM g WHERE k IN (2, 3)")
def causal_states_output_memoryless(spark, sf):
    words = counts.output_memoryless_counts(simulate.delay(inputs(spark, sf)), 2).withColumn("model_id", F.lit("delay"))
    return last_input(infer.infer(words, ["0", "1"], ["0", "1"], 2, current_input=False, output_memoryless=True)).select("xs", "ys", F.col("name").alias("state"))


@query(
    f"WITH {LETTERS}{LIMIT.format(e='l')}, h AS (SELECT s_from, -sum(p * log2(p)) AS bits FROM l GROUP BY 1), q AS (SELECT (SELECT -sum(pi * log2(pi)) FROM st) AS c, (SELECT sum(pi * bits) FROM st JOIN h ON state = s_from) AS h) "
    "SELECT 'letters' AS model_id, round(c, 6) AS cmu, round(h, 6) AS hmu, round(h, 6) AS hmu_state_graph, round(c - h, 6) AS excess, round(c, 6) AS h_1, round(h, 6) AS h_2, round(c + h, 6) AS big_h_2 FROM q"
)
def model_measures(spark, sf):
    """Of a machine whose state is its last symbol the measures have closed forms."""
    found = measures.measure_models(letter_machine(spark, sf).withColumn("model_id", F.lit("letters")))
    return found.select("model_id", "cmu", "hmu", "hmu_state_graph", "excess", F.col("h_l")[0].alias("h_1"), F.col("h_l")[1].alias("h_2"), F.col("big_h")[1].alias("big_h_2"))


ORDER2 = f"""WITH {S}, lw AS (SELECT lag(y) OVER w || y AS a, lead(y) OVER w AS x, y || lead(y) OVER w AS b FROM s WINDOW w AS (PARTITION BY series_id ORDER BY t)),
l AS (SELECT a AS s_from, x, b AS s_to, count(*) / sum(count(*)) OVER (PARTITION BY a) AS p FROM lw WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY a, x, b){LIMIT.format(e="l")}"""
KNOWN = """, w AS (SELECT state, pi, p, x, right(state, 1) AS a FROM st JOIN l ON s_from = state),
lv AS (SELECT 0 AS level, '' AS name, x, sum(pi * p) AS p FROM w GROUP BY x UNION ALL SELECT 1, a, x, sum(pi * p) / any_value(q) FROM (SELECT *, (SELECT sum(pi) FROM st WHERE right(state, 1) = w.a) AS q FROM w) GROUP BY a, x UNION ALL SELECT 2, state, x, p FROM w)"""


def two_letters(spark: SparkSession, sf: str) -> DataFrame:
    return pinned(algebra.machine_from_counts(counts.word_counts(encode.constant_input(events(spark, sf)), 2), 2))


@query(ORDER2 + KNOWN + " SELECT level::INT AS level, x, round(p, 6) AS p, least(level + 1, 2)::INT AS goal_level FROM lv")
def mixed_state_steps(spark, sf):
    """Of a machine that remembers two letters: what is known before, after one, and after two of them."""
    found = measures.mixed_state_tables(two_letters(spark, sf))
    level = found.states.select("id", "level")
    goals = level.select(F.col("id").alias("goal"), F.col("level").alias("goal_level"))
    return found.steps.join(level, "id").join(goals, "goal").select("level", "x", "p", "goal_level")


@query(ORDER2 + KNOWN + """, h AS (SELECT level, name, -sum(p * log2(p)) AS bits FROM lv GROUP BY 1, 2), g AS (SELECT 1 AS length, bits AS h FROM h WHERE level = 0
 UNION ALL SELECT 2, sum(bits * (SELECT sum(pi) FROM st WHERE right(state, 1) = name)) FROM h WHERE level = 1 UNION ALL SELECT k, sum(bits * pi) FROM h JOIN st ON state = name AND level = 2, range(3, 7) r(k) GROUP BY k)
SELECT length::INT AS length, round(h, 6) AS h_l, round(sum(h) OVER (ORDER BY length), 6) AS big_h FROM g""")
def mixed_state_curve(spark, sf):
    return measures.closure_curve(measures.mixed_state_tables(two_letters(spark, sf)), 6)


EVEN = [("A", "0", "A", 0.5), ("A", "1", "B", 0.5), ("B", "1", "A", 1.0)]


# With one symbol of memory the cycle 1001 looks like coin tosses, and one state is left; with two or three it has four, and only the start is unsure.
@query(
    "WITH s AS (SELECT t, substr('1001', (t % 4 + 1)::INT, 1)::INT AS y FROM range(4000) r(t)), n AS (SELECT *, lead(y) OVER (ORDER BY t) AS z FROM s), p AS (SELECT (sum(y) + sum(z)) / (2 * count(*)) AS p FROM n WHERE t < 3997), "
    "f AS (SELECT 1 AS length, 1 AS states, (SELECT sum(ln(CASE y WHEN 1 THEN p ELSE 1 - p END)) FROM s, p) AS ll UNION ALL SELECT 2, 4, ln(0.25) UNION ALL SELECT 3, 4, ln(0.25)) "
    "SELECT length, states, round(ll, 6) AS loglik, round(-2 * ll + states * ln(4000), 6) AS score FROM f"
)
def choose_length_period4(spark, sf):
    return selection.choose_length_of(simulate.period4(spark, 4000), ["0", "1"], 3).drop("topology")


@query(
    "WITH s AS (SELECT t, substr('1001', (t % 4 + 1)::INT, 1)::INT AS y FROM range(4000) r(t)), n AS (SELECT *, lead(y) OVER (ORDER BY t) AS z FROM s), p AS (SELECT (sum(y) + sum(z)) / (2 * count(*)) AS p FROM n WHERE t < 1998), "
    "f AS (SELECT 1 AS length, 1 AS states, (SELECT sum(ln(CASE y WHEN 1 THEN p ELSE 1 - p END)) FROM s, p WHERE t >= 2000) AS ll UNION ALL SELECT 2, 4, ln(0.25)) SELECT length, states, round(ll, 6) AS loglik, round(-ll / 2000, 6) AS score FROM f"
)
def choose_length_held_out(spark, sf):
    """The first half of the cycle fits, the mean log loss of the second is the score."""
    return selection.choose_length_of(simulate.period4(spark, 4000), ["0", "1"], 2, held_out=True).drop("topology")


@query("SELECT 2 AS length")
def best_length_period4(spark, sf):
    """Lengths 2 and 3 give one topology: the shorter is chosen."""
    return spark.createDataFrame([(selection.best_length(selection.choose_length_of(simulate.period4(spark, 4000), ["0", "1"], 3)),)], "length int")


@query()
def choose_length_orders_logloss(spark, sf):
    """Held-out log loss: the first half of each customer's orders fits, the second is scored."""
    return selection.choose_length_of(orders(spark, sf), ["F", "O", "P"], 3, held_out=True).drop("topology")


@query()
def choose_length_conversations(spark, sf):
    return selection.choose_length_of(conversations(spark, sf), ["a", "s", "u"], 3)


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each turn of a conversation is odd: a source that leaves nothing to chance but its beginning."""
    table = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn")
    return encode.encode(table, "conv_id", ["turn"], (F.col("turn") % 2).cast("string"))


TWO = "2 AS states, round(c * ln(0.5), 6) AS loglik"
TURNED = "'2;0>1:1|0;1>0:0|0' AS topology"


@query(f"SELECT length::INT AS length, {TWO}, round(-2 * c * ln(0.5) + 2 * ln(n), 6) AS score, {TURNED} FROM (SELECT count(*) AS n, count(DISTINCT conv_id) AS c FROM conversations), range(1, 3) r(length)")
def choose_length_turns(spark, sf):
    """Every length finds the two states; only the first turn of a conversation is unsure."""
    return selection.choose_length_of(turns(spark, sf), ["0", "1"], 2, alpha=0.05)


@query(f"SELECT 1 AS length, {TWO}, round(-c * ln(0.5) / n, 6) AS score, {TURNED} FROM (SELECT sum(k - k // 2) AS n, count(*) AS c FROM (SELECT count(*) AS k FROM conversations GROUP BY conv_id))")
def choose_length_turns_held_out(spark, sf):
    """Fitted on the first half of each conversation, scored on the second."""
    return selection.choose_length_of(turns(spark, sf), ["0", "1"], 1, alpha=0.3, held_out=True)


@query(
    f"WITH {ORDERS}, w AS (SELECT y, lead(y) OVER v AS y1, lead(y, 2) OVER v AS y2 FROM s WINDOW v AS (PARTITION BY series_id ORDER BY t)), f AS (SELECT * FROM w WHERE y2 IS NOT NULL), "
    "c AS (SELECT 1 AS length, y FROM f UNION ALL SELECT 1, y1 FROM f UNION ALL SELECT 2, y1 FROM f UNION ALL SELECT 2, y2 FROM f), p AS (SELECT length, y, count(*) / sum(count(*)) OVER (PARTITION BY length) AS p FROM c GROUP BY 1, 2), "
    "l AS (SELECT length, sum(ln(p)) AS ll, count(*) AS n FROM s JOIN p USING (y) GROUP BY 1) SELECT length, 1 AS states, round(ll, 6) AS loglik, round(-2 * ll + 2 * ln(n), 6) AS score, '1;0>0:F|0;0>0:O|0;0>0:P|0' AS topology FROM l"
)
def choose_length_orders(spark, sf):
    """The status of an order doesn't depend on the ones before: the tests accept, and one state is left at each length."""
    return selection.choose_length_of(orders(spark, sf), ["F", "O", "P"], 2)


def turns_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return selection.bootstrap_of(turns(spark, sf), ["0", "1"], 2, 20, 200, alpha=0.05).replicates


BITS = "(SELECT log2(count(DISTINCT turn % 2)) FROM conversations)"


@query(f"SELECT b AS boot_id, round({BITS}, 6) AS cmu, 0.0::DOUBLE AS hmu, round({BITS}, 6) AS excess, false AS failed FROM range(20) r(b)")
def bootstrap_turns(spark, sf):
    """Length, machine and measures of the turns: what alternates is known by one bit, in every replicate."""
    return turns_bootstrap(spark, sf)


@query(f"SELECT 'excess' AS measure, round({BITS}, 6) AS low, round({BITS}, 6) AS high, 20::BIGINT AS n, 0::BIGINT AS n_failed")
def bootstrap_turns_interval(spark, sf):
    return selection.interval(turns_bootstrap(spark, sf), "excess")


@query(f"SELECT round({BITS}, 6) AS theta, 1.0::DOUBLE AS ecdf, 1.0::DOUBLE AS cc, 0.0::DOUBLE AS p")
def bootstrap_turns_curve(spark, sf):
    return selection.confidence_curve(turns_bootstrap(spark, sf), "cmu")


@query()
def bootstrap_replicates(spark, sf):
    return selection.bootstrap(spark, EVEN, ["0", "1"], 3, 1000, 40)


@query()
def bootstrap_conversations(spark, sf):
    """The length chosen, the machine fitted, and its measures in replicates of 500 symbols."""
    return selection.bootstrap_of(conversations(spark, sf), ["a", "s", "u"], 2, 20, 500).replicates


def cycle_bootstrap(spark: SparkSession) -> selection.Bootstrap:
    return selection.bootstrap_of(simulate.period4(spark, 4000), ["0", "1"], 3, 20, 400)


# A machine that leaves nothing to chance has the same measures in every replicate.
@query("SELECT b AS boot_id, 2.0::DOUBLE AS cmu, 0.0::DOUBLE AS hmu, 2.0::DOUBLE AS excess, false AS failed FROM range(20) r(b)")
def bootstrap_period4(spark, sf):
    return cycle_bootstrap(spark).replicates


@query("SELECT 'cmu' AS measure, 2.0::DOUBLE AS low, 2.0::DOUBLE AS high, 20::BIGINT AS n, 0::BIGINT AS n_failed")
def bootstrap_period4_interval(spark, sf):
    return selection.interval(cycle_bootstrap(spark).replicates, "cmu")


def thetas(spark: SparkSession, sf: str) -> DataFrame:
    """Figures standing for replicates: the values of all orders."""
    return spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("boot_id"), F.col("o_totalprice").cast("double").alias("cmu"))


@query("SELECT 'cmu' AS measure, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, count(v) AS n, count(*) FILTER (v IS NULL) AS n_failed FROM (SELECT o_totalprice::DOUBLE AS v FROM orders)")
def bootstrap_interval(spark, sf):
    return selection.interval(thetas(spark, sf), "cmu")


@query("SELECT round(quantile_cont(v, 0.25), 6) AS theta FROM (SELECT o_totalprice::DOUBLE AS v FROM orders)")
def bootstrap_quantile(spark, sf):
    return selection.quantile(thetas(spark, sf), "cmu", 0.25)


@query("WITH v AS (SELECT o_totalprice::DOUBLE AS v FROM orders), e AS (SELECT v AS theta, max(c) AS ecdf FROM (SELECT v, cume_dist() OVER (ORDER BY v) AS c FROM v) GROUP BY 1) SELECT round(theta, 6) AS theta, round(ecdf, 6) AS ecdf, round(abs(2 * ecdf - 1), 6) AS cc, round(1 - abs(2 * ecdf - 1), 6) AS p FROM e")
def confidence_curve(spark, sf):
    return selection.confidence_curve(thetas(spark, sf), "cmu")


# -- intervals


@query("WITH c AS (SELECT c_custkey, c_acctbal * 50 AS lo, lead(c_acctbal) OVER (ORDER BY c_acctbal, c_custkey) * 50 AS hi FROM customer) SELECT o_orderkey, c_custkey FROM orders JOIN c ON o_totalprice > lo AND o_totalprice <= hi")
def price_intervals(spark, sf):
    """The interval of every order price among the balances of all customers, scaled to the range of prices."""
    balances = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_acctbal")
    ranked = encode.encode(balances, F.lit(0), ["c_acctbal", "c_custkey"], F.col("c_custkey"), F.col("c_acctbal"), bucket=F.floor(F.col("c_acctbal") / 100))
    upper = ranked.select((F.col("t") - 1).alias("t"), (F.col("x") * 50).alias("hi"))
    intervals = ranked.join(upper, "t").select(F.col("y").alias("c_custkey"), (F.col("x") * 50).alias("lo"), "hi")
    prices = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.col("o_totalprice").alias("u"))
    return interval_join(prices, intervals).select("o_orderkey", "c_custkey")


@query(
    f"WITH {S}, cd AS (SELECT x, y, sum(count(*)) OVER (PARTITION BY x ORDER BY y) / sum(count(*)) OVER (PARTITION BY x) AS hi, count(*) / sum(count(*)) OVER (PARTITION BY x) AS p FROM s GROUP BY x, y), "
    "u AS (SELECT series_id, t, x, (('0x' || substr(md5('3:' || series_id || ':' || t), 1, 8))::BIGINT + 1) / 4294967296 AS u FROM s) "
    "SELECT series_id, t, u.x, cd.y FROM u JOIN cd ON cd.x = u.x AND u.u > coalesce((SELECT max(hi) FROM cd c WHERE c.x = u.x AND c.y < cd.y), 0) AND u.u <= cd.hi"
)
def drawn_outputs(spark, sf):
    """An output for every input, drawn by its cumulative distribution: the interval that a number made of the position falls in."""
    symbols = events(spark, sf)
    shares = pinned(symbols.groupBy("x", "y").agg(F.count("*").alias("p")))
    number = (F.conv(F.substring(F.md5(F.concat(F.lit("3:"), F.col("series_id").cast("string"), F.lit(":"), F.col("t").cast("string"))), 1, 8), 16, 10).cast("double") + 1) / 4294967296
    return interval_join(symbols.select("series_id", "t", "x", number.alias("u")), cumulative_intervals(shares, "y", "p", ["x"]), on=["x"]).select("series_id", "t", "x", "y")


# -- processes


def inputs(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("series_id", "t", "x")


@query(f"WITH {S} SELECT series_id, t, x, coalesce(lag(x) OVER (PARTITION BY series_id ORDER BY t), '0') AS y FROM s")
def delay_channel(spark, sf):
    return simulate.delay(inputs(spark, sf))


@query("SELECT 0::BIGINT AS series_id, t, '0' AS x, substr('1001', (t % 4 + 1)::INT, 1) AS y FROM range(4000) r(t)")
def period4_series(spark, sf):
    return simulate.period4(spark, 4000)


@query(f"WITH {S}, k AS (SELECT *, CASE WHEN lag(x) OVER (PARTITION BY series_id ORDER BY t) = '1' THEN t END AS k FROM s), l AS (SELECT *, max(k) OVER (PARTITION BY series_id ORDER BY t) AS q FROM k) SELECT series_id, t, x, CASE WHEN t = 0 THEN '0' WHEN q = t THEN '1' WHEN (CASE WHEN q IS NULL THEN t ELSE t - q - 1 END) % 3 = 0 THEN '0' ELSE '1' END AS y FROM l")
def periodic_kick(spark, sf):
    return simulate.periodic_kick(inputs(spark, sf))


TURNS = "(CASE WHEN y IN ('p', 'v') THEN '1' WHEN y = 's' THEN '2' ELSE '0' END)"


@query(f"WITH {S}, i AS (SELECT series_id, t, {TURNS} AS x FROM s), q AS (SELECT *, lag(x) OVER w AS m, last_value(nullif(x, '0') IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS was FROM i WINDOW w AS (PARTITION BY series_id ORDER BY t)) SELECT series_id, t, x, CASE WHEN m IN ('1', '2') AND m <> coalesce(was, '1') THEN '1' ELSE '0' END AS y FROM q")
def turn_machine(spark, sf):
    x = F.when(F.col("y").isin("p", "v"), "1").when(F.col("y") == "s", "2").otherwise("0")
    return simulate.turn_machine(events(spark, sf).select("series_id", "t", x.alias("x")))


RUN = f"WITH RECURSIVE {S}, r AS (SELECT series_id, t, x, '0' AS y, {{start}} AS st FROM s WHERE t = 0 UNION ALL SELECT series_id, t, x, {{y}} AS y, {{next}} AS st FROM (SELECT s.series_id, s.t, s.x, r.x AS b, r.st FROM r JOIN s ON s.series_id = r.series_id AND s.t = r.t + 1) z) SELECT series_id, t, x, y FROM r"


@query(RUN.format(start="0", y="CASE WHEN st = 1 OR b = '1' THEN '1' ELSE '0' END", next="CASE WHEN st = 1 THEN 0 WHEN b = '1' THEN 1 ELSE 0 END"))
def even_transducer(spark, sf):
    return simulate.even_transducer(inputs(spark, sf))


@query(
    RUN.format(
        start="(x = '1')::INT * 1000 + 1",
        y="CASE WHEN st // 1000 > 0 AND (st // 1000) % 2 = 0 THEN '1' WHEN (st % 1000) % 3 = 0 THEN '0' ELSE '1' END",
        next="(CASE WHEN x = '1' THEN st // 1000 + 1 ELSE 0 END) * 1000 + (CASE WHEN st // 1000 > 0 AND (st // 1000) % 2 = 0 THEN 0 ELSE (st % 1000) + 1 END)",
    )
)
def periodic_even_kick(spark, sf):
    return simulate.periodic_even_kick(inputs(spark, sf))


DRAWN = RUN.replace("r AS (", "u AS (SELECT *, ('0x' || substr(md5('{seed}:' || series_id || ':' || t), 1, 8))::BIGINT / 4294967296 AS u FROM s), r AS (").replace("JOIN s ON s", "JOIN u s ON s").replace("s.x, r.x AS b", "s.x, s.u, r.x AS b")
STAY = "st = 1 OR u <= CASE b WHEN '1' THEN 0.75 ELSE 0.35 END"


@query(DRAWN.format(seed=7, start="0", y=f"CASE WHEN {STAY} THEN '1' ELSE '0' END", next=f"CASE WHEN {STAY} THEN 1 - st ELSE 0 END"))
def even_flip(spark, sf):
    return simulate.even_flip(inputs(spark, sf))


@query(
    DRAWN.format(
        seed=7,
        start="2",
        y="CASE WHEN b = '1' AND st = 2 THEN '1' ELSE '0' END",
        next="CASE WHEN b = '1' THEN 2 ELSE least(2, greatest(0, st + CASE WHEN u < 0.5 THEN -1 ELSE 1 END)) END",
    )
)
def float_reset(spark, sf):
    return simulate.float_reset(inputs(spark, sf))


U0 = f"WITH {S}, u AS (SELECT *, ('0x' || substr(md5('0:' || series_id || ':' || t), 1, 8))::BIGINT / 4294967296 AS u FROM s)"


@query(U0 + " SELECT series_id, t, x, CASE WHEN x = '0' OR u < 0.5 THEN '0' ELSE '1' END AS y FROM u")
def z_channel(spark, sf):
    return simulate.z_channel(inputs(spark, sf))


@query(
    U0
    + """, g AS (SELECT *, count(*) FILTER (x = '0') OVER (PARTITION BY series_id ORDER BY t) AS g FROM u), q AS (SELECT *, count(*) FILTER (x = '1') OVER (PARTITION BY series_id, g ORDER BY t) AS run FROM g)
SELECT series_id, t, x, CASE WHEN run % 2 = 1 THEN CASE WHEN u < 0.5 THEN '0' ELSE '1' END ELSE x END AS y FROM q"""
)
def odd_random(spark, sf):
    return simulate.odd_random(inputs(spark, sf))


LOOKED = "CASE WHEN {u} <= CASE WHEN b = '1' AND st = 0 THEN 0.95 WHEN b = '0' AND st = 0 THEN 0.1 ELSE -1 END THEN {one} ELSE {zero} END"


@query(DRAWN.format(seed=7, start="0", y=LOOKED.format(u="u", one="'1'", zero="'0'"), next=LOOKED.format(u="u", one="1", zero="0")))
def lookup_process(spark, sf):
    return simulate.lookup_process(inputs(spark, sf), {("1", "0"): 0.95, ("0", "1"): 0.0, ("1", "1"): 0.0, ("0", "0"): 0.1})


@query("SELECT s AS series_id, t, '0' AS x, substr('1100', (t % 4 + 1)::INT, 1) AS y FROM range(3) a(s), range(2000) r(t)")
def simulate_cycle(spark, sf):
    """A machine that leaves nothing to chance, from a given state."""
    return simulate.simulate_machine(spark, [("A", "1", "C", 1.0), ("C", "1", "D", 1.0), ("D", "0", "B", 1.0), ("B", "0", "A", 1.0)], 3, 2000, start="A")


@query()
def simulate_machine(spark, sf):
    return simulate.simulate_machine(spark, EVEN, 4, 2000, seed=1)


@query(f"WITH {S} SELECT series_id, t, x, coalesce(lag(x) OVER (PARTITION BY series_id ORDER BY t), '0') AS y FROM s")
def simulate_transducer(spark, sf):
    delay = [("A", "0", "0", "A", 1.0), ("A", "1", "0", "B", 1.0), ("B", "0", "1", "A", 1.0), ("B", "1", "1", "B", 1.0)]
    return simulate.simulate_transducer(inputs(spark, sf), delay, "A")


@query(
    MT + """ SELECT s_from || ' -> ' || s_to || ' [label = "' || string_agg(y || '|' || x || ':' || printf('%.6f', p) || '\\l', '' ORDER BY x, y) || '"];' AS text FROM tr GROUP BY s_from, s_to"""
)
def graph_lines(spark, sf):
    return models.graph_lines(transducer(spark, sf))


@query(MT + " SELECT s_from, x, y, s_to, round(p, 6) AS p FROM tr")
def graph_lines_parsed(spark, sf):
    text = models.graph_lines(transducer(spark, sf)).select(F.lit("memory").alias("path"), F.monotonically_increasing_id().alias("line"), "text")
    return models.labels_of(models.edge_lines(text)).select("s_from", "x", "y", "s_to", "p")


@query()
def lstep_simulated(spark, sf):
    """Shares of outputs 1 to 3 steps ahead over 4,000 simulated runs from one state."""
    drawn = simulate.simulate_machine(spark, EVEN, 4000, 3, start="A")
    return drawn.groupBy((F.col("t") + 1).alias("step"), "y").agg((F.count("*") / 4000).alias("p"))


@query("SELECT 'A' AS s_from, '0' AS x, 'A' AS s_to, 1.0::DOUBLE AS p")
def null_machine(spark, sf):
    return models.null_machine(spark)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P(next event | the last two events) of every user, all lengths up to two."""
    return QUERIES["conditional_probs"](spark, sf_dir)


__all__ = ["ORACLE_SQL", "QUERIES", "flagship", "state_label"]
