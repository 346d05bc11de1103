"""The parts that don't depend on one model: worklists, closures, chunk maps of mixtures, deltas, names, intervals."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from statewright.functions.small import numbered, settled
from statewright.operators import algebra, counts, encode, filters, infer, intervals, measures, selection
from statewright.operators.algebra import stationary_exact
from statewright.operators.graph import NoRecurrentPart


def strings(spark, pairs, first=0):
    return encode.explode_strings(spark.createDataFrame([(first + i, x, y) for i, (x, y) in enumerate(pairs)], "series_id long, X string, Y string"))


def slow_words(pairs, length):
    out = Counter()
    for x, y in pairs:
        for t in range(len(y) - length):
            for k in range(1, length + 2):
                out[k, x[t : t + k], y[t : t + k]] += 1
    return out


def found_words(df):
    return {(r["k"], r["xs"], r["ys"]): r["n"] for r in df.collect()}


# -- determinising


def one_split(c):
    """The first split that looking at states, inputs and outputs in order finds: what was done anew after each."""
    owner = c.owners()
    for state, hs in c.members.items():
        for x in c.axs:
            for y in c.past_outputs or c.ays:
                goals = [owner.get(c.following(h, x, y)) for h in hs]
                known = [g for g in goals if g is not None]
                other = next((g for g in known if g != known[0]), None)
                if other is None:
                    continue
                moving = [h for h, g in zip(hs, goals, strict=True) if g == other]
                fresh = c.open(moving[0], c.morph(moving[0]))
                c.members[fresh] = moving
                for h in moving[1:]:
                    c.add(fresh, c.morph(h))
                for h in moving:
                    c.members[state].remove(h)
                    c.add(state, c.morph(h), -1)
                return True
    return False


def dealt_clustering(seed, length, states, axs=("0", "1"), missing=0.1):
    rng = random.Random(seed)
    words = [""]
    for _ in range(length):
        words = [w + a for w in words for a in axs]
    table = {("0" * (length + 1), w + a): rng.randrange(1, 50) for w in words for a in axs}
    c = infer.Clustering(table, ["0"], list(axs), length)
    for w in words:
        if rng.random() < missing:
            continue
        h, s = ("0" * length, w), rng.randrange(states)
        if s in c.members:
            c.members[s].append(h)
            c.add(s, c.morph(h))
        else:
            c.members[s], c.sums[s] = [h], [list(r) for r in c.morph(h)]
    c.members = dict(sorted(c.members.items()))
    c.made = states
    return c


@pytest.mark.parametrize("seed", range(8))
def test_worklist_equals_beginning_anew(seed):
    got, want = (dealt_clustering(seed, 5, 3 + seed % 3, missing=0.3 * (seed % 2)) for _ in range(2))
    got.determinise()
    while one_split(want):
        pass
    assert got.members == want.members and list(got.members) == list(want.members) and got.sums == want.sums


def test_ten_thousand_histories_are_determinised():
    """Histories whose state is their last four symbols, put into states by the last two: each splits by what it leads to."""
    length, axs = 13, ["0", "1"]
    words = [f"{i:0{length}b}" for i in range(1 << length)] + [f"{i:0{length - 1}b}" for i in range(1 << (length - 1))]
    table = {("0" * (len(w) + 1), w + a): 1 for w in words for a in axs}
    c = infer.Clustering(table, ["0"], axs, length)
    for w in words:
        h, s = ("0" * len(w), w), int(w[-4:-3] + w[-1:], 2)
        if s not in c.members:
            c.members[s], c.sums[s] = [], [[0, 0]]
        c.members[s].append(h)
        c.add(s, c.morph(h))
    c.members, c.made = dict(sorted(c.members.items())), 4
    assert len(words) > 10_000
    c.determinise()
    owner = c.owners()
    for hs in c.members.values():
        for y in axs:
            assert len({owner[c.following(h, "0", y)] for h in hs}) == 1
    assert len(c.members) == 16


# -- beliefs that a label doesn't lead one way


def hidden_models(rng, t_states, m_states, dead, unifilar_t=False):
    t, m = {}, {}
    for s in range(t_states):
        for x in "01":
            for y in "01":
                goals = sorted(rng.choice(t_states, 1 if unifilar_t else rng.integers(1, t_states + 1), replace=False).tolist())
                if rng.random() > dead:
                    t[f"t{s}", x, y] = [(f"t{g}", float(p)) for g, p in zip(goals, rng.dirichlet(np.ones(len(goals))) / 2, strict=True)]
    for s in range(m_states):
        for x in "01":
            goals = sorted(rng.choice(m_states, rng.integers(1, m_states + 1), replace=False).tolist())
            if rng.random() > dead:
                m[f"m{s}", x] = [(f"m{g}", float(p)) for g, p in zip(goals, rng.dirichlet(np.ones(len(goals))) / 2, strict=True)]
    return t, m


@pytest.mark.parametrize("mode", ["restart", "never"])
@pytest.mark.parametrize("unifilar_t", [False, True])
def test_a_chunk_of_a_mixture_equals_going_through_it(mode, unifilar_t):
    rng = np.random.default_rng(7)
    several = 0
    for _ in range(150):
        t, m = hidden_models(rng, int(rng.integers(1, 4)), int(rng.integers(1, 3)), rng.choice([0.0, 0.2, 0.5]), unifilar_t)
        states = [(a, b) for a in {k[0] for k in t} | {g for v in t.values() for g, _ in v} for b in {k[0] for k in m} | {g for v in m.values() for g, _ in v}]
        if not states:
            continue
        pi = dict(zip(states, rng.dirichlet(np.ones(len(states))), strict=True))
        make = lambda: filters.Belief(t, m, pi, ["0", "1"], mode)
        several += not make().unifilar
        straight, jumping = make(), make()
        for _ in range(5):
            chunk = [(str(rng.integers(2)), str(rng.integers(2))) for _ in range(int(rng.integers(1, 7)))]
            for x, y in chunk:
                straight.update(x, y)
            jumping.follow(make().map_of(chunk))
            assert jumping.synced == straight.synced
            if straight.synced is None:
                assert jumping.weights.keys() == straight.weights.keys()
                assert all(jumping.weights[k] == pytest.approx(w) for k, w in straight.weights.items())
    assert several > 50


def test_edges_of_one_label_add_up(spark):
    edges_t = spark.createDataFrame([("A", "0", "0", "A", 0.5), ("A", "0", "0", "B", 0.25), ("A", "0", "0", "B", 0.05), ("A", "0", "1", "A", 0.2), ("B", "0", "1", "A", 1.0)], "s_from string, x string, y string, s_to string, p double")
    edges_m = spark.createDataFrame([("M", "0", "M", 1.0)], "s_from string, x string, s_to string, p double")
    pi = spark.createDataFrame([("A", "M", 1.0)], "t string, m string, pi double")
    ys = "0010100"
    want, b = [], np.array([1.0, 0.0])
    step = {"0": np.array([[0.5, 0.3], [0, 0]]), "1": np.array([[0.2, 0], [1.0, 0]])}
    for y in ys:
        want.append((b @ step["0"]).sum())
        moved = b @ step[y]
        b = moved / moved.sum() if moved.sum() else np.array([1.0, 0.0])
    for chunk in (100, 3, 1):
        rows = filters.belief_filter(strings(spark, [("0" * len(ys), ys)]), edges_m, edges_t, pi, ["0", "1"], chunk=chunk).orderBy("t").collect()
        assert [r["p_0"] for r in rows] == pytest.approx(want) and rows[0]["p_0"] == pytest.approx(0.8) and rows[0]["p_1"] == pytest.approx(0.2)


def test_unknown_mode_and_strict(spark):
    with pytest.raises(ValueError, match="unknown mode"):
        filters.Belief({}, {}, {}, ["0"], "sometimes")
    b = filters.Belief({("A", "0", "0"): [("A", 0.5), ("B", 0.5)]}, {("M", "0"): ("M", 1.0)}, {("A", "M"): 1.0}, ["0", "1"], "strict")
    with pytest.raises(ValueError, match="impossible"):
        b.update("0", "1")


# -- mixed states

RIP = [("A", "0", "B", 0.5), ("A", "1", "C", 0.5), ("B", "0", "C", 0.5), ("B", "1", "C", 0.5), ("C", "1", "A", 1.0)]
EVEN = [("A", "0", "A", 0.5), ("A", "1", "B", 0.5), ("B", "1", "A", 1.0)]


def hidden_machine(seed, n):
    rng = np.random.default_rng(seed)
    out = []
    for s in range(n):
        cells = [(x, g) for x in "01" for g in range(n) if rng.random() < 0.7] or [("0", (s + 1) % n)]
        out += [(f"s{s}", x, f"s{g}", float(p)) for (x, g), p in zip(cells, rng.dirichlet(np.ones(len(cells))), strict=True)]
    return out


@pytest.mark.parametrize(("edges", "tolerance", "at_once"), [(EVEN, 1e-3, 0), (EVEN, 1e-3, 100), (RIP, 1e-3, 100), (hidden_machine(1, 3), 0.02, 5), (hidden_machine(1, 3), 0.02, 500)])
def test_closure_equals_one_task(spark, edges, tolerance, at_once):
    got = measures.mixed_state_tables(spark.createDataFrame(edges, "s_from string, x string, s_to string, p double"), tolerance, at_once)
    _, mats = measures.symbol_matrices(sorted(edges))
    etas, steps = measures.mixed_states(mats, stationary_exact(sum(mats.values())), tolerance)
    rows = sorted(got.states.collect())
    assert len(rows) == len(etas) and all(np.allclose(r["eta"], e) for r, e in zip(rows, etas, strict=True))
    want = {(i, x): (pytest.approx(float(p)), int(g)) for x, table in steps.items() for i, (p, g) in enumerate(table) if p > 0}
    assert {(r["id"], r["x"]): (r["p"], r["goal"]) for r in got.steps.collect()} == want
    m = measures.measures(sorted(edges), 6, tolerance)
    assert [r["h_l"] for r in measures.closure_curve(got, 6).orderBy("length").collect()] == pytest.approx(m.h_l)


def test_levels_are_the_same_at_once_and_by_frontiers(spark):
    table = spark.createDataFrame(hidden_machine(5, 3), "s_from string, x string, s_to string, p double")
    with pytest.raises(measures.TooManyMixedStates):
        measures.measures(hidden_machine(5, 3), tolerance=0.02, most=3)
    one, two = (measures.mixed_state_tables(table, 0.02, n).states.select("id", "level").collect() for n in (3, 500))
    assert len(one) > 3 and sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_numbers_follow_the_order(spark):
    rows = [(i * 7919 % 1009, "x") for i in range(1009)]
    got = numbered(spark.createDataFrame(rows, "k long, v string"), ["k"], "n", 5).collect()
    assert sorted((r["k"], r["n"]) for r in got) == [(i, i + 5) for i in range(1009)]


# -- stationary distributions of many states


def test_a_long_ring_is_solved_in_few_rounds(spark):
    """A walk round 40 states: lazy steps alone take 653 rounds to this tolerance, and are further off then."""
    n, rng = 40, np.random.default_rng(1)
    p = rng.uniform(0.3, 0.7, n)
    matrix = np.zeros((n, n))
    matrix[np.arange(n), (np.arange(n) + 1) % n] = p
    matrix[np.arange(n), (np.arange(n) - 1) % n] = 1 - p
    rows = [(i, int(j), float(matrix[i, j])) for i in range(n) for j in np.flatnonzero(matrix[i])]
    df = spark.createDataFrame(rows, "a long, b long, p double")
    got = {r["a"]: r["pi"] for r in algebra.stationary(df, ["a"], ["b"], 1e-6, states_most=20, rounds=20).collect()}
    want = stationary_exact(matrix)
    assert [got[i] for i in range(n)] == pytest.approx(want.tolist(), abs=2e-5)
    with pytest.raises(ArithmeticError, match="not stationary"):
        algebra.stationary(df, ["a"], ["b"], 1e-16, states_most=20, rounds=1)


# -- counts


def test_margins_by_grouping_sets(spark):
    symbols = strings(spark, [("01" * 20, "0110" * 10), ("0" * 9, "010101010")])
    both = counts.words_and_margins(symbols, 2)
    words = found_words(counts.word_counts(symbols, 2))
    assert {(r["k"], r["xs"], r["past"] + r["y"]): r["n"] for r in both.where("not margin").collect()} == words
    assert {(r["k"], r["xs"], r["past"]): r["n"] for r in both.where("margin").collect()} == found_words(counts.marginal_counts(counts.word_counts(symbols, 2)))
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2 and plan.count("Expand") == 1  # the windows are counted once, both sets come of that


def test_deltas_equal_a_recount(spark):
    one, two, three = [("abab", "0110"), ("aa", "01")], [("abba", "0101"), ("abab", "0110")], [("bbbbb", "11111")]
    before = counts.word_counts(strings(spark, one + two), 2)
    after = counts.revised_counts(before, counts.word_deltas(2, strings(spark, three), strings(spark, two)))
    assert found_words(after) == slow_words(one + three, 2)
    with pytest.raises(Exception, match="withdrawn more often"):
        counts.revised_counts(before, counts.word_deltas(2, withdrawn=strings(spark, three))).collect()
    with pytest.raises(ValueError, match="nothing"):
        counts.word_deltas(2)


@pytest.mark.parametrize("chunk", [4, 1 << 16])
def test_appended_symbols(spark, chunk):
    pairs = [("ab" * 10, "01101" * 4), ("a" * 7, "0101010"), ("b", "1")]
    symbols = strings(spark, pairs)
    for first in (0, 1, 2, 5, 6):
        since = symbols.where(F.col("t") >= first).groupBy("series_id").agg(F.min("t").alias("first"))
        before = counts.word_counts(symbols.where(F.col("t") < first), 2)
        assert found_words(counts.revised_counts(before, counts.appended_deltas(symbols, since, 2, chunk))) == slow_words(pairs, 2)


@pytest.mark.parametrize("width", [1, 2, 3, 7, 8, 13])
def test_long_words_by_names(spark, width):
    rng = random.Random(width)
    pairs = [("".join(rng.choice("ab") for _ in range(n)), "".join(rng.choice("01") for _ in range(n))) for n in (0, 1, 12, 13, 40)] + [("a" * 30, "0" * 30)] * 2
    want = Counter((x[t : t + width], y[t : t + width]) for x, y in pairs for t in range(len(y) - width + 1))
    got = {(r["xs"], r["ys"]): r["n"] for r in counts.long_word_counts(strings(spark, pairs), width).collect()}
    assert got == want


# -- intervals


@pytest.mark.parametrize(("bins", "bin_rows"), [(2, 1 << 20), (8, 50), (64, 7)])
def test_intervals_equal_all_with_all(spark, bins, bin_rows):
    rng = random.Random(3)
    points = [(i, rng.choice([0.5, 0.5, round(rng.random(), 2), rng.random(), None])) for i in range(400)]
    parts = [(j, *sorted((round(rng.random(), 2), round(rng.random(), 2)))) for j in range(30)] + [(90, 0.5, 0.5), (91, None, 1.0), (92, 0.0, None), (93, -9.0, 9.0), (94, 0.9, 0.1)]
    df = intervals.interval_join(spark.createDataFrame(points, "i long, u double"), spark.createDataFrame(parts, "j long, lo double, hi double"), bins=bins, bin_rows=bin_rows)
    want = {(i, j) for i, u in points for j, lo, hi in parts if None not in (u, lo, hi) and lo < u <= hi}
    rows = [(r["i"], r["j"]) for r in df.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_cumulative_intervals(spark):
    weights = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", 2.0)], "g string, y string, p double")
    rows = {(r["g"], r["y"]): (r["lo"], r["hi"]) for r in intervals.cumulative_intervals(weights, "y", by=["g"]).collect()}
    assert rows == {("a", "x"): (0.0, 0.25), ("a", "y"): (0.25, 1.0), ("b", "x"): (0.0, 1.0)}


# -- errors are told apart


def test_choice_of_length_tells_errors_apart(spark):
    symbols = strings(spark, [("0" * 400, "1001" * 100)])
    with pytest.raises(Exception, match="unknown test"):
        selection.choose_length_of(symbols, ["0", "1"], 2, kind="nonsense").collect()
    with pytest.raises(Exception, match="unknown test"):
        selection.choose_length(spark, ["1001" * 100], ["0", "1"], 2, kind="nonsense").collect()
    short = strings(spark, [("000000", "011011")])
    with pytest.raises(Exception, match="no recurrent part"):
        infer.infer(counts.word_counts(short, 5).withColumn("model_id", F.lit("m")), ["0"], ["0", "1"], 5).collect()
    assert infer.infer(counts.word_counts(short, 5).withColumn("model_id", F.lit("m")), ["0"], ["0", "1"], 5, skip_transient=True).count() == 0
    assert issubclass(NoRecurrentPart, ValueError)
    scores = {r["length"]: r["score"] for r in selection.choose_length_of(short, ["0", "1"], 5).collect()}
    assert scores[5] == float("inf")


def test_replicates_as_tables_equal_those_of_one_task(spark):
    """The same draws, and the same of them have failed; short series have models of one state too."""
    for length, size in ((2, 900), (4, 7)):
        one, two = (sorted(map(tuple, f(spark, EVEN, ["0", "1"], length, size, 5).collect())) for f in (selection.bootstrap, selection.bootstrap_tables))
        assert [(r[0], r[4]) for r in one] == [(r[0], r[4]) for r in two]
        for a, b in zip(one, two, strict=True):
            assert a[1:4] == b[1:4] or a[1:4] == pytest.approx(b[1:4], abs=1e-9)


@pytest.fixture
def joined_late(spark):
    """Small joins are found out while they run, as those of large tables are."""
    late = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in late.items():
        spark.conf.set(k, v)
    yield
    for k in late:
        spark.conf.unset(k)


def scattered(spark, series, length):
    """Symbols whose chunks come from several tasks, as they do where a table is large."""
    rng = np.random.default_rng(5)
    rows = [(s, t, str(rng.integers(2)), str(rng.integers(2))) for s in range(series) for t in range(length)]
    return rows, spark.createDataFrame(rows, "series_id long, t long, x string, y string").repartition(4, "t")


def test_chunks_of_a_scattered_series_stay_whole(spark, joined_late):
    rows, symbols = scattered(spark, 6, 100)
    owners = {(x, y): int(y) for x in "01" for y in "01"}
    model = filters.SuffixModel(owners, {(s, x, y): int(y) for s in (0, 1) for x in "01" for y in "01"}, 2)
    was = {(s, t + 1): int(y) for s, t, _, y in rows}
    assert {(r["series_id"], r["t"]): r["state"] for r in filters.filter_states(symbols, model, chunk=8).collect()} == {(s, t): was.get((s, t)) for s, t, _, _ in rows}


@pytest.mark.parametrize("goals", [1, 2])
@pytest.mark.parametrize("mode", ["restart", "never"])
def test_beliefs_of_a_scattered_series(spark, joined_late, goals, mode):
    rows, symbols = scattered(spark, 6, 100)
    t = {(f"t{s}", x, y): [(f"t{(s + int(y) + i) % 2}", (0.5 if goals == 2 else 1.0) * (0.25 if y == "0" else 0.75)) for i in range(goals)] for s in (0, 1) for x in "01" for y in "01" if (s, x, y) != (1, "1", "0")}
    m = {("m", x): [("m", 0.5)] for x in "01"}
    pi = {("t0", "m"): 0.25, ("t1", "m"): 0.75}
    edges_t = spark.createDataFrame([(a, x, y, b, p) for (a, x, y), g in t.items() for b, p in g], "s_from string, x string, y string, s_to string, p double")
    edges_m = spark.createDataFrame([(a, x, b, p) for (a, x), g in m.items() for b, p in g], "s_from string, x string, s_to string, p double")
    start = spark.createDataFrame([(*k, p) for k, p in pi.items()], "t string, m string, pi double")
    found = {(r["series_id"], r["t"]): r for r in filters.belief_filter(symbols, edges_m, edges_t, start, ["0", "1"], mode, 8).collect()}
    assert len(found) == len(rows)
    for s in range(6):
        b = filters.Belief(t, m, pi, ["0", "1"], mode)
        for _, at, x, y in rows[s * 100 : s * 100 + 100]:
            p = b.forecast(x)
            forbidden, got = b.update(x, y), found[s, at]
            assert (got["p_0"], got["p_1"]) == pytest.approx(p) and got["forbidden"] == forbidden and got["states"] == b.possible()


@pytest.mark.parametrize("n", [0, 1, 2, 7, 5000])
def test_quantiles_without_all_values_in_one_task(spark, n):
    rng = np.random.default_rng(3)
    values = [float(v) for v in np.floor(rng.normal(0, 50, n))]
    table = spark.createDataFrame([(v,) for v in values] + [(None,)], "cmu double")
    found = selection.interval(table, "cmu")
    assert "percentile(" not in found._jdf.queryExecution().toString()
    row = found.first()
    want = np.quantile(values, [0.025, 0.975]).tolist() if n else [None, None]
    assert [row["low"], row["high"]] == (pytest.approx(want) if n else want) and (row["n"], row["n_failed"]) == (n, 1)
    assert selection.quantile(table, "cmu", 1.0).first()["theta"] == (max(values) if n else None)


def test_bins_of_many_intervals_are_cut_again(spark, monkeypatch):
    monkeypatch.setattr(intervals, "BIN_INTERVALS", 4)
    rng = random.Random(6)
    rows = [(i, rng.randint(0, 400), rng.choice([0, 1, 3, 40])) for i in range(300)]
    rows = [(i, float(a), float(a + w)) for i, a, w in rows] + [(300, None, 5.0), (301, 0.0, 400.0), (302, 390.0, 1000.0)]
    points = [(i, float(rng.choice([7, rng.randint(-5, 450)]))) for i in range(200)] + [(200, None)]
    table = spark.createDataFrame(rows, "k long, lo double, hi double")
    found = intervals.interval_join(spark.createDataFrame(points, "i long, u double"), table, bins=4)
    assert "_cuts" in found._jdf.queryExecution().toString()
    got = Counter((r["i"], r["k"]) for r in found.collect())
    assert got == Counter((i, k) for i, u in points for k, a, b in rows if u is not None and a is not None and a < u <= b)


def test_settled_tables_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for rows in batches:
            seen.add(len(rows))
            yield rows

    table = spark.range(1000, numPartitions=4).mapInPandas(counted, "id long")
    for limit in (10, 10_000):
        seen.value = 0
        assert sorted(r["id"] for r in settled(table, limit).collect()) == list(range(1000))
        assert seen.value == 1000
