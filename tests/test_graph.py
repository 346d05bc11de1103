import random

import pytest

from statewright.operators import graph


def table(spark, pairs):
    return spark.createDataFrame(pairs, "s_from long, s_to long")


def found(spark, pairs, held_rows=0):
    """By joins, unless ``held_rows`` lets one task do it."""
    return {r["state"]: r["component"] for r in graph.mutual_components(table(spark, pairs), held_rows).collect()}


def slow(pairs):
    return graph.strong_components(sorted({n for p in pairs for n in p}), set(pairs))


@pytest.mark.parametrize(("n", "held_rows"), [(2, 0), (8, 0), (60, 0), (8, 100), (1000, 2000)])
def test_a_cycle_is_one_component(spark, n, held_rows):
    assert found(spark, [(i, (i + 1) % n) for i in range(n)], held_rows) == dict.fromkeys(range(n), 0)


def test_a_cycle_is_recurrent(spark):
    assert graph.recurrent_part(table(spark, [(i, (i + 1) % 8) for i in range(8)] + [(20, 0)])).count() == 8


def test_a_path_is_as_many_components_as_states(spark):
    assert found(spark, [(i, i + 1) for i in range(50)]) == {i: i for i in range(51)}
    assert found(spark, [(5, 5)]) == {5: 5}


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs_equal_one_task(spark, seed):
    rng = random.Random(seed)
    n = rng.choice([6, 15, 40])
    pairs = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(int(n * rng.choice([0.8, 1.2, 1.8, 2.5])))})
    assert found(spark, pairs) == slow(pairs)


def test_rings_joined_by_chains(spark):
    pairs = []
    for ring in range(5):
        base = ring * 100
        pairs += [(base + i, base + (i + 1) % 20) for i in range(20)] + [(base + 3, base + 11), (base + 15, base + 2)]
        pairs += [(base + 7, base + 50), *((base + 50 + i, base + 51 + i) for i in range(20)), (base + 70, base + 100)]
    pairs += [(500, 501), (501, 500)]
    assert found(spark, pairs) == found(spark, pairs, 1000) == slow(pairs)
    kept = graph.recurrent_part(table(spark, pairs))
    assert {r["s_from"] for r in kept.collect()} == graph.recurrent(sorted(slow(pairs)), set(pairs))


def test_what_states_lead_to(spark):
    pairs = table(spark, [(1, 2), (2, 3), (3, 2), (4, 1), (5, 6)])
    states = spark.createDataFrame([(1,), (9,)], "state long")
    assert {r["state"] for r in graph.reachable_from(pairs, states).collect()} == {1, 2, 3, 9}
    assert {tuple(r) for r in graph.reachable(pairs).collect()} == {(1, 2), (1, 3), (2, 3), (2, 2), (3, 2), (3, 3), (4, 1), (4, 2), (4, 3), (5, 6)}


def test_empty(spark):
    assert graph.mutual_components(table(spark, [])).count() == 0 and graph.recurrent_part(table(spark, [])).count() == 0
