from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statewright.operators import counts, encode


def strings(spark, pairs):
    return encode.explode_strings(spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pairs)], "series_id long, X string, Y string"))


def slow(pairs, length):
    out = Counter()
    for x, y in pairs:
        for t in range(len(y) - length):
            for k in range(1, length + 2):
                out[k, x[t : t + k], y[t : t + k]] += 1
    return out


def found(df):
    return Counter({(r["k"], r["xs"], r["ys"]): r["n"] for r in df.collect()})


def test_both_methods_equal_brute_force(spark):
    pairs = [("abacabacabac", "010001000100"), ("abc", "010"), ("aa", "01"), ("abcabcab", "01000100")]
    symbols = strings(spark, pairs)
    for length in (1, 2, 3):
        want = slow(pairs, length)
        assert found(counts.word_counts(symbols, length, 1)) == want
        assert found(counts.word_counts(symbols, length, 0)) == want


def test_chunks_do_not_change_windows(spark):
    y = "0110101101011100101" * 20
    symbols = strings(spark, [("0" * len(y), y)])
    whole = sorted(map(tuple, counts.windows(symbols, 3).collect()))
    for chunk in (4, 7, 50):
        assert sorted(map(tuple, counts.windows(symbols, 3, chunk).collect())) == whole


def test_totals_and_margins(spark):
    symbols = strings(spark, [("01" * 30, "0110" * 15)])
    words = counts.word_counts(symbols, 3)
    totals = {r["k"]: r["s"] for r in words.groupBy("k").agg({"n": "sum"}).withColumnRenamed("sum(n)", "s").collect()}
    assert totals == {1: 57, 2: 57, 3: 57, 4: 57}
    ones = counts.conditional(words).groupBy("k", "xs", "past").agg({"p": "sum"}).collect()
    assert all(abs(r["sum(p)"] - 1) < 1e-12 for r in ones)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("01", min_size=0, max_size=12), min_size=1, max_size=4))
def test_random_series(spark, ys):
    pairs = [("0" * len(y), y) for y in ys]
    assert found(counts.word_counts(strings(spark, pairs), 2)) == slow(pairs, 2)


def test_series_of_different_length_raise(spark):
    import pytest

    with pytest.raises(Exception, match="differ in length"):
        strings(spark, [("01", "011")]).collect()


def test_symbols_outside_the_alphabet_raise(spark):
    import pytest

    with pytest.raises(Exception, match="outside the alphabets"):
        encode.check_alphabet(strings(spark, [("01", "02")]), ["0", "1"], ["0", "1"]).collect()


def test_empty(spark):
    assert counts.word_counts(strings(spark, [("", "")]), 2).count() == 0


def test_ranks_by_bucket_equal_plain_ranks(spark):
    from pyspark.sql import functions as F

    rows = [(u, d, i, "ab"[(i + d) % 2]) for u in range(3) for d in range(4) for i in range(u + 2)]
    table = spark.createDataFrame(rows, "u long, day int, i int, y string")
    plain = encode.encode(table, "u", ["day", "i"], F.col("y"))
    cut = encode.encode(table, "u", ["day", "i"], F.col("y"), bucket=F.col("day"))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, cut.collect()))


def test_tasks_rank_bounded_numbers_of_rows(spark, monkeypatch):
    monkeypatch.setattr(encode, "TASK_ROWS", 100, raising=False)
    rows = [(u, d, i, "ab"[(i + d) % 2]) for u in range(300) for d in range(2) for i in range(3)]
    table = spark.createDataFrame(rows, "u long, day int, i int, y string")
    symbols = encode.encode(table, "u", ["day", "i"], F.col("y"))
    sizes = [r["count"] for r in symbols.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 300
    assert {(r["series_id"], r["t"], r["y"]) for r in symbols.collect()} == {(u, 3 * d + i, y) for u, d, i, y in rows}


@pytest.mark.parametrize("task_rows", [2, 1 << 21])
def test_followers(spark, monkeypatch, task_rows):
    monkeypatch.setattr(encode, "TASK_ROWS", task_rows, raising=False)
    table = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (1, 2, None), (2, 5, "z"), (None, 1, "m"), (None, 2, "n")], "u long, i int, y string")
    found = sorted(map(repr, ((r["y"], r["after"]) for r in encode.followers(table, "u", ["i"], "y").collect())))
    assert found == sorted(map(repr, [("a", None), (None, "c"), ("c", None), ("z", None), ("m", "n"), ("n", None)]))
    assert encode.followers(table.where("i > 9"), "u", ["i"], "y").count() == 0


def test_methods_are_named(spark):
    import pytest

    with pytest.raises(ValueError, match="method"):
        counts.word_counts(strings(spark, [("0", "1")]), 1, method=2)
