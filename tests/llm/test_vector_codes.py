import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import types as T

from statewright.llm.vector_codes import Means, lower_bound, nearest, vector_codes

SHAPE = T.StructType([
    T.StructField("vec_id", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()),
    *[T.StructField(c, T.StringType()) for c in ("code", "ints", "_label", "error", "cell")],
])


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", None, "x", "x", "x") for r in rows], SHAPE)


def slow(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(order[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in order[:entries]] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda part, book: min((gap(part, e), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for _, v, _ in kept:
                own[best(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(c) for c in zip(*o, strict=True)] if o else e for o, e in zip(own, books[p], strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded = []
    for i, v, label in kept:
        found = [best(cut(v, p), books[p]) for p in range(parts)]
        coded.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
    totals = {}
    for _, _, e, label in coded:
        totals[label] = totals.get(label, 0) + e
    return [(i, c, e, totals[label], digest) for i, c, e, label in coded]


def key(r):
    return tuple((x is None, str(x)) for x in r)


@pytest.mark.parametrize(("n", "dims"), [(120, 16), (200, 64), (5, 8), (40, 24)])
def test_equals_brute_force(spark, n, dims):
    rng = np.random.default_rng(n)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.2, dims)], int(i % 3)) for i in rng.permutation(n)]
    rows += [rows[0], rows[0], (None, rows[1][1], None), (7, rows[2][1], None), (-1, [0.0] * dims, 1), (-2, [-0.0] * dims, 1), (-3, [1e-9] * dims, None), (-4, [-1e-9] * dims, 2)]
    rows += [(900, None, 1), (901, [], 1), (902, [None] * dims, 1), (903, [float("nan")] + [0.0] * (dims - 1), None), (904, [0.0] * (dims - 1) + [float("-inf")], 3), (None, None, None)]
    got = sorted(map(tuple, vector_codes(table(spark, rows)).collect()), key=key)
    assert got == sorted(slow(rows), key=key)


def test_bounds_never_exceed_the_distance():
    rng = np.random.default_rng(3)
    for scale in (3, 1000, 1 << 26):
        a, b = rng.integers(-scale, scale, (300, 8)), rng.integers(-scale, scale, (300, 8))
        b[::3] = a[::3] + rng.integers(-1, 2, (100, 8))
        a[1::5] = a[1::5, :1]
        d = ((a - b) ** 2).sum(axis=1)
        for (s, r, w), (t, q, _) in zip(Means(a).levels, Means(b).levels, strict=True):
            assert np.all(lower_bound(s, t, r, q, w) <= d)
        chosen, distance = nearest(a, b[:16])
        full = ((a[:, None] - b[None, :16]) ** 2).sum(axis=2)
        assert np.array_equal(chosen, full.argmin(axis=1)) and np.array_equal(distance, full.min(axis=1))


def test_empty_tables_and_what_raises(spark):
    assert vector_codes(table(spark, [])).count() == 0
    assert vector_codes(table(spark, [(1, None, 2)])).count() == 0
    with pytest.raises(Exception, match="too large"):
        vector_codes(table(spark, [(1, [1e9] * 8, 1)])).collect()
    with pytest.raises(Exception, match="equal parts"):
        vector_codes(table(spark, [(1, [1.0] * 9, 1)])).collect()
    with pytest.raises(Exception, match="differ in length"):
        vector_codes(table(spark, [(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)])).collect()
    with pytest.raises(Exception, match="differ in length"):
        vector_codes(table(spark, [(i, [1.0] * 8, 1) for i in range(20)] + [(99, [1.0] * 16, 1)])).collect()
