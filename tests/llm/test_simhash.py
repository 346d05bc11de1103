import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from statewright.llm.simhash import fingerprint, key_sets, links, near_components, near_dedup, sketched
from statewright.llm import shingles
from statewright.llm.components import components
from statewright.llm.shingles import similar_sets

from .helpers import awkward, empty, words


def slow_fingerprint(text):
    low = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_fingerprint():
    for text in ("", "One", "a B", "A b\tc\x0bd", words(3, 500), "Ünï É x y z", "a b c d"):
        assert fingerprint(text.encode()) == slow_fingerprint(text)


def test_close_words_share_a_key():
    rng = random.Random(1)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 2)):
            b ^= 1 << bit
        rows, keys = key_sets(np.array([a, b], dtype=np.uint64))
        assert set(keys[rows == 0]) & set(keys[rows == 1])
        assert len(set(keys[rows == 0])) <= 18


@pytest.mark.parametrize("pairwise", [1, 3, 64])
def test_links_join_what_brute_force_joins(spark, pairwise):
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for base in list(fps)[:4]:
        for _ in range(60):
            near = base
            for bit in rng.sample(range(64), rng.randint(1, 3)):
                near ^= 1 << bit
            fps.add(near)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {r["node"]: r["root"] for r in components(links(nodes, pairwise)).collect()}
    want = slow_components(fps)
    groups = {}
    for x, w in zip(signed, want, strict=True):
        groups.setdefault(w, set()).add(found.get(x, x))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    found = components(edges).collect()
    assert len(found) == 203
    assert {r["root"] for r in found} == {0, 1000}


def test_rows(spark):
    docs = awkward(spark)
    rows = docs.collect()
    fps = [slow_fingerprint(r["text"]) for r in rows]
    roots = slow_components(fps)
    least = {}
    for r, k in zip(rows, roots, strict=True):
        if r["doc_id"] is not None:
            least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    want = Counter((r["doc_id"], f"{f:016x}", least.get(k)) for r, f, k in zip(rows, fps, roots, strict=True))
    assert Counter(tuple(r) for r in near_components(docs).collect()) == want
    kept = near_dedup(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(roots))


def test_empty(spark):
    assert near_components(empty(spark)).count() == 0
    assert near_dedup(empty(spark)).count() == 0


def slow_shingles(text):
    found = text.split()
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))}


def test_block_links_join_what_similar_pairs_join():
    rng = np.random.default_rng(3)
    for trial in range(30):
        bases = [rng.choice(10_000, rng.integers(1, 60), replace=False) for _ in range(6)]
        sets = []
        for _ in range(40):
            base = set(bases[rng.integers(6)].tolist())
            sets.append(sorted((base - set(rng.choice(list(base), 1 if rng.random() < 0.7 else 0).tolist())) | set(rng.choice(10_000, rng.integers(0, 4)).tolist())) or [1])
        flat, starts = np.concatenate([np.array(x, dtype=np.int64) for x in sets]), np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        roots = rng.integers(0, 25, len(sets)) + 100
        left, right = (np.arange(40), np.arange(40)) if trial % 2 else (np.arange(0, 25), np.arange(25, 40))
        alike = lambda i, j: roots[i] != roots[j] and len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j]))
        want = [(i, j) for i in left for j in right if alike(i, j)]
        got = shingles.joining_links(flat, starts, left, right, roots, 0.8)
        assert set(got) <= {(int(i), int(j)) for i, j in want} and len(got) < len(set(roots.tolist()))

        def joined(links):
            above = {int(r): int(r) for r in roots}
            for i, j in links:
                a, b = above[int(roots[i])], above[int(roots[j])]
                above = {k: b if v == a else v for k, v in above.items()}
            return {frozenset(k for k, v in above.items() if v == w) for w in above.values()}

        assert joined(got) == joined(want)


@pytest.mark.parametrize(("pairwise", "weight"), [(1, 3000), (64, 1 << 20)])
def test_similar_texts_are_linked_as_brute_force_links_them(spark, pairwise, weight):
    rng = random.Random(4)
    texts = ["one", "one two", "one two three four five six"]
    for k in range(12):
        base = words(900 + k, rng.randint(20, 300)).split()
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, len(copy) // 20)):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts = list(dict.fromkeys(texts))
    sets = [slow_shingles(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sketched(docs).cache()
    name = {r["doc_id"]: r["set_key"] for r in rows.collect()}
    root = {r["node"]: r["root"] for r in components(similar_sets(rows, docs, 0.8, pairwise=pairwise, weight=weight)).collect()}
    want = spark.createDataFrame([(name[i], name[j]) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])], "a long, b long")
    assert root == {r["node"]: r["root"] for r in components(want).collect()}
