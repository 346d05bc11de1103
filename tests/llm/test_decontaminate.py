import random

from statewright.llm.decontaminate import RATE, Item, best_end, contamination, decontaminate, normal, pattern_bits, pieces

from .helpers import awkward, empty, words


def slow_best(pattern, text):
    before = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (c != d)))
        before = now
    return min(before), before.index(min(before))


def test_myers_equals_the_table():
    rng = random.Random(4)
    for _ in range(300):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 80)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 120)))
        assert best_end(pattern_bits(p), len(p), t) == slow_best(p, t)


def test_pieces_cover_an_item():
    text = words(1, 30)
    parts = pieces(text, RATE)
    assert "".join(p for _, p in parts) == text and len(parts) == int(RATE * len(text)) + 1
    assert pieces("a", 0.9) == [(0, "a")]


def test_some_piece_bears_every_match():
    """Within the budget, some exact hit has all branches above it within their bounds."""
    rng = random.Random(8)
    for _ in range(400):
        item = Item(0, "".join(rng.choice("abcdef") for _ in range(rng.randint(32, 150))), RATE)
        text = "".join(rng.choice("abcdef") for _ in range(40))
        text += edited(rng, item.text, item.budget) + "".join(rng.choice("abcdef") for _ in range(40))
        assert slow_best(item.text, text)[0] <= item.budget
        hits = [(i, at) for i, (a, b) in enumerate(zip(item.cuts, item.cuts[1:])) for at in range(len(text)) if text.startswith(item.text[a:b], at)]
        assert any(item.bears(i, at, text, {}) for i, at in hits)
        for i in range(item.budget + 1):
            above = list(item.branches(i))
            assert all(low <= i < high for low, high in above) and above == sorted(above, key=lambda x: x[1] - x[0])


def test_recall_of_edited_passages(spark):
    """Passages with edits in one tenth of their characters are found, whatever stands around."""
    rng = random.Random(3)
    items = [(i, normal(words(900 + i, 30))) for i in range(20)]
    docs = [(i, words(i, 40) + " " + edited(rng, items[i % 20][1], int(0.1 * len(items[i % 20][1]))) + " " + words(300 + i, 40)) for i in range(100)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert found == {(i, i % 20) for i in range(100)}


def test_short_items_are_found_inside_texts(spark):
    docs = spark.createDataFrame([(1, "  YES\n"), (2, "yes it is"), (3, "no"), (4, "eyes"), (5, "(yes)"), (6, "They asked: What is the capital of France? Paris."), (7, "yes2"), (8, "oh,yes")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "yes"), (2, "Yes "), (3, "What is the capital of France?")], "item_id long, text string")
    rows = contamination(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in rows} == {(d, i, 0) for d in (1, 2, 5, 8) for i in (1, 2)} | {(6, 3, 0)}
    assert all(normal({6: "They asked: What is the capital of France? Paris."}.get(r["doc_id"], ""))[r["start"] : r["end"]] in ("", "what is the capital of france?") for r in rows)


def test_items_of_every_length_equal_brute_force(spark):
    """Lengths 1 to 60: under 32 as they stand between edges, from there on within the edits that the rate allows."""
    rng = random.Random(21)
    source = words(77, 200)
    items = [(n, source[at : at + n].strip() or "a") for n in range(1, 61) for at in [rng.randrange(400)]]
    docs = [(i, f"{words(i, 6)} {edited(rng, items[i % 60][1], rng.choice([0, 0, 1, 3]))} {words(900 + i, 6)}") for i in range(120)]
    want = {}
    for d, t in docs:
        t = normal(t)
        for k, item in items:
            item = normal(item)
            if len(item) < 32:
                places = [at for at in range(len(t)) if t.startswith(item, at)]
                edges = lambda a, b: not (a and t[a - 1].isalnum() and t[a].isalnum()) and not (b < len(t) and t[b].isalnum() and t[b - 1].isalnum())  # noqa: B023, E731
                if any(edges(at, at + len(item)) for at in places):
                    want[d, k] = 0
            elif (distance := slow_best(item, t)[0]) <= int(RATE * len(item)):
                want[d, k] = distance
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]): r["distance"] for r in got.collect()} == want
    assert len({k for _, k in want}) > 50


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        i = rng.randrange(len(text))
        kind = rng.randrange(3)
        if kind == 0:
            text[i] = rng.choice("qxz")
        elif kind == 1:
            del text[i]
        else:
            text.insert(i, rng.choice("qxz"))
    return "".join(text)


def test_rows_equal_brute_force(spark):
    rng = random.Random(9)
    items = [(i, words(100 + i, 18)) for i in range(6)] + [(50, ""), (51, None), (52, words(100, 18))]
    docs = []
    for i in range(40):
        item = items[i % 6][1]
        body = [words(i, 30), edited(rng, item, rng.randint(0, int(2 * RATE * len(item)))), words(500 + i, 30)]
        docs.append((i, "\n ".join(body).upper() if i % 3 == 0 else " ".join(body)))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for d, t in docs:
        for k, item in items:
            item = normal(item)
            if item:
                distance, _ = slow_best(item, normal(t))
                if distance <= int(RATE * len(item)):
                    want[d, k] = distance
    for block in (400_000, 200):
        rows = contamination(table, bench, block_chars=block).collect()
        assert {(r["doc_id"], r["item_id"]): r["distance"] for r in rows} == want
    assert 0 < len(want) < 240
    kept = decontaminate(table, bench)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_awkward_rows(spark):
    docs = awkward(spark)
    bench = spark.createDataFrame([(1, words(2, 40)), (2, "  ")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in contamination(docs, bench).collect()} == {(9, 1)}
    kept = decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1
    assert contamination(docs, bench.limit(0)).count() == 0
    assert contamination(empty(spark), bench).count() == 0
