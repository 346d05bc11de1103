import numpy as np

from statewright.llm.toxicity import PATTERNS, best_cut, in_held_out, label_model, linear_fit, toxicity_scores

from .helpers import awkward, empty, words


def corpus(spark, n=600):
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        text = words(i, 60) + (" grumbwort " + ["snarkle", "snarkled", "snarkling"][i % 3] if toxic else " plain")
        rows.append((i, text))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows_are_told_apart(spark):
    docs, labels = corpus(spark)
    rows = toxicity_scores(docs, labels).collect()
    assert len(rows) == 600
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == in_held_out(r["doc_id"])
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held]) > 0.98


def test_held_out_labels_are_never_used(spark):
    docs, labels = corpus(spark, 300)
    a = {r["doc_id"]: r["score"] for r in toxicity_scores(docs, labels).collect()}
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    b = {r["doc_id"]: r["score"] for r in toxicity_scores(docs, flipped).collect()}
    assert a == b


def test_label_model_estimates_rates_and_correlations():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.3
    good = (rng.random(4000) < np.where(truth, 0.8, 0.05)).astype(float)
    weak = (rng.random(4000) < np.where(truth, 0.6, 0.2)).astype(float)
    votes = np.stack([good, good, weak], axis=1)  # two voters that are one
    labels = np.where(rng.random(4000) < 0.5, truth.astype(int), -1)
    post, stats = label_model(votes, labels)
    assert abs(stats["on_toxic"][0] - 0.8) < 0.1 and abs(stats["on_harmless"][2] - 0.2) < 0.1
    assert stats["correlation"][0, 1] > 0.9 and stats["weight"][0] < 0.6 < stats["weight"][2]
    assert np.mean((post > 0.5) == truth) > 0.85


def test_linear_fit_separates():
    starts, columns = np.array([0, 1, 2, 3, 4]), np.array([0, 1, 0, 1])
    w, b = linear_fit(starts, columns, 2, np.array([1.0, 0.0, 1.0, 0.0]))
    assert w[0] + b > 1 and w[1] + b < -1


def test_patterns_count_in_scores(spark):
    """Texts told apart by a phrase alone: its words are in all of them."""
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        rows.append((i, words(i, 30) + (" go to hell " if toxic else " to hell go ") + words(900 + i, 30)))
        labels.append((i, 1, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = [r for r in toxicity_scores(docs, known).collect() if r["held_out"]]
    assert len(PATTERNS) >= 3 and np.mean([r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held]) > 0.95


def test_best_cut_lies_in_the_gap():
    odds = np.array([-5.0, -4.0, -3.5, -1.0, -0.5, 2.0])
    target = np.array([0, 0, 0, 1, 1, 1.0])
    assert best_cut(odds, target) == -2.25
    assert best_cut(odds, np.zeros(6)) == 0.0 and best_cut(odds[::-1].copy(), target[::-1].copy()) == -2.25


def test_awkward_rows(spark):
    docs = awkward(spark)
    _, labels = corpus(spark, 12)
    assert toxicity_scores(docs, labels).count() == docs.count()
    nothing = spark.createDataFrame([], labels.schema)
    assert all(r["score"] < 0.5 for r in toxicity_scores(docs, nothing).collect())
    assert toxicity_scores(empty(spark), labels).count() == 0
