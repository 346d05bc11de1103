import os

import pytest
from pyspark.sql import functions as F

from statewright.sources import model_files, models

EDGES = [
    ("two", 0, "0", "0", 1, 1 / 3), ("two", 0, "0", "1", 1, 2 / 3), ("two", 1, "0", "1", 0, 1.0), ("two", 1, "0", "0", 0, 0.0), ("two", 1, "1", "0", 1, None), ("two", 1, "1", "1", 1, float("nan")),
    ("one/x+y z", 0, "0", "0", 0, 1 / 3), ("one/x+y z", 0, "0", "1", 0, 2 / 3), ("one/x+y z", 0, "1", "1", 0, 0.0),
]


def table(spark):
    return spark.createDataFrame(EDGES, "model_id string, s_from int, x string, y string, s_to int, p double")


def as_list(model):
    return sorted(((a, x, y, b, p) for m, a, x, y, b, p in EDGES if m == model), key=lambda e: (e[0], e[3], e[2], e[1]))


@pytest.mark.parametrize("dialect", ["transducer", "memoryless", "machine-lines", "machine"])
@pytest.mark.parametrize("all_digits", [False, True])
def test_graphs_are_written_and_read_again(spark, tmp_path, dialect, all_digits):
    path = str(tmp_path / "g")
    model_files.write_graphs(table(spark), path, dialect, all_digits)
    files = [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".txt")]
    assert len(files) == 2
    for model in ("two", "one/x+y z"):
        own = next(f for f in files if ("two" in f) == (model == "two"))
        want = models.graph_text(as_list(model), all_digits, dialect != "machine", "machine" if dialect.startswith("machine") else "transducer")
        assert open(own).read().rstrip("\n") == want
    reader = models.read_transducer if dialect in ("transducer", "memoryless") else lambda s, p: models.read_machine(s, p, dialect)
    back = reader(spark, f"{path}/*/*").select(model_files.model_of(F.col("path")).alias("m"), "s_from", "s_to", "p").collect()
    got = sorted((r["m"], r["s_from"], r["s_to"], round(r["p"], 2)) for r in back)
    assert got == sorted((m, "AB"[a], "AB"[b], round(p, 2)) for m, a, _, _, b, p in EDGES if p is not None and p == p and (p > 0 or m == "two" or dialect == "machine"))


def test_unknown_dialect(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown dialect"):
        model_files.write_graphs(table(spark), str(tmp_path / "g"), "prose")


def test_listings_are_written_and_read_again(spark, tmp_path):
    histories = [(0, "00", "10"), (0, "", ""), (1, "0", "1"), (1, "0", "0"), (1, "01", "00")]
    p = {(0, "0", "0"): 0.5, (0, "0", "1"): 0.5, (1, "0", "0"): 1 / 3}
    steps = {(0, "0", "0"): 1, (1, "0", "1"): 0, (1, "0", "0"): 1}
    h = spark.createDataFrame([("a", *r) for r in histories] + [("b", 0, "", "")], "model_id string, state int, xs string, ys string")
    e = spark.createDataFrame([("a", *k, v) for k, v in p.items()], "model_id string, state int, x string, y string, p double")
    t = spark.createDataFrame([("a", *k, v) for k, v in steps.items()], "model_id string, s_from int, x string, y string, s_to int")
    path = str(tmp_path / "l")
    model_files.write_listings(h, e, t, path, ["0"], ["0", "1"])
    files = {("a" if "model_id=a" in d else "b"): os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".txt")}
    assert open(files["a"]).read().rstrip("\n") == models.states_text(histories, p, steps, ["0"], ["0", "1"]).rstrip("\n")
    back_h, back_e, back_t = model_files.read_listings(spark, f"{path}/*/*")
    mine = lambda df: df.where(F.col("path").contains("model_id=a")).drop("path")
    assert {tuple(r) for r in mine(back_h).collect()} == set(histories)
    assert {(r["state"], r["x"], r["y"]): r["p"] for r in mine(back_e).collect()} == {**{(s, "0", y): 0.0 for s in (0, 1) for y in "01"}, **p}
    assert {(r["s_from"], r["x"], r["y"]): r["s_to"] for r in mine(back_t).collect()} == steps


def test_memoryless_listings(spark, tmp_path):
    h = spark.createDataFrame([("m", 0, "0", "n"), ("m", 1, "1", "n"), ("m", 1, "11", "nn")], "model_id string, state int, xs string, ys string")
    e = spark.createDataFrame([("m", 0, "0", 0.25), ("m", 0, "1", 0.75), ("m", 1, "1", 1.0)], "model_id string, state int, y string, p double")
    t = spark.createDataFrame([("m", s, x, y, int(x)) for s in (0, 1) for x in "01" for y in "01"], "model_id string, s_from int, x string, y string, s_to int")
    path = str(tmp_path / "l")
    model_files.write_listings(h, e, t, path, ["0", "1"], ["0", "1"], memoryless=True)
    text = open(next(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".txt"))).read()
    assert "distribution: P(0) = 0.25\tP(1) = 0.75\t\ntransitions: T((0, n)) = 0\tT((1, n)) = 1\t\n" in text
    back_h, back_e, back_t = (df.drop("path") for df in model_files.read_listings(spark, f"{path}/*/*"))
    assert {tuple(r) for r in back_h.collect()} == {(0, "0", "n"), (1, "1", "n"), (1, "11", "nn")}
    assert {(r["state"], r["y"]): r["p"] for r in back_e.collect()} == {(0, "0"): 0.25, (0, "1"): 0.75, (1, "0"): 0.0, (1, "1"): 1.0} and all(r["x"] is None for r in back_e.collect())
    assert {tuple(r) for r in back_t.collect()} == {(s, x, "n", int(x)) for s in (0, 1) for x in "01"}


def test_generators(spark, tmp_path):
    rules = [("g", "A", "1", "0", 0.95), ("g", "R", "0", "1", 0.0), ("g", "R", "1", "1", 0.0), ("g", "N", "0", "0", 1e-05)]
    path = str(tmp_path / "r")
    model_files.write_lines(model_files.generator_table(spark.createDataFrame(rules, "model_id string, state string, xs string, ys string, p double")), path)
    back = model_files.read_generators(spark, f"{path}/*/*")
    assert {(r["state"], r["xs"], r["ys"], r["p"]) for r in back.collect()} == {r[1:] for r in rules}
    text = "State A\n1, 0\nP(X = 1 | S = s) = 0.95\nState R\n0, 1\n1, 1\nP(X = 1 | S = s) = 0.0"
    (tmp_path / "plain.trans").write_text(text)
    assert {(r["xs"], r["ys"]): r["p"] for r in model_files.read_generators(spark, str(tmp_path / "plain.trans")).collect()} == models.read_generator(text)
