import corpus_pipeline
import pytest

from .helpers import awkward, empty, words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture
def folder(spark, tmp_path):
    clean = [(i, words(i, 150), "en", "s", 1) for i in range(150)]
    rows = clean + [
        (500, clean[3][1].replace(" ", "\n"), "en", "s", 1),  # equal but for white space, no longer
        (501, " ".join([*clean[4][1].split()[:-1], "tail"]), "en", "s", 1),  # near copy
        (502, words(700, 60) + " " + words(9999, 20) + " " + words(701, 60), "en", "s", 1),  # holds a test item
        (503, " ".join(w.upper() + "%%!" for w in words(5, 150).split()), "en", "s", 1),  # junk
        (504, None, None, None, None),
        (505, "", "en", "s", 0),
    ]
    save = lambda name, data, shape: spark.createDataFrame(data, shape).write.parquet(str(tmp_path / f"{name}.parquet"))
    save("documents", rows, "doc_id long, text string, lang string, source string, n_chars long")
    save("labels", [(i, 1, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    save("benchmark", [(1, words(9999, 20))], "item_id long, text string")
    return str(tmp_path)


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == COLUMNS
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen[name] = ids(docs)
    assert 503 not in seen["quality classifier"] and len(seen["quality classifier"] & set(range(150))) >= 145
    assert 500 in seen["quality classifier"] and 500 not in seen["exact dedup"] and len({504, 505} & seen["exact dedup"]) <= 1
    assert 501 in seen["exact dedup"]
    assert 502 in seen["near dedup"] and 502 not in seen["benchmark decontamination"]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert ids(packed) == seen["benchmark decontamination"]
    assert ids(corpus_pipeline.run(spark, folder)) == ids(packed)


def test_names_and_number():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "near dedup", "benchmark decontamination", "best-fit packing"]


def test_awkward_rows_pass_every_stage(spark, folder):
    for docs in (awkward(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns
            out.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, folder).count()


def test_near_copies_go(spark, folder):
    text = words(800, 200).split()
    # Every change of a word costs five shingles: four leave 176 of 216 (0.81), five leave 171 of 221 (0.77).
    changed = lambda n: " ".join("changed" if i % 30 == 20 and i < 30 * n else w for i, w in enumerate(text))
    rows = [(1, changed(0), "en", "s", 1), (2, changed(4), "en", "s", 1), (3, words(801, 200), "en", "s", 1), (4, " ".join(text[:100]) + " " + words(802, 100), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    near = dict(corpus_pipeline.STAGES)["near dedup"]
    assert {r["doc_id"] for r in near(spark, docs, folder).collect()} == {1, 3, 4}
    far = docs.where("doc_id <> 2").unionByName(spark.createDataFrame([(5, changed(5), "en", "s", 1)], docs.schema))
    assert near(spark, far, folder).count() == 4
