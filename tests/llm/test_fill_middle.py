import hashlib
import re

import pytest
from pyspark.sql import functions as F

from statewright.llm import fill_middle
from statewright.llm.fill_middle import fill_in_middle, fill_in_middle_digests, restored

from .helpers import awkward, empty, words

MARKED = ["<P>", "a<S>b", "<M", "<P", ">", "a<", "P>", "<<P>>", "<X>", "é<S>é", "< P>"]


def slow(doc_id, text, unit="points"):
    text = text or ""
    units = list(text) if unit == "points" else re.findall(r"[^\x20\x09-\x0d]+[\x20\x09-\x0d]*|^[\x20\x09-\x0d]+", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def table(spark):
    more = [(100 + i, t) for i, t in enumerate([*MARKED, "日本語 テキスト", "́á", "\U0001f600" * 9, " a  b ", "\n", *[words(i, 5) for i in range(60)]])]
    return awkward(spark).select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")).cache()


@pytest.mark.parametrize("unit", ["points", "words"])
@pytest.mark.parametrize("together", [1, 300, 1 << 22])
def test_equals_brute_force(spark, unit, together):
    docs = table(spark)
    rows = [tuple(r) for r in docs.collect()]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([None if t is None else t.encode() for _, t in rows], pa.binary())], ["t"])
    assert sum(x.num_rows for x in fill_middle.runs(batch, 0, together)) == len(rows)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted(map(tuple, fill_in_middle(docs, unit=unit).collect()), key=key)
    assert got == sorted((slow(*r, unit) for r in rows), key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_every_output_is_restored(spark):
    docs = table(spark)
    back = fill_in_middle(docs).select("doc_id", restored(F.col("output"), F.col("form")).alias("text"))
    want = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    assert back.exceptAll(want).count() == 0 and want.exceptAll(back).count() == 0


def test_runs_do_not_change_the_cuts(spark, monkeypatch):
    docs = table(spark)
    whole = sorted(map(str, fill_in_middle_digests(docs).collect()))
    monkeypatch.setattr(fill_middle, "TOGETHER", 100)
    assert sorted(map(str, fill_in_middle_digests(docs).collect())) == whole


def test_empty_and_unknown_unit(spark):
    assert fill_in_middle_digests(empty(spark)).count() == 0
    with pytest.raises(ValueError, match="unknown unit"):
        fill_in_middle(empty(spark), unit="lines")
