"""Small document tables with the awkward rows that every operator must bear."""

import random

from pyspark.sql import types as T

#: Names that operators use for columns of their own, or that other tables have.
CLASHING = ["key", "fp", "text_key", "points", "_keep", "score", "toxic", "quality", "_toxic", "_id", "_doc", "_key", "_lang", "_good", "half", "nll", "root", "node", "name", "host", "item_id", "verdict", "start", "end", "n"]
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    *[T.StructField(c, T.StringType()) for c in CLASHING],
])


def row(i, text, lang="en"):
    return (i, text, lang, "src0", None if text is None else len(text), *["x"] * len(CLASHING))


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["an", "the", "on", "er", "ing", "re", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def awkward(spark):
    """Nulls in each column, empty, white and very long texts, ties, repeated rows."""
    long_text = words(1, 30_000)
    rows = [
        row(1, "a b c d"),
        row(2, "a  b\tc d"),
        row(2, "a  b\tc d"),
        row(3, ""),
        row(4, None),
        row(5, " \n\t"),
        row(None, "a b c d"),
        row(None, None, None),
        row(6, long_text),
        row(7, long_text + " "),
        row(8, long_text[:-1]),
        row(9, words(2, 40)),
        row(9, words(3, 40)),
        row(10, "Ünï \U0001f600 " + words(4, 50), "de"),
        (11, words(5, 60), None, None, None, *[None] * len(CLASHING)),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
