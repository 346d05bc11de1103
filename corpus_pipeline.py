"""Corpus preparation: from the table `documents` to packed training sequences.

Each stage applies one operator of :mod:`statewright.llm` to all rows that the
stage before kept.  All but the last return the columns of `documents`.

Nulls, empty and very long texts, ties and repeated rows follow the operators:
a null text counts as empty, rows repeated with the same id and text stay once
after the exact stage, and empty input gives empty output at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from statewright.llm.common import discard, settle, table
from statewright.llm.decontaminate import decontaminate
from statewright.llm.exact_dedup import exact_dedup
from statewright.llm.kneser_ney import quality_filter
from statewright.llm.packing import pack_documents
from statewright.llm.simhash import near_dedup

TOKENIZER = "word_bpe_49k.json"
#: Jaccard similarity of five-word shingles from which documents are near copies.
SIMILARITY = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within what trusted text of their language shows."""
    return quality_filter(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal normalised texts."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component linked by fingerprints within two bits or by five-word shingles of similarity 0.8 or more."""
    return near_dedup(docs, similarity=SIMILARITY)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' token pieces in sequences."""
    return pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("near dedup", near),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", packed),
]

#: The perplexities, fingerprints and token ids can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES, 1):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = settle(docs)
            discard(before)
    return docs
