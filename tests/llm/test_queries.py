import os

import pytest

from statewright.llm.queries import ORACLE_SQL, QUERIES

from ..oracle import FOLDER, assert_equal, connection

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no synthetic tables here")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    assert_equal(spark, connection(), QUERIES[name], ORACLE_SQL[name])


def test_rows_and_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").count()
    want = {
        "op2_weak_toxicity": (docs, {"doc_id", "held_out", "score", "predicted"}),
        "op4_wrapper_text": (pages, {"page_id", "url", "text", "n_chars"}),
        "op6_golay_simhash": (docs, {"doc_id", "fingerprint", "component_id"}),
        "op7_kneser_ney_quality": (docs, {"doc_id", "perplexity", "threshold", "keep"}),
        "op8_url_rules": (pages, {"page_id", "host", "path", "rule", "verdict"}),
        "op9_secret_scan": (docs, {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"}),
    }
    for name, (rows, columns) in want.items():
        df = QUERIES[name](spark, FOLDER)
        assert columns <= set(df.columns) and df.count() == rows
