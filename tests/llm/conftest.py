"""Uses the session of tests/conftest.py; small helpers for made-up tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = os.environ.get("TABEVAL_TEST_SF", "/root/testdata/sf0.001")

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows):
        rows = [(*r, None, None, None)[:5] if len(r) < 5 else r for r in rows]
        return spark.createDataFrame(rows, DOC_SCHEMA)
    return make


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
