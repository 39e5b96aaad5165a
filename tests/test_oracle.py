"""Every registered query with an oracle must give the oracle's rows (layer 1 of SURVEY §5)."""

import pytest

import __spark_entry__ as entry_mod
from compare import assert_same

# the training-data queries have their tests in tests/llm
OWN = entry_mod._llm()
QUERIES = {k: v for k, v in entry_mod.queries().items() if not OWN or k not in OWN.QUERIES}
ORACLES = {k: v for k, v in entry_mod.oracle_sql().items() if k in QUERIES}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert_same(df, duck, ORACLES[name], name)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_query_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.count() > 0
    assert len(df.columns) == len(set(df.columns))


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) == 6  # 2 datasets x 3 models
    assert all(0.0 <= r["auc"] <= 1.0 for r in rows)
