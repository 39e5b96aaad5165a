"""Plan shape: scans read only the needed columns, filters reach the scan, and the
range-cut ordered sums partition their windows by (key, range)."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as entry_mod
from tabeval.operators import cumulative as cu


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_model_table_scan_is_pruned(spark, sf_dir):
    df = entry_mod.queries()["model_table"](spark, sf_dir)
    # the scored table was reduced and checkpointed; look at the reduction itself
    from tabeval.plans import fixtures as fx
    p = fx.scored(spark, sf_dir).groupBy("dataset", "model", "p").count()
    text = plan_text(p)
    schemas = set(re.findall(r"ReadSchema: (struct<[^>]*>)", p._jdf.queryExecution().executedPlan().treeString()))
    for s in schemas:
        assert "l_orderkey" not in s and "l_shipdate" not in s and "l_tax" not in s, s
    assert "FileScan parquet" in text
    assert df.count() == 6


def test_filters_reach_the_scan(spark, sf_dir):
    df = entry_mod.queries()["value_counts"](spark, sf_dir)
    tree = df._jdf.queryExecution().executedPlan().treeString()
    assert "PushedFilters: [IsNotNull(o_orderpriority)]" in tree
    assert "ReadSchema: struct<o_orderpriority:string>" in tree


def test_range_cut_windows_are_keyed_by_range(spark):
    d = spark.range(2000).select(F.lit("m").alias("model"), (F.col("id") % 97).cast("double").alias("p"),
                                 F.lit(1).alias("pos"))
    d = d.groupBy("model", "p").agg(F.sum("pos").alias("pos"))
    out = cu.prefix_sums(d, ["model"], "p", ["pos"], levels=1, n_buckets=4)
    logical = out._jdf.queryExecution().optimizedPlan().toString()
    # the row-level window is partitioned by the key and the range, never by the key alone
    row_windows = re.findall(r"Window \[.*?\], \[([^\]]*)\], \[[^\]]*p#", logical)
    assert row_windows and all("_bucket" in w for w in row_windows)


def test_join_source_never_reads_document_text(spark, sf_dir):
    from tabeval.plans import fixtures as fx
    tree = fx.scored_docs(spark, sf_dir)._jdf.queryExecution().executedPlan().treeString()
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", tree)
    assert any("n_chars" in s for s in schemas)
    assert all("text" not in s for s in schemas)


def test_large_plan_deals_no_rows_out_by_a_few_keys(spark, sf_dir):
    """With automatic broadcasts off, as for a large input: no exchange of raw rows on the strata
    or on (dataset, model); the small sides are broadcast because they were counted."""
    from tabeval.operators import evaluate as ev
    from tabeval.operators import split as sp
    from tabeval.plans import fixtures as fx
    from tabeval.sources.io import testdata_table as read
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        s = sp.stratified_split(read(spark, sf_dir, "orders"), "o_orderstatus", id_col="o_orderkey")
        text = plan_text(s)
        assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text
        c = ev.roc_curve(fx.scored(spark, sf_dir))
        text = plan_text(c)
        assert "SortMergeJoin" not in text
        # the row-level windows are dealt out by (keys, range)
        by = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
        assert by and any("_bucket" in b for b in by)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_univariable_screen_reads_its_table_a_fixed_number_of_times(spark, sf_dir, monkeypatch):
    from tabeval.operators import select as se
    from tabeval.plans import q_models as qm
    writes = []
    original = se.materialize
    monkeypatch.setattr(se, "materialize", lambda df, name: writes.append(name) or original(df, name))
    d = qm.lineitem_problem(spark, sf_dir)
    se.univariable_logit(d, "y", qm.LINE_FEATURES[:1])
    se.univariable_logit(d, "y", qm.LINE_FEATURES)
    assert writes == ["design", "design"]   # one read each, whatever the number of candidates
