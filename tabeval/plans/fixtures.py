"""Inputs derived from the driver's testdata, for the oracle-checked queries.

Testdata has no patient table and no fitted models, so the fixtures are derived
from it by expressions both engines compute identically (only + - * /, which
IEEE rounds the same everywhere; no exp/log, whose last bit may differ).

- ``scored``: lineitem rows as a binary problem, y = (l_returnflag = 'R'),
  scored by three fixed "models", dataset = 'validation' for open lines
  (l_linestatus = 'O') and 'test' otherwise.
- ``lineitem_missing``: a zero discount or tax recorded as missing (NULL).
- ``events_features``: three numeric features of events, for explanations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabeval.sources.io import testdata_table

# Fixed fixture models over lineitem: (name, SQL expression).  The same text is
# evaluated by Spark and by the DuckDB oracle.
SCORE_MODELS = [
    ("quantity", "l_quantity / CAST(50.5 AS DOUBLE)"),
    ("price", "l_extendedprice / (l_extendedprice + CAST(50000.0 AS DOUBLE))"),
    ("discount", "CAST(1.0 AS DOUBLE) - l_discount * CAST(5.0 AS DOUBLE)"),
]
DATASET_SQL = "CASE WHEN l_linestatus = 'O' THEN 'validation' ELSE 'test' END"
LABEL_SQL = "CAST(l_returnflag = 'R' AS INTEGER)"

# Fixed features over events: (name, SQL expression), and the fixture models
# over them: (name, SQL expression in the feature names).  Rational functions
# only (x / (1 + |x|) instead of a logistic), for bit-equal results.
EVENT_FEATURES = [
    ("amount", "value"),
    ("uid", "CAST(user_id AS DOUBLE)"),
    ("hr", "CAST(hour(ts) AS DOUBLE)"),
]
EVENT_MODELS = [
    ("additive", "0.5 + 0.5 * ((amount - 40.0) / 40.0 + (uid - 50.0) / 50.0 - (hr - 12.0) / 12.0)"
                 " / (1.0 + abs((amount - 40.0) / 40.0 + (uid - 50.0) / 50.0 - (hr - 12.0) / 12.0))"),
    ("interact", "0.5 + 0.5 * ((amount - 40.0) * (hr - 12.0) / 480.0 + (uid - 50.0) / 100.0)"
                 " / (1.0 + abs((amount - 40.0) * (hr - 12.0) / 480.0 + (uid - 50.0) / 100.0))"),
    ("step", "CASE WHEN amount > 50.0 THEN (CASE WHEN hr < 12.0 THEN CAST(0.7071067812 AS DOUBLE) ELSE CAST(0.6180339887 AS DOUBLE) END)"
             " ELSE (CASE WHEN uid > 50.0 THEN CAST(0.3819660113 AS DOUBLE) ELSE CAST(0.2928932188 AS DOUBLE) END) END"),
]


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, model, row_id, y, p): one scan of lineitem, the models as an explode."""
    li = testdata_table(spark, sf_dir, "lineitem")
    models = F.array(*[F.struct(F.lit(name).alias("model"), F.expr(e).alias("p")) for name, e in SCORE_MODELS])
    return (li.select(F.expr(DATASET_SQL).alias("dataset"),
                      F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"),
                      F.expr(LABEL_SQL).alias("y"),
                      F.explode(models).alias("_m"))
              .select("dataset", F.col("_m.model").alias("model"), "row_id", "y", F.col("_m.p").alias("p")))


def lineitem_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = testdata_table(spark, sf_dir, "lineitem")
    return (li.withColumn("l_discount", F.when(F.col("l_discount") != 0.0, F.col("l_discount")))
              .withColumn("l_tax", F.when(F.col("l_tax") != 0.0, F.col("l_tax"))))


def events_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, amount, uid, hr) from events; row_id = event_id."""
    ev = testdata_table(spark, sf_dir, "events")
    return ev.select(F.col("event_id").alias("row_id"), *[F.expr(e).alias(n) for n, e in EVENT_FEATURES])


def scored_sql() -> str:
    """The DuckDB text of ``scored`` (without row_id), for oracle CTEs."""
    parts = [f"SELECT {DATASET_SQL} AS dataset, '{name}' AS model, {LABEL_SQL} AS y, {e} AS p FROM lineitem"
             for name, e in SCORE_MODELS]
    return " UNION ALL ".join(parts)


def events_features_sql() -> str:
    cols = ", ".join(f"{e} AS {n}" for n, e in EVENT_FEATURES)
    return f"SELECT event_id AS row_id, {cols} FROM events"


# Fixed scores over labels joined with documents (y = toxic, dataset = language).
DOC_MODELS = [
    ("length", "n_chars / (n_chars + CAST(5000.0 AS DOUBLE))"),
    ("shortness", "CAST(5000.0 AS DOUBLE) / (n_chars + CAST(5000.0 AS DOUBLE))"),
]


def scored_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, model, row_id, y, p) from labels joined with documents on doc_id;
    only doc_id, lang and n_chars are read from documents (never the text)."""
    lab = testdata_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    doc = testdata_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    j = lab.join(doc, "doc_id")
    models = F.array(*[F.struct(F.lit(n).alias("model"), F.expr(e).alias("p")) for n, e in DOC_MODELS])
    return (j.select(F.col("lang").alias("dataset"), F.col("doc_id").alias("row_id"),
                     F.col("toxic").cast("int").alias("y"), F.explode(models).alias("_m"))
             .select("dataset", F.col("_m.model").alias("model"), "row_id", "y", F.col("_m.p").alias("p")))


def scored_docs_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT d.lang AS dataset, '{n}' AS model, l.toxic::INTEGER AS y, {e} AS p "
        f"FROM labels l JOIN documents d USING (doc_id)" for n, e in DOC_MODELS)
