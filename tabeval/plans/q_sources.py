"""Registered source and sink queries (S1-S7): each writes a table of the testdata and
reads it back; the table itself is the oracle."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tabeval.operators import select as se
from tabeval.plans import q_models
from tabeval.plans.queries import register
from tabeval.plans.report import rounded
from tabeval.session import checkpoint_dir
from tabeval.sources import io
from tabeval.sources.io import testdata_table

CUSTOMER_SQL = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def _path(spark, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def _customer(spark, sf_dir):
    return testdata_table(spark, sf_dir, "customer").select(*COLUMNS)


def _csv(spark, sf_dir, **how):
    df, path = _customer(spark, sf_dir), _path(spark, "csv")
    io.write_table(df, path, "csv", **how)
    return io.read_table(spark, path, df.schema, "csv", encoding=how.get("encoding", "UTF-8"))


@register("csv_round_trip", CUSTOMER_SQL)
def q_csv(spark, sf_dir):
    return _csv(spark, sf_dir)


@register("csv_bom_round_trip", CUSTOMER_SQL)
def q_csv_bom(spark, sf_dir):
    return _csv(spark, sf_dir, bom=True)


@register("csv_gbk_round_trip", "SELECT c_custkey, c_name, concat(c_mktsegment, ' ', chr(20013), chr(25991)) AS segment FROM customer")
def q_csv_gbk(spark, sf_dir):
    """A file in GBK with text beyond ASCII."""
    df = testdata_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", F.concat("c_mktsegment", F.lit(" \u4e2d\u6587")).alias("segment"))
    path = _path(spark, "gbk")
    io.write_table(df, path, "csv", encoding="GBK")
    return io.read_table(spark, path, df.schema, "csv", encoding="GBK")


@register("csv_index_round_trip", "SELECT c_custkey AS row_id, c_name, c_acctbal FROM customer")
def q_csv_index(spark, sf_dir):
    """A file whose first, unnamed column is the row index."""
    df = testdata_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(""), "c_name", "c_acctbal")
    path = _path(spark, "index")
    io.write_table(df, path, "csv")
    return io.read_table(spark, path, None, "csv", row_id="_c0")


@register("parquet_round_trip", CUSTOMER_SQL)
def q_parquet(spark, sf_dir):
    df, path = _customer(spark, sf_dir), _path(spark, "table") + ".parquet"
    io.write_table(df, path)
    return io.read_table(spark, path)


@register("feature_list_round_trip", "SELECT feature FROM (VALUES ('l_quantity'), ('l_extendedprice'), ('l_discount'), "
          "('l_tax')) t(feature) WHERE (SELECT count(*) FROM lineitem) > 0")
def q_feature_list(spark, sf_dir):
    """Numeric columns of lineitem as a saved and loaded feature list."""
    li = testdata_table(spark, sf_dir, "lineitem")
    names = [f.name for f in li.schema.fields if f.dataType.typeName() == "double" and f.name in q_models.LINE_FEATURES]
    path = _path(spark, "features")
    io.save_features(spark, names, path)
    loaded = io.load_features(spark, path)
    return spark.createDataFrame([(f,) for f in loaded], "feature STRING")


@register("model_round_trip")
def q_model(spark, sf_dir):
    """A fitted model saved, loaded, and used to score the test rows."""
    d = q_models.orders_problem(spark, sf_dir)
    m = se.fit_logistic(d.where(F.col("split") == "train"), "y", q_models.ORDER_FEATURES)
    path = _path(spark, "model")
    io.save_model(m, path)
    return rounded(io.load_model(path).transform(d.where(F.col("split") == "test")).select("row_id", "y", "p"))
