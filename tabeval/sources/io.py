"""Reading and writing tables, fitted models and feature lists."""

from __future__ import annotations

import os

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BOM = "\ufeff"


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None,
               fmt: str | None = None, encoding: str = "UTF-8", row_id: str | None = None) -> DataFrame:
    """Read a table.  Parquet by default (by extension), CSV with a header otherwise.

    ``row_id`` names a column that holds the caller's row index (for CSV files
    written with an unnamed index column pass ``"_c0"``); it is renamed to
    ``row_id`` and cast to LONG.  NaN in double columns becomes NULL once here.
    """
    fmt = fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        _allow(spark, encoding)
        df = r.option("header", True).option("encoding", encoding).option(
            "inferSchema", schema is None).csv(path)
        if df.columns and df.columns[0].startswith(BOM):  # a BOM the reader kept
            df = df.withColumnRenamed(df.columns[0], df.columns[0][len(BOM):])
    else:
        df = r.format(fmt).load(path)
    if row_id is not None:
        df = df.withColumnRenamed(row_id, "row_id").withColumn("row_id", F.col("row_id").cast("long"))
    dbl = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    if dbl:
        df = df.select(*[F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(F.col(c)).alias(c)
                         if c in dbl else F.col(c) for c in df.columns])
    return df


# Charsets Spark refuses for CSV unless its legacy setting allows every charset of Java.
SPARK_CHARSETS = {"US-ASCII", "ISO-8859-1", "UTF-8", "UTF-16BE", "UTF-16LE", "UTF-16", "UTF-32"}


def _allow(spark: SparkSession, encoding: str) -> None:
    if encoding.upper() not in SPARK_CHARSETS:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", bom: bool = False,
                mode: str = "overwrite", encoding: str = "UTF-8") -> None:
    """Write a table; CSV gets a header, and with ``bom`` a UTF-8 byte-order mark
    (carried by the first header name, which is where a BOM sits in the file).
    ``encoding`` may be any charset Java knows, e.g. GBK."""
    if fmt == "csv":
        out = df
        if bom and df.columns:
            out = df.withColumnRenamed(df.columns[0], BOM + df.columns[0])
        _allow(df.sparkSession, encoding)
        out.write.mode(mode).option("header", True).option("encoding", encoding).csv(path)
    else:
        df.write.mode(mode).format(fmt).save(path)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_features(spark: SparkSession, features: list[str], path: str) -> None:
    """A selected-feature list as a one-column table, order kept in ``pos``."""
    spark.createDataFrame([(i, f) for i, f in enumerate(features)], "pos INT, feature STRING") \
        .coalesce(1).write.mode("overwrite").parquet(path)


def load_features(spark: SparkSession, path: str) -> list[str]:
    # a feature list is a handful of names: reading it to the driver is the point
    return [r.feature for r in spark.read.parquet(path).orderBy("pos").collect()]


def testdata_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
