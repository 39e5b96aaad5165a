"""Presentation of results for comparison: doubles rounded to 6 places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every DOUBLE/FLOAT column to ``places``; other columns unchanged."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            out.append(F.round(F.col(f.name).cast("double"), places).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
