"""Small frame-level helpers: column roles, design columns, lookups, reshaping."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Roles:
    """What each column is: the label, categorical and continuous features, the row id.

    The reference keeps these as loose name lists and treats some columns one way
    in the balance table and another in the models; here the caller says so once.
    """
    label: str
    categorical: tuple[str, ...] = field(default_factory=tuple)
    continuous: tuple[str, ...] = field(default_factory=tuple)
    row_id: str = "row_id"

    @property
    def features(self) -> list[str]:
        return [*self.categorical, *self.continuous]


def features_of(df: DataFrame, label: str, exclude: Sequence[str] = ("row_id",)) -> list[str]:
    """Every column but the label (and the id): the model's feature list."""
    return [c for c in df.columns if c != label and c not in exclude]


def with_intercept(df: DataFrame, name: str = "const") -> DataFrame:
    """A column of ones, where a design matrix wants an explicit intercept."""
    return df.withColumn(name, F.lit(1.0))


def rows_by_id(df: DataFrame, ids: DataFrame, id_col: str = "row_id") -> DataFrame:
    """The rows whose id is in ``ids`` (a left-semi join: no duplication, no columns added)."""
    return df.join(ids.select(id_col), id_col, "left_semi")


def to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "feature",
            value: str = "value") -> DataFrame:
    """Wide to long: one (ids..., name, value) row per input row and column (``unpivot``)."""
    cols = list(columns)
    d = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols])
    return d.unpivot(list(ids), cols, name, value)
