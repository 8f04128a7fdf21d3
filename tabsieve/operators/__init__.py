"""DataFrame-level operators: what the dialect's queries do, without query text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import Typed


def project(df: DataFrame, **outputs: Typed) -> DataFrame:
    """The given expressions under the given labels, in order."""
    return df.select(*[x.column.alias(label) for label, x in outputs.items()])


def where(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(condition)


def num_rows(df: DataFrame, label: str = "num_rows") -> DataFrame:
    """The row count as a row; over Parquet it is read from the footers."""
    return df.agg(F.count(F.lit(1)).alias(label))
