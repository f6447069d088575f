"""Checks shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require_columns(df: DataFrame, *names: str) -> None:
    """Fail on an unknown column, naming the first five available ones."""
    for name in names:
        if name not in df.columns:
            raise ValueError(f"Column '{name}' not found. Available columns: {', '.join(df.columns[:5])}...")


def is_missing(df: DataFrame, name: str):
    """Null, or NaN for floating types, the way a data-frame library counts missing cells."""
    col = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def present(df: DataFrame, name: str):
    """The column with NaN turned into null."""
    return F.when(~is_missing(df, name), F.col(f"`{name}`"))


def posexploded(df: DataFrame, keep: list, array: Column, pos: str, item: str) -> DataFrame:
    """Kept columns with one row per array element, its 0-based position and the element.

    A plain ``posexplode`` of a computed array makes Spark test its size first, which computes
    the array twice; the outer form does not, and its row for an empty array is left out again.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, item)).where(F.col(pos).isNotNull())
    return rows.withColumn(pos, F.col(pos).cast("long"))


def fits(df: DataFrame, rows: int) -> bool:
    """True when ``df`` has at most ``rows`` rows; reads no more than that many."""
    return df.limit(rows + 1).count() <= rows
