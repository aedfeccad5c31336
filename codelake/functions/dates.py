"""Date literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lit_like(df: DataFrame, col: str, value) -> Column:
    """A literal of the column's own type, so that the comparison reaches the scan."""
    return F.lit(value).cast(df.schema[col].dataType)


def ntz(value) -> Column:
    return F.lit(value).cast("timestamp_ntz")
