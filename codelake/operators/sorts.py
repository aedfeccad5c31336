"""Stable priority orders with their positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake.operators import slices


def tier_key(preferred: Column) -> Column:
    """0 for the preferred class, 1 for the rest."""
    return F.when(preferred, F.lit(0)).otherwise(F.lit(1))


def explicit_key(id_col: str, ids: Sequence) -> Column:
    """Position in the list, or one past its end for unlisted ids."""
    key = F.lit(len(ids))
    for pos, wanted in reversed(list(enumerate(ids))):
        key = F.when(F.col(id_col) == F.lit(wanted), F.lit(pos)).otherwise(key)
    return key


def positions(df: DataFrame, priority: Column, original: str, width: int = 65536) -> DataFrame:
    """0-based position under (priority, original order), without a single-task sort.

    The slice is the priority class followed by the id range inside it.
    """
    df = df.withColumn("_p", priority)
    key = F.struct(F.col("_p"), F.floor(F.col(original) / width))
    return (
        slices.row_numbers(df.withColumn("_all", F.lit(0)), ["_all"], ["_p", original], "pos", key)
        .withColumn("pos", F.col("pos") - 1)
        .drop("_all", "_p")
        .orderBy("pos")
    )
