"""Places of rows in a total order, and joins that a hot key doesn't slow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelake.llm.common import saved, tasks


def placed(rows: DataFrame, group: str, by: list[Column | str]) -> DataFrame:
    """The rows with ``position``, 0 and up within each value of ``group`` in the order of ``by``, and ``size``, the group's rows.

    ``group`` isn't null and the order is group first, then ``by``.  Ranges of the order go to
    tasks by sampled bounds, so a hot group spreads; one small row for each group of a task
    tells how many rows come before it.  Rows equal in all of ``by`` stay in one task.
    """
    ordered = rows.repartitionByRange(tasks(rows.sparkSession), group, *by).sortWithinPartitions(group, *by)
    # both numbers are written with the row: a lost task makes its whole file again, nothing reads a second run
    number = F.monotonically_increasing_id()
    ordered = saved(ordered.select("*", F.shiftright(number, 33).alias("_task"), number.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))
    held = ordered.groupBy(group, "_task").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(group, "_task", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(Window.partitionBy(group)).alias("size"))
    out = ordered.join(held, [group, "_task"])
    return out.select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias("position"), "size")


#: A key with more than this share of the rows is heavy; so there are at most as many heavy keys.
HEAVY = 1000


def attached(rows: DataFrame, values: DataFrame, key: str, copies: str, n_rows: int) -> DataFrame:
    """``rows`` with the columns of ``values``, which has one row for each ``key`` of ``rows`` and their number in ``copies``.

    Keys that hold over a thousandth of ``n_rows`` are under a thousand, whatever the table's
    size: they are broadcast, and only the other rows are shuffled.
    """
    heavy = F.col(copies) > F.lit(n_rows / HEAVY)
    named = [c for c in values.columns if c not in (key, copies)]
    marked = rows.join(F.broadcast(values.filter(heavy).select(key, F.lit(True).alias("_heavy"))), key, "left")
    # written: what is heavy is decided once
    marked = saved(marked)
    many = marked.filter("_heavy").join(F.broadcast(values.filter(heavy)), key)
    few = marked.filter("_heavy IS NULL").join(values.filter(~heavy), key)
    columns = [*rows.columns, *named]
    return few.select(*columns).unionByName(many.select(*columns))
