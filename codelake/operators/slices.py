"""Ordered operations inside a key, without ever putting one key into one task.

A window partitioned by a key alone sends all rows of that key to one task, so a
key with a third of the rows sets the run time.  Every helper here takes a
``slice`` column: a value computed from the row that never decreases along the
order (a day, an id range).  Rows are shuffled by (key, slice); one small summary
row per (key, slice) is accumulated over the earlier slices and joined back.
The slice comes from the data, so a recomputed task sees the same slices.

A calendar day is a slice only where no key has too many rows in one day.  ``ranged`` has
no such limit: it cuts (key, order) at sampled quantiles, so the rows of any key, even of
one instant, spread over tasks as evenly as the table does.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelake.session import checkpoint

SLICE, RANGE = "_slice", "_range"


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows, written, with the number of their range in (keys, order).

    Bounds are sampled quantiles, one range for each shuffle partition.  The number is
    stored with the row, so whatever is recomputed later sees the same ranges.  A key that
    lies in one range has one slice; at most as many keys as there are ranges have more.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpoint(df.repartitionByRange(parts, *keys, *order).withColumn(RANGE, F.spark_partition_id()))


def by_range() -> Column:
    """Slice by the range that ``ranged`` has stored."""
    return F.col(RANGE)


def day_slice(ts: str) -> Column:
    """Slice by calendar day."""
    return F.to_date(F.col(ts))


def id_slice(col: str, width: int = 4096) -> Column:
    """Slice by fixed-width id range."""
    return F.floor(F.col(col) / width)


def _local(keys: Sequence[str], order: Sequence) -> Window:
    return Window.partitionBy(*keys, SLICE).orderBy(*order)


def join_keys(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns of which some may be null: the rows of a null key are one key's."""
    other = right.select(*[F.col(c).alias(f"_right_{c}") if c in on else F.col(c) for c in right.columns])
    match = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in on])
    return left.join(other, match, how).drop(*[f"_right_{c}" for c in on])


def _carried(df: DataFrame, keys: Sequence[str], summary: dict[str, Column], carry: dict) -> DataFrame:
    """One row per (key, slice): ``summary`` aggregates, then ``carry`` over earlier slices."""
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    per_slice = df.groupBy(*keys, SLICE).agg(*[c.alias(n) for n, c in summary.items()])
    return per_slice.select(*keys, SLICE, *[fn(earlier).alias(n) for n, fn in carry.items()])


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence, value: str, out: str, slice_by: Column) -> DataFrame:
    """Inclusive running sum of ``value`` (ROWS UNBOUNDED PRECEDING)."""
    df = df.withColumn(SLICE, slice_by)
    carry = _carried(df, keys, {"_t": F.sum(value)}, {"_carry": lambda w: F.sum("_t").over(w)})
    frame = _local(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        join_keys(df, carry, [*keys, SLICE])
        .withColumn(out, F.coalesce(F.sum(value).over(frame), F.lit(0)) + F.coalesce("_carry", F.lit(0)))
        .drop(SLICE, "_carry")
    )


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence, out: str, slice_by: Column) -> DataFrame:
    """Dense 1-based position of every row within its key."""
    df = df.withColumn(SLICE, slice_by)
    carry = _carried(df, keys, {"_n": F.count(F.lit(1))}, {"_carry": lambda w: F.sum("_n").over(w)})
    return (
        join_keys(df, carry, [*keys, SLICE])
        .withColumn(out, F.row_number().over(_local(keys, order)) + F.coalesce("_carry", F.lit(0)))
        .drop(SLICE, "_carry")
    )


def neighbour(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, out: str,
              slice_by: Column, ahead: bool = False) -> DataFrame:
    """``lag`` (or ``lead`` with ``ahead``) of ``col`` by one row."""
    df = df.withColumn(SLICE, slice_by)
    boxed = F.struct(F.col(col).alias("v"))
    rank = F.struct(*order)
    if ahead:
        pick, shift, frame = F.min_by, F.lead, Window.partitionBy(*keys).orderBy(SLICE)
        carried = {"_next": lambda w: F.lead("_edge").over(frame)}
    else:
        pick, shift, frame = F.max_by, F.lag, Window.partitionBy(*keys).orderBy(SLICE)
        carried = {"_next": lambda w: F.lag("_edge").over(frame)}
    carry = _carried(df, keys, {"_edge": pick(boxed, rank)}, carried)
    local = shift(boxed).over(_local(keys, order))
    return (
        join_keys(df, carry, [*keys, SLICE])
        .withColumn(out, F.coalesce(local, F.col("_next"))["v"])
        .drop(SLICE, "_next")
    )


def last_known(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, out: str,
               slice_by: Column, inclusive: bool = True) -> DataFrame:
    """Last non-null ``col`` at or before (or strictly before) each row."""
    df = df.withColumn(SLICE, slice_by)
    rank = F.when(F.col(col).isNotNull(), F.struct(*order))
    carry = _carried(
        df, keys, {"_last": F.max_by(col, rank)},
        {"_carry": lambda w: F.last("_last", ignorenulls=True).over(w)},
    )
    frame = _local(keys, order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return (
        join_keys(df, carry, [*keys, SLICE])
        .withColumn(out, F.coalesce(F.last(col, ignorenulls=True).over(frame), F.col("_carry")))
        .drop(SLICE, "_carry")
    )


def trailing_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, n: int,
                  slice_by: Column, sum_out: str, count_out: str, block: int = 65536) -> DataFrame:
    """Sum and count of ``value`` over the last ``n`` rows of the key, this row included.

    Rows are numbered, cut into blocks of ``block`` rows, and the last ``n - 1`` rows
    of a block are copied into the next block as its lead-in.
    """
    if n > block:
        raise ValueError("the trailing frame must fit into one block")
    numbered = row_numbers(df, keys, order, "_pos", slice_by)
    own = numbered.withColumn("_block", F.floor((F.col("_pos") - 1) / block)).withColumn("_own", F.lit(True))
    in_tail = (F.col("_pos") - 1) % block >= block - (n - 1)
    lead_in = (
        own.filter(in_tail).withColumn("_block", F.col("_block") + 1).withColumn("_own", F.lit(False))
    )
    frame = Window.partitionBy(*keys, "_block").orderBy("_pos").rowsBetween(-(n - 1), 0)
    return (
        own.unionByName(lead_in)
        .withColumn(sum_out, F.sum(value).over(frame))
        .withColumn(count_out, F.count(F.lit(1)).over(frame))
        .filter("_own")
        .drop("_pos", "_block", "_own")
    )
