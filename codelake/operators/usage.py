"""Usage and cost ledger analytics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake.functions.dates import lit_like
from codelake.functions.numbers import cost_estimate


def time_range(df: DataFrame, col: str, from_, to) -> DataFrame:
    """Half-open range ``[from_, to)``; either end may be None.  Pushed to the scan."""
    if from_ is not None:
        df = df.filter(F.col(col) >= lit_like(df, col, from_))
    if to is not None:
        df = df.filter(F.col(col) < lit_like(df, col, to))
    return df


def usage_by_agent(ledger: DataFrame, from_, to) -> DataFrame:
    return (
        time_range(ledger, "created_at", from_, to)
        .groupBy("agent", "provider")
        .agg(
            F.sum("input_tokens").alias("input_tokens"),
            F.sum("output_tokens").alias("output_tokens"),
            F.sum("cost_usd").cast("double").alias("cost_usd"),
            F.count(F.lit(1)).alias("calls"),
        )
        .orderBy(F.desc("cost_usd"), "agent", "provider")
    )


def token_summary(ledger: DataFrame) -> DataFrame:
    return (
        ledger.groupBy("provider", "tier")
        .agg(
            F.sum("input_tokens").alias("input_tokens"),
            F.sum("output_tokens").alias("output_tokens"),
            F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        )
        .orderBy("provider", "tier")
    )


def budget_status(ledger: DataFrame, now: dt.datetime, limit: int) -> DataFrame:
    """Tokens used since the start of the UTC month; a limit of 0 means no limit."""
    start = now.replace(day=1, hour=0, minute=0, second=0, microsecond=0)
    used = F.coalesce(F.sum(F.col("input_tokens") + F.col("output_tokens")), F.lit(0))
    return (
        time_range(ledger, "created_at", start, None)
        .agg(used.alias("used"))
        .select("used", ((F.lit(limit) > 0) & (F.col("used") >= limit)).alias("exhausted"))
    )


def _daily_measures() -> list[Column]:
    return [
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("cost_usd").cast("double").alias("cost_usd"),
        F.count(F.lit(1)).alias("calls"),
        F.count_if("cache_hit").alias("cache_hits"),
    ]


def daily_cost(ledger: DataFrame) -> DataFrame:
    return (
        ledger.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day"), "provider", "tier", "agent")
        .agg(*_daily_measures())
        .orderBy(F.desc("day"), F.desc("cost_usd"), "provider", "tier", "agent")
    )


def refresh_daily(target: str, ledger: DataFrame, days: list[str]) -> None:
    """Recompute only the given days of the rollup table at ``target``.

    Dynamic partition overwrite replaces the touched day folders and no other.
    """
    touched = ledger.filter(F.date_format("created_at", "yyyy-MM-dd").isin(days))
    (
        daily_cost(touched)
        .repartition("day")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day")
        .parquet(target)
    )


def merge_daily(target: DataFrame, ledger: DataFrame, days: list[str]) -> DataFrame:
    """The rollup after a refresh of ``days``, as a query."""
    fresh = daily_cost(ledger.filter(F.date_format("created_at", "yyyy-MM-dd").isin(days)))
    return target.filter(~F.col("day").isin(days)).unionByName(fresh)


def cost_by_provider(ledger: DataFrame) -> DataFrame:
    return (
        ledger.groupBy("provider")
        .agg(F.sum("cost_usd").cast("double").alias("cost_usd"))
        .orderBy(F.desc("cost_usd"), "provider")
    )


def totals(ledger: DataFrame) -> DataFrame:
    return ledger.agg(
        F.sum("cost_usd").cast("double").alias("cost_usd"),
        F.count(F.lit(1)).alias("calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    )


PERIOD_DAYS = {"7d": 7, "30d": 30, "90d": 90}


def period(now: dt.datetime, name: str) -> tuple[dt.datetime, dt.datetime]:
    """``mtd``, ``7d``, ``30d`` or ``90d`` as a half-open range ending at ``now``."""
    if name == "mtd":
        return now.replace(day=1, hour=0, minute=0, second=0, microsecond=0), now
    return now - dt.timedelta(days=PERIOD_DAYS[name]), now


def hit_rate(ledger: DataFrame, min_rate: float = 0.20, min_n: int = 10) -> DataFrame:
    """Cache hit rate per provider; the alert needs enough samples."""
    return (
        ledger.groupBy("provider")
        .agg(F.count_if("cache_hit").alias("hits"), F.count_if(~F.col("cache_hit")).alias("misses"))
        .withColumn("rate", F.coalesce(F.try_divide("hits", F.col("hits") + F.col("misses")), F.lit(0.0)))
        .withColumn("alert", (F.col("hits") + F.col("misses") >= min_n) & (F.col("rate") < min_rate))
    )


def price_usage(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Add ``estimate``: tokens per million times the provider's price, 0 without a price.

    The price list is a catalogue of a few models; Spark picks the broadcast itself
    from its size, and sort-merges a larger one.
    """
    return usage.join(prices, "provider", "left").withColumn(
        "estimate",
        cost_estimate("input_tokens", "output_tokens", "input_per_million", "output_per_million"),
    ).drop("input_per_million", "output_per_million")
