"""Numeric column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cost_estimate(inp, out, inp_price, out_price) -> Column:
    """Tokens / 1e6 times price per million, for both directions; missing price counts 0."""
    def part(tokens, price):
        return F.coalesce(F.col(tokens) / F.lit(1_000_000.0) * F.col(price), F.lit(0.0))

    return part(inp, inp_price) + part(out, out_price)


def round_half_up(col: Column, digits: int = 3) -> Column:
    """Half-up rounding toward positive infinity, also for negative values."""
    factor = float(10**digits)
    return F.floor(col * factor + F.lit(0.5)) / factor
