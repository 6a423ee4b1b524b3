"""Costs, penalties and the objective in exact decimals."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The default weights and scales of the objective and the penalty of an unconnected consumer.
COST_PER_UNIT = "0.000000028"  # 0.7 / 25 000 000
LENGTH_PER_UNIT = "0.003"  # 0.3 / 100
PENALTY_FIXED = 100_000_000
PENALTY_PER_FLOW = 500_000
NORMAL_DEPTH = 3.0
DEPTH_RATE = 0.05


def money(value: Column) -> Column:
    return F.round(value, 2).cast("decimal(20,2)")


def piece_cost(length: Column, price: Column, factor: Column) -> Column:
    """length decimal(18,9) x price decimal(12,2) x factor decimal(4,2), rounded half up to cents."""
    return money(length.cast("decimal(12,3)") * price.cast("decimal(12,2)") * factor.cast("decimal(4,2)"))


def penalty(flow: Column) -> Column:
    return money(F.lit(PENALTY_FIXED).cast("decimal(12,0)") + flow.cast("decimal(12,2)") * F.lit(PENALTY_PER_FLOW).cast("decimal(8,0)"))


def score(cost: Column, length: Column) -> Column:
    """0.7 x cost / 25e6 + 0.3 x length / 100; both quotients are finite decimals. Cost and length are sums of networks."""
    return (cost.cast("decimal(24,2)") * F.lit(COST_PER_UNIT).cast("decimal(10,9)") + length.cast("decimal(28,9)") * F.lit(LENGTH_PER_UNIT).cast("decimal(4,3)")).cast("decimal(28,12)")


def depth_factor(a: Column, b: Column) -> Column:
    """What digging below the normal depth adds to the price of a piece with depths a and b at its ends."""
    return 1 + F.lit(DEPTH_RATE) * (F.greatest(F.lit(0.0), a - NORMAL_DEPTH) + F.greatest(F.lit(0.0), b - NORMAL_DEPTH))
