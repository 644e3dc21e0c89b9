"""Slippage, market impact and execution cost as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LegCosts:
    """Cost assumptions of one leg."""

    slippage_bps: float
    venue_bps: float
    small_threshold: float
    threshold_on_value: bool
    small_bps: float
    large_bps: float
    fixed: float
    percentage: float
    impact_sqrt: float = 0.1
    impact_square: float = 0.001
    impact_cap: float = 0.05
    atr_multiple: float = 0.5
    volume_multiple: float = 0.3


# Default cost assumptions of the two legs and order types.
FX = LegCosts(1.0, 0.5, 1_000_000.0, True, 0.5, 2.0, 0.0001, 0.00001)
COMMODITY = LegCosts(2.0, 1.5, 100.0, False, 0.5, 2.0, 1.0, 0.00001)
ORDER_FACTORS = {"market": 2.0, "limit": 0.5, "peg": 1.0}


def _lift(base: Column, other: Column, when: Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.greatest(base, other)).otherwise(base)


def market_impact(quantity: Column, price: Column, leg: LegCosts) -> Column:
    q = F.abs(quantity)
    raw = leg.impact_sqrt * F.sqrt(q) * price + leg.impact_square * q * q * price
    return F.least(raw, price * leg.impact_cap)


def slippage(
    price: Column, quantity: Column, leg: LegCosts, order_type: str = "limit",
    atr: Column | None = None, volume: Column | None = None,
) -> Column:
    """Per-unit slippage; ATR and volume, where known, only ever raise it."""
    bps = leg.venue_bps + leg.slippage_bps * ORDER_FACTORS.get(order_type, 1.0)
    out = price * (bps / 10_000) + market_impact(quantity, price, leg)
    if atr is not None:
        out = _lift(out, atr * leg.atr_multiple, atr > 0)
    if volume is not None:
        thin = F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.try_divide(F.lit(1_000_000.0), volume)))
        out = _lift(out, out * thin * leg.volume_multiple, volume > 0)
    return out


def execution_price(price: Column, quantity: Column, slip: Column) -> Column:
    return price + F.signum(quantity) * slip


def leg_cost(price: Column, quantity: Column, slip: Column, leg: LegCosts) -> Column:
    """Slippage plus tiered, fixed and percentage charges for one leg."""
    value = F.abs(quantity * price)
    measure = value if leg.threshold_on_value else F.abs(quantity)
    tier = F.when(measure <= leg.small_threshold, leg.small_bps / 10_000).otherwise(leg.large_bps / 10_000)
    return slip * F.abs(quantity) + value * tier + leg.fixed + value * leg.percentage


def total_cost(
    fx_price: Column, comd_price: Column, fx_quantity: Column, comd_quantity: Column, order_type: str = "limit"
) -> Column:
    fx_slip = slippage(fx_price, fx_quantity, FX, order_type)
    comd_slip = slippage(comd_price, comd_quantity, COMMODITY, order_type)
    return leg_cost(fx_price, fx_quantity, fx_slip, FX) + leg_cost(comd_price, comd_quantity, comd_slip, COMMODITY)
