"""Numeric kernels as column expressions (all of them compile into one stage)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.fixed_values import ERF_A, ERF_P


def norm_cdf(x: Column) -> Column:
    """Standard normal distribution function from the five-term erf polynomial."""
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * z)
    # Horner's scheme, highest coefficient first.
    poly = reduce(lambda acc, a: acc * t + F.lit(a), reversed(ERF_A[:-1]), F.lit(ERF_A[-1]))
    erf = F.lit(1.0) - poly * t * F.exp(-z * z)
    return (F.lit(1.0) + F.when(x >= 0, erf).otherwise(-erf)) * 0.5


def black_scholes_terms(
    spot: Column, strike: Column, expiry: Column, rate: Column, volatility: Column
) -> tuple[Column, Column]:
    spread = volatility * F.sqrt(expiry)
    drift = (rate + volatility * volatility * 0.5) * expiry
    upper = (F.log(spot / strike) + drift) / spread
    return upper, upper - spread


def geometric_mean(value: Column) -> Column:
    """Aggregate: geometric mean of the positive values, 1.0 when there are none."""
    return F.coalesce(F.exp(F.avg(F.when(value > 0, F.log(value)))), F.lit(1.0))


# FIXED VALUES: display units, largest first, with their size in seconds.
DISPLAY_UNITS = [("sec", 1.0), ("ms", 1e-3), ("us", 1e-6), ("ns", 1e-9)]


def display_unit(seconds: Column) -> Column:
    """The largest display unit that does not exceed the value; ns for anything smaller."""
    *larger, (smallest, _) = DISPLAY_UNITS
    unit = F.lit(smallest)
    for name, size in reversed(larger):
        unit = F.when(seconds >= size, F.lit(name)).otherwise(unit)
    return unit


def in_unit(seconds: Column, unit: Column) -> Column:
    sizes = F.create_map(*[F.lit(x) for pair in DISPLAY_UNITS for x in pair])
    return seconds / F.element_at(sizes, unit)
