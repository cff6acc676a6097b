"""Exact money arithmetic that stays in long registers.

The tables hold money as doubles with two decimals. Adding doubles gives a sum
that depends on row order, and adding wide decimals costs about five times as
much as adding longs. So amounts become integer units (1/100, 1/10,000, ...),
and a sum is kept as two long sums: the low 20 bits and the rest. Neither can
overflow below about 8e12 rows, and both use map-side partial aggregation. The
two halves meet once per group, in decimal arithmetic.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW_BITS = 20


def hundredths(amount: Column | str) -> Column:
    """A two-decimal double as a long number of hundredths. Further decimals are rounded away."""
    amount = F.col(amount) if isinstance(amount, str) else amount
    return F.rint(amount * 100).cast("long")


def net_units(price: str = "l_extendedprice", discount: str = "l_discount") -> Column:
    """price * (1 - discount) in 1/10,000."""
    return hundredths(price) * (F.lit(100) - hundredths(discount))


def charge_units(tax: str = "l_tax") -> Column:
    """price * (1 - discount) * (1 + tax) in 1/1,000,000."""
    return net_units() * (F.lit(100) + hundredths(tax))


def exact_total(units: Column) -> Column:
    """Aggregate: the sum of a long column as a decimal, whatever its size."""
    low = F.sum(units.bitwiseAND(F.lit((1 << _LOW_BITS) - 1))).cast("decimal(20,0)")
    high = F.sum(F.shiftright(units, _LOW_BITS)).cast("decimal(20,0)")
    return high * F.lit(Decimal(1 << _LOW_BITS)) + low


def as_double(total: Column, decimals: int) -> Column:
    """Units of 10**-decimals as the nearest double."""
    return (total * F.lit(Decimal(1).scaleb(-decimals))).cast("double")


def exact_sum(units: Column, decimals: int) -> Column:
    """Aggregate: the sum of a long column of 10**-decimals units, as a double."""
    return as_double(exact_total(units), decimals)
