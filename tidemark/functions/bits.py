"""Doubles as whole numbers in the same order, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Types that are whole numbers already.
WHOLE = ("tinyint", "smallint", "int", "bigint")


def ordered(x: Column) -> Column:
    """The double ``x`` as a whole number in the same order: the bits of |x|, negated below 0. -0.0 is 0;
    null and NaN give null. The bits are made by exact arithmetic, so they stay in compiled code: the
    exponent from a logarithm put right by a comparison, the mantissa by a division by a power of two."""
    d = x.cast("double")
    a = F.abs(d)
    two = F.lit(2.0)
    near = F.floor(F.log2(a)).cast("int")
    power = F.pow(two, near)
    e = near + F.when(a < power, -1).when(a >= power * 2, 1).otherwise(0)
    m = ((a / F.pow(two, e) - 1) * F.lit(2.0**52)).cast("long")
    normal = F.shiftleft((e + 1023).cast("long"), 52) + m
    bits = F.when(a < F.lit(2.0**-1022), (a * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")).when(a == F.lit(float("inf")), F.lit(2047 << 52)).otherwise(normal)
    return F.when(d.isNull() | F.isnan(d), None).when(d < 0, -bits).otherwise(bits)


def ordered_whole(x: Column) -> Column:
    """``ordered`` of a whole number: the same bits by shifts, without powers, up to 2**53."""
    left = lambda v, n: F.call_function("shiftleft", v, n)
    a = F.abs(x.cast("double"))
    k = a.cast("long")
    near = F.floor(F.log2(a)).cast("int")
    one = F.lit(1).cast("long")
    e = near + F.when(k < left(one, near), -1).when(k >= left(one, near + 1), 1).otherwise(0)
    bits = F.shiftleft((e + 1023).cast("long"), 52) + left(k - left(one, e), 52 - e)
    signed = F.when(x < 0, -bits).otherwise(bits)
    return F.when(x == 0, F.lit(0).cast("long")).when(a < F.lit(2.0**53), signed).otherwise(ordered(x))


def order_bits(df: DataFrame, column: str) -> Column:
    """The order-preserving bits of a column of ``df``, in the cheapest way that its type allows."""
    whole = df.schema[column].dataType.simpleString() in WHOLE
    return ordered_whole(F.col(column)) if whole else ordered(F.col(column))


def value_of(key: Column) -> Column:
    """The double that ``ordered`` made ``key`` of."""
    a = F.abs(key)
    e = F.shiftright(a, 52).cast("int")
    m = F.pmod(a, F.lit(1 << 52))
    v = F.when(e == 2047, F.lit(float("inf"))).when(e == 0, m * F.lit(2.0**-537) * F.lit(2.0**-537)).otherwise((1.0 + m / F.lit(4503599627370496.0)) * F.pow(F.lit(2.0), e - 1023))
    return F.when(key < 0, -v).otherwise(v)
