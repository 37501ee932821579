"""Guarded arithmetic and window helpers.  ANSI mode throws on division by zero; nothing here can."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def no_nan(c: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def full(value: Column, aggregate: Column, window: WindowSpec, n: int) -> Column:
    """``aggregate`` where the frame holds exactly ``n`` non-null values, else null."""
    return F.when(F.count(value).over(window) == n, aggregate.over(window))


def pearson(a: Column, b: Column, window: WindowSpec, n: int) -> Column:
    """Correlation over a frame with ``n`` complete pairs; null where either side does not vary."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    scale = F.sqrt(F.var_pop(x).over(window)) * F.sqrt(F.var_pop(y).over(window))
    r = no_nan(F.try_divide(F.covar_pop(x, y).over(window), scale))
    return F.when(F.count(x).over(window) == n, r)


def median(c: Column) -> Column:
    """The exact, linearly interpolated median."""
    return F.percentile(c, F.lit(0.5))


def percent_of(flag: Column, value: Column) -> Column:
    """100 * share of non-null values for which the flag holds; 0.0 without any value."""
    return F.coalesce(F.try_divide(F.lit(100.0) * F.count_if(flag), F.count(value)), F.lit(0.0))


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def half_even(c: Column, digits: int) -> Column:
    """A double rounded to ``digits`` by its exact binary value, ties to even: 0.15 to 0.1, 2.675 to 2.67, 0.25 to 0.2.

    Scaling may round what lies just beside a tie onto it; the error of that product, which is exact in doubles, tells which side it
    was.  For values below 2 ** 53 after scaling; others, which have no such digits, come back as they are.
    """
    scale = float(10**digits)
    half = lambda x: x * 134217729.0 - (x * 134217729.0 - x)  # noqa: E731  # the upper half of a double's bits
    sh = half(scale)

    def of(x: Column) -> Column:
        p, xh = x * scale, half(x)
        error = ((xh * sh - p) + xh * (scale - sh) + (x - xh) * sh) + (x - xh) * (scale - sh)
        low = F.floor(p).cast("double")
        even = F.pmod(low, F.lit(2.0)) == 0
        up = (p - low > 0.5) | ((p - low == 0.5) & ((error > 0) | ((error == 0) & ~even)))
        return F.when(F.abs(p) < 2.0**53, (low + F.when(up, 1.0).otherwise(0.0)) / scale).otherwise(x)

    # the value is bound once: it may be a long expression, and occurs a dozen times in this one
    return F.get(F.transform(F.array(c.cast("double")), lambda x: of(x)), F.lit(0))


def half_even_mean(c: Column, digits: int) -> Column:
    """The mean of doubles, ties to even by their decimal digits, as an aggregate.

    A sum of doubles depends on the order of rows, and its last bit decides a tie; here decimals of ten digits are summed.
    Values that have no such decimal (NaN, infinities) leave it to doubles.
    """
    exact = c.try_cast("decimal(28, 10)")
    mean = F.bround(F.sum(exact) / F.count(exact).cast("decimal(20, 0)"), digits).cast("double")
    return F.when(F.count(exact) == F.count(c), F.when(F.count(c) > 0, mean)).otherwise(half_even(F.avg(c), digits))
