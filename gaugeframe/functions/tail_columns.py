"""Tail probabilities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of Stirling's series of the log gamma function, by odd powers of 1 / z.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
#: Arguments are raised by so much before the series, which then is exact to the last digits.
RAISED = 10


def _series(z: Column) -> Column:
    out = F.lit(0.0)
    for k, c in enumerate(STIRLING):
        out = out + F.lit(c) / F.pow(z, F.lit(2.0 * k + 1.0))
    return out


def log_gamma_growth(a: Column, b: Column) -> Column:
    """ln(gamma(a + b) / gamma(a)) for positive a and b, without the cancellation of two large logarithms."""
    top = a + float(RAISED)
    raised = (top - 0.5) * F.log1p(b / top) + b * F.log(top + b) - b + _series(top + b) - _series(top)
    for i in range(RAISED):
        raised = raised - F.log1p(b / (a + float(i)))
    return raised


def log_gamma(z: Column) -> Column:
    """ln(gamma(z)) for positive z."""
    top = z + float(RAISED)
    out = (top - 0.5) * F.log(top) - top + 0.9189385332046727 + _series(top)
    for i in range(RAISED):
        out = out - F.log(z + float(i))
    return out


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, from its last term backwards; x is below its mean."""
    terms = (F.lit(300) + 4 * F.sqrt(F.greatest(a, b))).cast("int")

    def earlier(h: Column, m: Column) -> Column:
        m = m.cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.lit(1.0) + even / (F.lit(1.0) + odd / h)

    inner = F.aggregate(F.sequence(terms, F.lit(1), F.lit(-1)), F.lit(1.0), earlier)
    return 1.0 / (1.0 - (a + b) * x / (a + 1) / inner)


def f_tail(f: Column, df1: Column, df2: Column) -> Column:
    """P(F > f) of the F distribution; 1 for f of 0 or less, null where an argument is null.

    It is the incomplete beta function at df2 / (df2 + df1 f). Logarithms are taken from the ratio df1 f / df2. The fraction
    loses digits as df2 / (df2 + df1 f) comes near 1: 9 are left at 1e6 degrees of freedom of the error, 8 at 1e9.
    """
    a, b, ratio = df2 / 2.0, df1 / 2.0, df1 * f / df2
    x, rest = 1.0 / (1.0 + ratio), ratio / (1.0 + ratio)
    large, small = F.greatest(a, b), F.least(a, b)
    front = F.exp(log_gamma_growth(large, small) - log_gamma(small) - a * F.log1p(ratio) + b * (F.log(ratio) - F.log1p(ratio)))
    upper = 1.0 - front * _fraction(b, a, rest) / b
    lower = front * _fraction(a, b, x) / a
    inside = F.when(x > (a + 1) / (a + b + 2), upper).otherwise(lower)
    return F.when(f.isNull() | df1.isNull() | df2.isNull(), F.lit(None).cast("double")).when(f <= 0, 1.0).otherwise(inside)
