"""Tail probabilities as columns: regularised incomplete gamma and beta functions, and the tests that read them.

Series and continued fractions stop at a number of terms that their arguments fix:
what both need grows with the root of the larger parameter. Fractions are evaluated
from the last term to the first, so nothing but one number is carried. A null
argument gives null. Relative errors stay below 1e-9 for parameters up to 10,000.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Arguments are raised by this much before Stirling's series, whose error is then below 1e-13.
RAISED = 8
#: Terms for small parameters, and more for each unit of the root of a parameter.
TERMS, MORE = 120, 10


def _number(x: Column | float) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def _once(f: Callable[..., Column], *given: Column) -> Column:
    """``f`` of columns that stand in the plan once, however often ``f`` names them."""
    row = F.struct(*[g.alias(f"g{i}") for i, g in enumerate(given)])
    return F.get(F.transform(F.array(row), lambda v: f(*[v[f"g{i}"] for i in range(len(given))])), F.lit(0))


def _correction(x: Column) -> Column:
    """What Stirling's series adds to (x - 1/2) log x - x + log(2 pi) / 2."""
    y = 1 / (x * x)
    return (1 / 12.0 - y * (1 / 360.0 - y * (1 / 1260.0 - y * (1 / 1680.0 - y / 1188.0)))) / x


def log_gamma(x: Column) -> Column:
    """Of positive numbers."""
    x = _number(x)
    up = x + RAISED
    product = x
    for i in range(1, RAISED):
        product = product * (x + i)
    return (up - 0.5) * F.log(up) - up + 0.5 * math.log(2 * math.pi) + _correction(up) - F.log(product)


def log_beta(a: Column, b: Column) -> Column:
    """log of gamma(a) gamma(b) / gamma(a + b); the quotient of the larger one is taken as a whole, so that nothing large cancels."""
    low, high = F.least(_number(a), _number(b)), F.greatest(_number(a), _number(b))
    up, quotient = high + RAISED, F.lit(1.0)
    for i in range(RAISED):
        quotient = quotient * (1 + low / (high + i))
    falls = low - low * F.log(up + low) - (up - 0.5) * F.log1p(low / up) + _correction(up) - _correction(up + low)
    return log_gamma(low) + falls + F.log(quotient)


def _terms(size: Column) -> Column:
    return F.lit(TERMS) + F.ceil(MORE * F.sqrt(size)).cast("int")


def _fraction(terms: Column, inner: Callable[[Column, Column], Column]) -> Column:
    """The value that ``inner(below, n)`` reaches from the last term to the first."""
    return F.aggregate(F.sequence(terms, F.lit(1), F.lit(-1)), F.lit(0.0), lambda below, n: inner(below, n.cast("double")))


def upper_gamma(a: Column | float, x: Column) -> Column:
    """Regularised upper incomplete gamma function, a > 0; 1 where x <= 0."""
    return _once(_upper_gamma, _number(a), _number(x))


def _upper_gamma(a: Column, x: Column) -> Column:
    scale = F.exp(a * F.log(x) - x - log_gamma(a))
    # Lower part: 1/a (1 + x/(a+1) (1 + x/(a+2) (1 + ...))), innermost bracket first.
    lower = scale / a * (1 + _fraction(_terms(F.greatest(a, x)), lambda below, n: x / (a + n) * (1 + below)))
    upper = scale / (x + 1 - a - _fraction(_terms(a), lambda below, n: n * (n - a) / (x + 2 * n + 1 - a - below)))
    return F.when(x <= 0, 1.0).when(x < a + 1, 1 - lower).when(x >= a + 1, upper)


def _beta_part(a: Column, b: Column, x: Column, y: Column) -> Column:
    """The incomplete beta function where x is at most about its mean; y is 1 - x."""

    def pair(below: Column, n: Column) -> Column:
        # Coefficients 2n - 1 and 2n of the fraction at once.
        m = n - 1
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        even = n * (b - n) * x / ((a + 2 * n - 1) * (a + 2 * n))
        return odd / (1 + even / (1 + below))

    scale = F.exp(a * F.log(x) + b * F.log(y) - log_beta(a, b)) / a
    return scale / (1 + _fraction(_terms(F.greatest(a, b)), pair))


def regular_beta(a: Column | float, b: Column | float, x: Column, y: Column | None = None) -> Column:
    """Regularised incomplete beta function of 0 <= x <= 1; ``y`` is 1 - x, where the caller has it without rounding."""
    x = _number(x)
    return _once(_regular_beta, _number(a), _number(b), x, 1 - x if y is None else _number(y))


def _regular_beta(a: Column, b: Column, x: Column, y: Column) -> Column:
    near = x <= (a + 1) / (a + b + 2)
    return F.when(x <= 0, 0.0).when(y <= 0, 1.0).when(near, _beta_part(a, b, x, y)).when(~near, 1 - _beta_part(b, a, y, x))


def chi2_tail(statistic: Column, freedom: Column | float) -> Column:
    """Probability of a larger value of the chi-square distribution."""
    return upper_gamma(_number(freedom) / 2, _number(statistic) / 2)


def t_two_sided(t: Column, freedom: Column | float) -> Column:
    """Probability of a value of Student's distribution further from 0; null without degrees of freedom."""
    return _once(lambda t, v: F.when(v > 0, regular_beta(v / 2, F.lit(0.5), v / (v + t * t), t * t / (v + t * t))), _number(t), _number(freedom))
