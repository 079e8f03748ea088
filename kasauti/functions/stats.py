"""Evaluation statistics as columns of counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.95996
#: The same in SQL, of the expressions k and n.
WILSON_SQL = {
    "lo": "((({k}) * 1.0 / ({n})) + 1.95996 * 1.95996 / (2.0 * ({n})) - 1.95996 * sqrt((({k}) * 1.0 / ({n})) * (1 - ({k}) * 1.0 / ({n})) / ({n}) + 1.95996 * 1.95996 / (4.0 * ({n}) * ({n})))) / (1 + 1.95996 * 1.95996 / ({n}))",
    "hi": "((({k}) * 1.0 / ({n})) + 1.95996 * 1.95996 / (2.0 * ({n})) + 1.95996 * sqrt((({k}) * 1.0 / ({n})) * (1 - ({k}) * 1.0 / ({n})) / ({n}) + 1.95996 * 1.95996 / (4.0 * ({n}) * ({n})))) / (1 + 1.95996 * 1.95996 / ({n}))",
}


def wilson_sql(side: str, k: str, n: str) -> str:
    return f"round(greatest(0.0, least(1.0, {WILSON_SQL[side].format(k=k, n=n)})), 6)"


def ratio(k: Column, n: Column) -> Column:
    """Null of no cases."""
    return k / F.nullif(n, F.lit(0))


def wilson(k: Column, n: Column, side: str, z: float = Z) -> Column:
    p = k / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))
    end = (p + z * z / (2.0 * n) + (half if side == "hi" else -half)) / (1 + z * z / n)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), end))


def log_factorial(n: Column) -> Column:
    """Exact up to 256, by Stirling's series (to 1e-12) beyond."""
    x = n.cast("double")
    small = F.aggregate(F.sequence(F.lit(0), F.least(n, F.lit(256)).cast("int")), F.lit(0.0), lambda s, i: s + F.when(i > 1, F.log(i.cast("double"))).otherwise(0.0))
    series = x * F.log(x) - x + 0.5 * F.log(2 * F.pi() * x) + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5))
    return F.when(n <= 256, small).otherwise(series)


#: Deviations, and terms more, on either side of where a distribution is thick: what is left out is below 1e-14 of the sum.
WIDE, MORE = 10, 60


def mcnemar_exact(b: Column, c: Column) -> Column:
    """Two-sided binomial p of the discordant counts.

    Sums the terms from the smaller count downwards as far as they matter, so the
    sequence grows with the root of the counts.
    """
    n, k = b + c, F.least(b, c)
    term = lambda i: F.exp(log_factorial(n) - log_factorial(i) - log_factorial(n - i) - n * F.log(F.lit(2.0)))
    low = F.greatest(F.lit(0).cast("long"), k - F.ceil(WIDE * F.sqrt(n.cast("double")) / 2) - MORE)
    tail = F.aggregate(F.sequence(low, k), F.lit(0.0), lambda s, i: s + term(i))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def mcnemar_chi2(b: Column, c: Column) -> Column:
    """With continuity correction; null without discordant pairs."""
    return F.pow(F.abs(b - c) - 1, F.lit(2)) / F.nullif(b + c, F.lit(0))


def kappa(observed: Column, expected: Column) -> Column:
    return (observed - expected) / F.nullif(1 - expected, F.lit(0.0))
