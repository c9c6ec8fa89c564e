"""Closed-form statistics as Column expressions over aggregated columns."""

from __future__ import annotations

from math import lgamma, log

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(num: Column, den: Column, eps: float = 1e-8) -> Column:
    """num / den, null where the denominator is (almost) zero."""
    return F.when(F.abs(den) > eps, F.try_divide(num, den))


def signed_ratio(num: Column, den: Column, eps: float = 1e-9) -> Column:
    """num / den with a tiny denominator moved off zero in its own direction."""
    moved = F.when(F.abs(den) < eps, F.signum(den) * eps + eps).otherwise(den)
    # a tiny negative denominator lands on zero: IEEE infinity (or NaN for 0/0), not an error
    return F.coalesce(F.try_divide(num, moved), num * F.when(moved == 0, F.lit(float("inf"))))


def corrected_skew(v: Column | str, eps: float = 0.0) -> Column:
    """Bias-corrected skewness of a group (aggregate expression); null below 3 values or without spread."""
    n = F.count(v).cast("double")
    return F.when((n >= 3) & (F.var_pop(v) > eps), F.try_divide(F.sqrt(n * (n - 1)), n - 2) * F.skewness(v))


def corrected_kurtosis(v: Column | str, eps: float = 0.0) -> Column:
    """Bias-corrected excess kurtosis of a group (aggregate expression); null below 4 values or without spread."""
    n = F.count(v).cast("double")
    g2 = F.kurtosis(v)
    return F.when((n >= 4) & (F.var_pop(v) > eps), F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def cohens_d(ma, va, na, mb, vb, nb) -> Column:
    """Standardised mean difference with the variances pooled by degrees of freedom."""
    pooled = F.sqrt(F.try_divide((na - 1) * va + (nb - 1) * vb, (na + nb - 2).cast("double")))
    return F.when((na >= 2) & (nb >= 2) & (pooled > 0), F.try_divide(ma - mb, pooled))


def cohens_d_unweighted(ma, va, na, mb, vb, nb) -> Column:
    """As :func:`cohens_d` with the plain mean of the two variances."""
    pooled = F.sqrt((va + vb) / 2)
    return F.when((na >= 2) & (nb >= 2) & (pooled > 0), F.try_divide(ma - mb, pooled))


def welch_t(ma, va, na, mb, vb, nb) -> Column:
    spread = F.try_divide(va, na.cast("double")) + F.try_divide(vb, nb.cast("double"))
    return F.try_divide(ma - mb, F.sqrt(spread))


def welch_df(va, na, vb, nb) -> Column:
    a, b = F.try_divide(va, na.cast("double")), F.try_divide(vb, nb.cast("double"))
    spread = F.try_divide(a * a, (na - 1).cast("double")) + F.try_divide(b * b, (nb - 1).cast("double"))
    return F.try_divide((a + b) * (a + b), spread)


def binomial_two_sided(discordant_min: Column, discordant_total: Column) -> Column:
    """Exact two-sided sign-test p: 2 * P(X <= min) for X ~ B(n, 1/2), at most 1.

    The sum runs on a log scale so large counts neither overflow nor underflow.
    """
    k, n = discordant_min.cast("int"), discordant_total.cast("int")
    # log C(n, i) built up step by step: state holds (i, log term, sum)
    first = F.struct(-n * F.lit(log(2.0)).cast("double"), F.exp(-n * F.lit(log(2.0))))
    start = F.struct(first["col1"].alias("lt"), first["col2"].alias("s"))

    def add(acc, i):
        lt = acc["lt"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))
        return F.struct(lt.alias("lt"), (acc["s"] + F.exp(lt)).alias("s"))

    steps = F.when(k >= 1, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    tail = F.aggregate(steps, start, add, lambda acc: acc["s"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2.0 * tail))


def binomial_two_sided_value(k: int, n: int) -> float:
    """Reference value of :func:`binomial_two_sided` for tests."""
    from math import exp

    if n == 0:
        return 1.0
    return min(1.0, 2.0 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * log(2)) for i in range(k + 1)))


def normal_two_sided(z: Column) -> Column:
    """Two-sided normal p value by the Abramowitz-Stegun 7.1.26 error-function polynomial (error < 1.5e-7)."""
    x = F.abs(z) / 2.0**0.5
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return poly * F.exp(-x * x)
