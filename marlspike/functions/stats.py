"""Statistics as column expressions: intervals, tests, estimators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96
# Critical values of Student's t for 95 % by degrees of freedom; linear in between.
T_CRITICAL = {
    1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228,
    11: 2.201, 12: 2.179, 13: 2.160, 14: 2.145, 15: 2.131, 20: 2.086, 25: 2.060, 29: 2.045,
}
# The erf approximation 7.1.26 of Abramowitz and Stegun.
ERF_P, ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def ratio(a: Column, b: Column, default: float) -> Column:
    """a / b, or a default where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(default))


def wilson(successes: Column, total: Column) -> tuple[Column, Column, Column]:
    """Point, lower and upper bound of a share; zeros without trials."""
    p, n = ratio(successes, total, 0.0), F.nullif(total.cast("double"), F.lit(0.0))
    middle, scale = p + Z * Z / (2 * n), 1 + Z * Z / n
    margin = Z * F.sqrt((p * (1 - p) + Z * Z / (4 * n)) / n)
    low, high = F.greatest(F.lit(0.0), (middle - margin) / scale), F.least(F.lit(1.0), (middle + margin) / scale)
    return p, F.when(n.isNull(), 0.0).otherwise(low), F.when(n.isNull(), 0.0).otherwise(high)


def erf(x: Column) -> Column:
    t = 1 / (1 + ERF_P * F.abs(x))
    s = F.lit(0.0)
    for a in reversed(ERF_A):
        s = (s + a) * t
    return F.signum(x) * (1 - s * F.exp(-x * x))


def mcnemar(b: Column, c: Column) -> tuple[Column, Column]:
    """Statistic with continuity correction, and p for one degree of freedom."""
    n = b + c
    chi2 = F.when(n == 0, 0.0).otherwise(F.try_divide(F.pow(F.abs(b - c) - 1, F.lit(2)), n))
    return chi2, F.when(n == 0, 1.0).when(chi2 <= 0, 1.0).otherwise(1 - erf(F.sqrt(chi2 / 2)))


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Chance that one of k draws without replacement succeeds, with c successes among n."""
    log = lambda i: F.log(F.greatest(n - c - i, F.lit(1)).cast("double")) - F.log(F.greatest(n - i, F.lit(1)).cast("double"))
    total = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(0.0), lambda s, i: s + log(i))
    return (
        F.when((n <= 0) | F.lit(k <= 0), 0.0)
        .when(c >= n, 1.0)
        .when(F.lit(k) > n, F.when(c > 0, 1.0).otherwise(0.0))
        .when(n - c - (k - 1) <= 0, 1.0)
        .otherwise(1 - F.exp(total))
    )


def pass_hat_k(n: Column, c: Column, k: int) -> Column:
    """Chance that all of k draws succeed."""
    return F.when(n <= 0, 0.0).otherwise(F.pow(ratio(c, n, 0.0), F.lit(k)))


def t_critical(df: Column) -> Column:
    keys = sorted(T_CRITICAL)
    out = F.lit(Z)
    for a, b in reversed(list(zip(keys, keys[1:]))):
        part = (df - a) / (b - a)
        out = F.when((df >= a) & (df <= b), T_CRITICAL[a] * (1 - part) + T_CRITICAL[b] * part).otherwise(out)
    return out


def t_critical_sql(df: str) -> str:
    keys = sorted(T_CRITICAL)
    whens = " ".join(f"when {df} between {a} and {b} then {T_CRITICAL[a]} * (1 - ({df} - {a}) / {b - a}.0) + {T_CRITICAL[b]} * (({df} - {a}) / {b - a}.0)" for a, b in zip(keys, keys[1:]))
    return f"(case {whens} else 1.96 end)"
