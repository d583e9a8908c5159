"""Tail probabilities for result rows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def kolmogorov_p(d: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """Asymptotic two-sample Kolmogorov p-value of the statistic d; 1 when d is 0."""
    lam2 = d * d * (n1 * n2 / (n1 + n2))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam2))
    return F.when(d <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * series)))


#: Coefficients of Lanczos' series of the gamma function (g = 7).
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]


def log_gamma(a: Column) -> Column:
    """Logarithm of the gamma function for a > 0."""
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total = total + c / (a + i)
    t = a + 7.5
    return 0.5 * math.log(2 * math.pi) + (a + 0.5) * F.log(t) - t + F.log(total) - F.log(a)


def upper_gamma(a: Column, x: Column) -> Column:
    """Regularized upper incomplete gamma function of a > 0: a power series below a + 1, a continued fraction above; both as folds over as many terms as a needs."""
    a, x = a.cast("double"), x.cast("double")
    scale = F.exp(a * F.log(x) - x - log_gamma(a))
    terms = F.sequence(F.lit(1), (300 + 12 * F.sqrt(a)).cast("int"))
    series = F.aggregate(terms, F.struct((1 / a).alias("term"), (1 / a).alias("total")), lambda s, k: _series_step(s, k, a, x), lambda s: s["total"])
    tiny = F.lit(1e-300)
    first = 1 / (x + 1 - a)
    begin = F.struct((1 / tiny).alias("c"), first.alias("d"), first.alias("h"), F.lit(False).alias("done"))
    fraction = F.aggregate(terms, begin, lambda s, k: _fraction_step(s, k, a, x), lambda s: s["h"])
    below = F.greatest(F.lit(0.0), 1 - scale * series)
    return F.when(x <= 0, 1.0).when(x == float("inf"), 0.0).when(x < a + 1, below).otherwise(scale * fraction)


def _series_step(s: Column, k: Column, a: Column, x: Column) -> Column:
    term = s["term"] * x / (a + k)
    return F.struct(term.alias("term"), (s["total"] + term).alias("total"))


def _fraction_step(s: Column, k: Column, a: Column, x: Column) -> Column:
    """One step of Lentz' method; steps after the limit is reached change nothing."""
    safe = lambda v: F.when(F.abs(v) > 1e-300, v).otherwise(F.lit(1e-300))
    n, b = k * (a - k), x + 1 - a + 2 * k
    d = 1 / safe(n * s["d"] + b)
    c = safe(b + n / s["c"])
    keep = lambda name, new: F.when(s["done"], s[name]).otherwise(new).alias(name)
    return F.struct(keep("c", c), keep("d", d), keep("h", s["h"] * d * c), (s["done"] | (F.abs(d * c - 1) < 1e-15)).alias("done"))


def chi_square_p(stat: Column, dof: Column) -> Column:
    """Upper tail of the chi-square distribution; null without a statistic or degrees of freedom."""
    return F.when(stat.isNull() | dof.isNull() | (dof <= 0), F.lit(None)).otherwise(upper_gamma(dof / 2, stat / 2))
