"""Statistics of regional over- and under-representation as Column expressions.

n and N are a region's count and total, g and G the corpus's, p = n/N, q = g/G.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE = 1e-10
#: chi-square of one degree of freedom at p = .05, .01, .001
CRITICAL = (3.841459, 6.634897, 10.827566)


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, NULL where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def smoothed(n: Column, total: Column, alpha: float = 1.0) -> Column:
    return (n + alpha) / (total + 2 * alpha)


def lift(p: Column, q: Column) -> Column:
    return ratio(p, q)


def log_lift(p: Column, q: Column) -> Column:
    return F.when((p > 0) & (q > 0), F.ln(ratio(p, q)))


def clamped_logit(p: Column) -> Column:
    x = F.least(F.greatest(p.cast("double"), F.lit(EDGE)), F.lit(1 - EDGE))
    return F.ln(x / (1 - x))


def log_odds(p: Column, q: Column) -> Column:
    return clamped_logit(p) - clamped_logit(q)


def ngram_log_odds(n: Column, total: Column, g: Column, all_: Column) -> Column:
    """With one added to the counts of all others; 0 without totals."""
    odds = ratio(n, total - n + 1) / F.nullif(ratio(g, all_ - g + 1), F.lit(0.0))
    return F.when((total <= 0) | (all_ <= 0), F.lit(0.0)).otherwise(F.when(odds > 0, F.ln(odds)))


def z_binomial(n: Column, total: Column, q: Column) -> Column:
    var = total * q * (1 - q)
    return F.when(var < EDGE, F.lit(0.0)).otherwise((n - total * q) / F.sqrt(F.greatest(var, F.lit(EDGE))))


def z_rate(n: Column, total: Column, g: Column, all_: Column) -> Column:
    """Difference of rates over the spread of a Poisson rate."""
    q = ratio(g, all_)
    var = q / F.nullif(total.cast("double"), F.lit(0.0))
    return F.when(F.coalesce(var, F.lit(0.0)) < EDGE, F.lit(0.0)).otherwise((ratio(n, total) - q) / F.sqrt(F.greatest(var, F.lit(EDGE))))


def z_sum(s: Column, n: Column, mean: Column) -> Column:
    """A sum of n scores against the corpus's mean score."""
    var = n * mean
    return F.when(var < EDGE, F.lit(0.0)).otherwise((s - var) / F.sqrt(F.greatest(var, F.lit(EDGE))))


def chi2_yates(n: Column, total: Column, g: Column, all_: Column) -> Column:
    """2x2 contingency of the region against the rest, with continuity
    correction; 0 where a margin is empty."""
    a, b = n.cast("double"), (total - n).cast("double")
    c, d = (g - n).cast("double"), (all_ - total - (g - n)).cast("double")
    t = a + b + c + d
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    core = F.greatest(F.abs(a * d - b * c) - t / 2, F.lit(0.0))
    return F.when(margins <= 0, F.lit(0.0)).otherwise(core * core * t / F.nullif(margins, F.lit(0.0)))


def chi2_fit(n: Column, total: Column, q: Column) -> Column:
    """One-sample goodness of fit to the rate q; 0 where nothing is expected."""
    e, rest = total * q, total * (1 - q)
    d = n - e
    return F.when((e <= 0) | (rest <= 0), F.lit(0.0)).otherwise(d * d / F.nullif(e, F.lit(0.0)) + d * d / F.nullif(rest, F.lit(0.0)))


#: Coefficients of the Chebyshev fit to erfc (error under 1.2e-7 of the value).
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(x: Column) -> Column:
    """The complementary error function of x >= 0."""
    t = 1.0 / (1.0 + 0.5 * x)
    poly = F.lit(_ERFC[-1])
    for c in reversed(_ERFC[:-1]):
        poly = poly * t + c
    return t * F.exp(-x * x + poly)


def erfc_sql(x: str) -> str:
    t = f"(1.0 / (1.0 + 0.5 * ({x})))"
    poly = repr(_ERFC[-1])
    for c in reversed(_ERFC[:-1]):
        poly = f"({poly} * {t} + ({c!r}))"
    return f"({t} * exp(-({x}) * ({x}) + {poly}))"


def p_value(chi2: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom."""
    return erfc(F.sqrt(chi2 / 2))


def p_value_approx(chi2: Column) -> Column:
    """The closed form of the far tail, 1 at 0 and at most 1."""
    return F.when(chi2 <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(-chi2 / 2) * F.sqrt(2 / (F.lit(3.141592653589793) * F.greatest(chi2, F.lit(EDGE))))))


def stars(chi2: Column) -> Column:
    low, mid, high = CRITICAL
    return F.when(chi2 > high, "***").when(chi2 > mid, "**").when(chi2 > low, "*").otherwise("ns")


def cramers_v(chi2: Column, total: Column) -> Column:
    return F.sqrt(chi2 / F.nullif(total.cast("double"), F.lit(0.0)))


def effect_size(v: Column) -> Column:
    return F.when(v < 0.1, "small").when(v < 0.3, "medium").otherwise("large")


def effect_size_fit(v: Column) -> Column:
    return F.when(v < 0.1, "negligible").when(v < 0.3, "small").when(v < 0.5, "medium").otherwise("large")


def wilson(n: Column, total: Column, level: float = 0.95) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson score interval; (0, 0) without rows."""
    z = NormalDist().inv_cdf(0.5 + level / 2)
    size = F.nullif(total.cast("double"), F.lit(0.0))
    p = n / size
    centre = p + z * z / (2 * size)
    spread = z * F.sqrt(p * (1 - p) / size + z * z / (4 * size * size))
    scale = 1 + z * z / size
    low, high = (centre - spread) / scale, (centre + spread) / scale
    known = size.isNotNull()
    return F.when(known, F.greatest(F.lit(0.0), low)).otherwise(0.0), F.when(known, F.least(F.lit(1.0), high)).otherwise(0.0)


def support(g: Column, n: Column, least_all: int = 20, least_here: int = 5) -> Column:
    """A flag; nothing is dropped."""
    return (g >= least_all) & (n >= least_here)


def pmi(pair: Column, first: Column, second: Column, pairs: Column, singles: Column) -> Column:
    """Natural log of the pair's share over the product of its members' shares."""
    value = ratio(pair, pairs) / F.nullif(ratio(first, singles) * ratio(second, singles), F.lit(0.0))
    return F.when(value > 0, F.ln(value))


def log2_pmi(pair: Column, first: Column, second: Column, total: Column) -> Column:
    """Base two over one total; 0 where a count is 0."""
    value = ratio(pair, total) / F.nullif(ratio(first, total) * ratio(second, total), F.lit(0.0))
    return F.when(value > 0, F.log2(value)).otherwise(F.lit(0.0))


def mann_whitney_binary(ones_a: Column, size_a: Column, ones_b: Column, size_b: Column) -> tuple[Column, Column]:
    """U of the first sample and two-sided p for two samples of zeros and ones, from
    counts alone, with the corrections for ties and continuity."""
    a1, a0 = ones_a.cast("double"), (size_a - ones_a).cast("double")
    b1, b0 = ones_b.cast("double"), (size_b - ones_b).cast("double")
    na, nb = size_a.cast("double"), size_b.cast("double")
    u = a1 * b0 + 0.5 * (a1 * b1 + a0 * b0)
    n = na + nb
    t1, t0 = a1 + b1, a0 + b0
    ties = (t1 * t1 * t1 - t1) + (t0 * t0 * t0 - t0)
    var = na * nb / 12 * ((n + 1) - ties / F.nullif(n * (n - 1), F.lit(0.0)))
    z = F.greatest(F.abs(u - na * nb / 2) - 0.5, F.lit(0.0)) / F.sqrt(F.nullif(F.greatest(var, F.lit(0.0)), F.lit(0.0)))
    few = (na < 3) | (nb < 3)
    return F.when(~few, u), F.when(few, F.lit(1.0)).otherwise(F.coalesce(F.least(F.lit(1.0), erfc(z / F.sqrt(F.lit(2.0)))), F.lit(1.0)))


def shannon(shares: Column) -> Column:
    """Entropy in bits of an array of non-negative values, normalised by their sum."""
    total = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)
    terms = F.transform(F.filter(shares, lambda x: x > 0), lambda x: -(x / total) * F.log2(x / total))
    return F.when(total > 0, F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)).otherwise(F.lit(0.0))
