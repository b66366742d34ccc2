"""Statistics as Column expressions, so that they stay inside code generation (but for sums of many terms, in Arrow batches); each has a plain SQL twin in the catalog."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from mitoloom.functions import numeric, special

#: Stands for an infinite Phred value or odds ratio.
INFINITE = 10_000.0
# Normal quantiles for 95, 99 and 90 percent.
Z = {0.95: 1.96, 0.99: 2.576, 0.90: 1.645}
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)


def lgamma(x: Column) -> Column:
    """ln gamma(x) for x > 0: Stirling's series at x + 8, less the logarithm of the eight factors between."""
    z = x + F.lit(8.0)
    inverse = F.lit(1.0) / z
    square = inverse * inverse
    series = reduce(lambda acc, c: acc * square + F.lit(c), reversed(STIRLING[:-1]), F.lit(STIRLING[-1])) * inverse
    factors = reduce(lambda acc, k: acc * (x + F.lit(float(k))), range(1, 8), x)
    return (z - 0.5) * F.ln(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + series - F.ln(factors)


def log_beta(a: Column, b: Column) -> Column:
    return lgamma(a) + lgamma(b) - lgamma(a + b)


def log_choose(n: Column, k: Column) -> Column:
    """ln C(n, k); null outside 0 <= k <= n."""
    n, k = n.cast("double"), k.cast("double")
    return F.when((k >= 0) & (k <= n), lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1))


def log_binomial(k: Column, n: Column, p: Column) -> Column:
    """ln Binomial(k; n, p); certain outcomes at p = 0 or 1 give 0 and impossible ones null."""
    k, n = k.cast("double"), n.cast("double")
    inside = log_choose(n, k) + k * F.ln(p) + (n - k) * F.ln(F.lit(1.0) - p)
    return F.when(p <= 0, F.when(k == 0, F.lit(0.0))).when(p >= 1, F.when(k == n, F.lit(0.0))).otherwise(inside)


def log_beta_binomial(k: Column, n: Column, a: Column, b: Column) -> Column:
    k, n = k.cast("double"), n.cast("double")
    return log_choose(n, k) + log_beta(k + a, n - k + b) - log_beta(a, b)


def log_sum_exp(a: Column, b: Column) -> Column:
    high, low = F.greatest(a, b), F.least(a, b)
    return high + F.log1p(F.exp(low - high))


def beta_density(x: Column, a: float, b: float) -> Column:
    """Beta(a, b) density; 0 outside (0, 1)."""
    inside = F.exp((a - 1) * F.ln(x) + (b - 1) * F.ln(F.lit(1.0) - x) - F.lit(math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)))
    return F.when((x > 0) & (x < 1), inside).otherwise(F.lit(0.0))


def surprise(x: Column, a: float, b: float) -> Column:
    """-ln of the Beta density; 0 outside (0, 1)."""
    return F.when((x > 0) & (x < 1), -F.ln(beta_density(x, a, b))).otherwise(F.lit(0.0))


def phred_error(quality: Column) -> Column:
    return F.pow(F.lit(10.0), -quality / F.lit(10.0))


def allele_likelihood(matches: Column, quality: Column, alleles: int) -> Column:
    error = phred_error(quality)
    return F.when(matches, F.lit(1.0) - error).otherwise(error / F.lit(float(alleles - 1)))


def proportion_interval(k: Column, n: Column, level: float = 0.95) -> tuple[Column, Column]:
    """Agresti-Coull for n of 40 or more, Wilson below; within [0, 1]."""
    z, k, n = Z[level], k.cast("double"), n.cast("double")
    wide = n + z * z
    center = (k + z * z / 2) / wide
    coull = z * F.sqrt(center * (F.lit(1.0) - center) / wide)
    p = k / n
    wilson = z / (F.lit(1.0) + z * z / n) * F.sqrt(p * (F.lit(1.0) - p) / n + z * z / (F.lit(4.0) * n * n))
    half = F.when(n >= 40, coull).otherwise(wilson)
    return F.greatest(F.lit(0.0), center - half), F.least(F.lit(1.0), center + half)


@F.pandas_udf(DoubleType())
def _two_sided(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series(special.table_tails(*(x.to_numpy(float) for x in (a, b, c, d)), "no likelier"))


@F.pandas_udf(DoubleType())
def _less(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series(special.table_tails(*(x.to_numpy(float) for x in (a, b, c, d)), "less"))


@F.pandas_udf(DoubleType())
def _greater(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series(special.table_tails(*(x.to_numpy(float) for x in (a, b, c, d)), "greater"))


def _tail(kind, *cells: Column) -> Column:
    """A tail of the tables with these margins, summed in Arrow batches for all rows step by step; 1 where a cell is null."""
    return F.least(F.lit(1.0), kind(*(x.cast("double") for x in cells)))


def fisher_two_sided(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Sum over tables with these margins that are no more probable than the observed one (slack 1e-8)."""
    return _tail(_two_sided, a, b, c, d)


def fisher_less(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Probability of a first cell of ``a`` or less."""
    return _tail(_less, a, b, c, d)


def fisher_greater(a: Column, b: Column, c: Column, d: Column) -> Column:
    return _tail(_greater, a, b, c, d)


def phred(p: Column) -> Column:
    """-10 log10 p; 10000 where p is not positive."""
    return F.when(p <= 0, F.lit(INFINITE)).otherwise(F.abs(F.lit(-10.0) * F.log10(p)))


def strand_odds_ratio(major_forward: Column, major_reverse: Column, forward: Column, reverse: Column) -> Column:
    """(major forward * allele reverse) / (major reverse * allele forward); 10000 where the divisor is 0."""
    below = (major_reverse * forward).cast("double")
    return F.when(below <= 0, F.lit(INFINITE)).otherwise((major_forward * reverse).cast("double") / below)


def strand_ratio(forward: Column, reverse: Column) -> Column:
    return F.least(forward, reverse) / (F.greatest(forward, reverse) + F.lit(1e-10))


def logit(x: Column) -> Column:
    """ln(x / (1 - x)); -10000 at 0 and 10000 at 1."""
    return F.when(x <= 0, F.lit(-INFINITE)).when(x >= 1, F.lit(INFINITE)).otherwise(F.ln(x / (F.lit(1.0) - x)))


@F.pandas_udf(DoubleType())
def _discrete(m_alt: pd.Series, m_ref: pd.Series, c_alt: pd.Series, c_dp: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series(numeric.discrete_pairs(*(x.to_numpy(float) for x in (m_alt, m_ref, c_alt, c_dp, size))))


def discrete_pair_likelihood(m_alt: Column, m_ref: Column, c_alt: Column, c_dp: Column, size: Column) -> Column:
    """ln sum over k of BetaBinomial(k; size, m_alt + 1, m_ref + 1) * Binomial(c_alt; c_dp, k / size); null where a count is.

    The sum has size + 1 terms of ten gamma functions each, all of whole numbers: in Arrow batches those are looked up.
    """
    return _discrete(*(x.cast("double") for x in (m_alt, m_ref, c_alt, c_dp, size)))


def continuous_pair_likelihood(p: Column, c_alt: Column, c_dp: Column, size: Column) -> Column:
    """ln BetaBinomial(c_alt; c_dp, p (size - 1), (1 - p)(size - 1)); 0 where the mother has one allele only."""
    drawn = log_beta_binomial(c_alt, c_dp, p * (size - 1), (F.lit(1.0) - p) * (size - 1))
    return F.when((p <= 0) | (p >= 1), F.lit(0.0)).otherwise(drawn)


def trio_likelihood(p: Column, m_alt: Column, m_dp: Column, c_alt: Column, c_dp: Column, size: Column) -> Column:
    """ln of the mother's and the child's counts given the grandmother's share p, both drawn from one latent Beta share."""
    a, b = p * (size - 1), (F.lit(1.0) - p) * (size - 1)
    alt, total = (m_alt + c_alt).cast("double"), (m_dp + c_dp).cast("double")
    drawn = log_choose(m_dp, m_alt) + log_choose(c_dp, c_alt) + log_beta(alt + a, total - alt + b) - log_beta(a, b)
    return F.when((p <= 0) | (p >= 1), F.lit(0.0)).otherwise(drawn)


def posterior(log_error: Column, log_mutation: Column, prior: float) -> Column:
    """Probability of a mutation from two log likelihoods; the prior is clipped by 1e-12."""
    prior = min(max(prior, 1e-12), 1 - 1e-12)
    odds = log_mutation - log_error + F.lit(math.log(prior) - math.log1p(-prior))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.greatest(odds, F.lit(-700.0)), F.lit(700.0))))
