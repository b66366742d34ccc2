"""Incomplete gamma and beta functions over arrays, and what follows from them: tails of chi squared, of binomials and of two by two
tables, and quantiles."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

# Stirling's series, from 1/12 on.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)
TINY = 1e-300


def lgamma(x: np.ndarray) -> np.ndarray:
    """ln gamma(x) for x > 0: Stirling's series at x + 10, less the logarithm of the ten factors between, for small x."""
    x = np.asarray(x, dtype=float)
    small = x < 10
    z = np.where(small, x + 10, x)
    inverse = 1 / z
    square, series = inverse * inverse, np.zeros_like(z)
    for c in reversed(STIRLING):
        series = series * square + c
    out = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series * inverse
    if small.any():
        factors = np.ones(int(small.sum()))
        for k in range(10):
            factors = factors * (x[small] + k)
        out[small] -= np.log(factors)
    return out


def _fraction(a, b, start_b: np.ndarray, rounds: int) -> np.ndarray:
    """A continued fraction b0 + a1 / (b1 + a2 / (b2 + ...)) by Lentz's method; a and b give the terms of a round for the places that
    are still open."""
    f = np.where(start_b == 0, TINY, start_b)
    c, d = f.copy(), np.zeros_like(f)
    left = np.arange(len(f))
    for n in range(1, rounds + 1):
        an, bn = a(n, left), b(n, left)
        d_left = bn + an * d[left]
        c_left = bn + an / c[left]
        d_left = 1 / np.where(d_left == 0, TINY, d_left)
        c_left = np.where(c_left == 0, TINY, c_left)
        change = c_left * d_left
        f[left] *= change
        c[left], d[left] = c_left, d_left
        left = left[np.abs(change - 1) > 1e-15]
        if not len(left):
            break
    return f


def gamma_tail(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The upper regularised incomplete gamma function Q(a, x): a series for its complement below a + 1, a continued fraction above.

    1 for x <= 0; not a number where a is not positive.
    """
    a, x = (np.array(v, dtype=float, ndmin=1) for v in np.broadcast_arrays(a, x))
    out = np.where(a > 0, 1.0, np.nan)
    known = (a > 0) & (x > 0)
    out[known & np.isinf(x)] = 0.0
    known &= np.isfinite(x)
    scale = np.zeros_like(out)
    scale[known] = np.exp(a[known] * np.log(x[known]) - x[known] - lgamma(a[known]))
    low = np.flatnonzero(known & (x < a + 1))
    if len(low):
        term = 1 / a[low]
        total, left, n = term.copy(), np.arange(len(low)), 0
        while len(left):
            n += 1
            term[left] *= x[low][left] / (a[low][left] + n)
            total[left] += term[left]
            left = left[term[left] > total[left] * 1e-16]
        out[low] = 1 - total * scale[low]
    high = np.flatnonzero(known & (x >= a + 1))
    if len(high):
        ah, xh = a[high], x[high]
        rounds = 200 + int(10 * np.sqrt(ah.max()))
        f = _fraction(lambda n, i: -n * (n - ah[i]), lambda n, i: xh[i] + 2 * n + 1 - ah[i], xh + 1 - ah, rounds)
        out[high] = scale[high] / f
    return out


def beta_share(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function I_x(a, b) for positive a and b, by its continued fraction on the side where that is
    quick."""
    a, b, x = (np.array(v, dtype=float, ndmin=1) for v in np.broadcast_arrays(a, b, x))
    out = np.where(x >= 1, 1.0, 0.0)
    inside = np.flatnonzero((x > 0) & (x < 1))
    if not len(inside):
        return out
    a, b, x = a[inside], b[inside], x[inside]
    turned = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)

    def term(n: int, i: np.ndarray) -> np.ndarray:
        m = n // 2
        if n % 2 == 0:
            return m * (b[i] - m) * x[i] / ((a[i] + 2 * m - 1) * (a[i] + 2 * m))
        return -(a[i] + m) * (a[i] + b[i] + m) * x[i] / ((a[i] + 2 * m) * (a[i] + 2 * m + 1))

    rounds = 300 + int(10 * np.sqrt(np.maximum(a, b).max()))
    f = _fraction(term, lambda n, i: np.ones(len(i)), np.ones(len(a)), rounds)
    front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    out[inside] = np.where(turned, 1 - front / f, front / f)
    return out


def binomial_below(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(X <= k) for Binomial(n, p), for 0 <= k < n."""
    return beta_share(np.asarray(n, float) - k, np.asarray(k, float) + 1, 1 - np.asarray(p, float))


def binomial_quantiles(q: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The smallest k with P(X <= k) >= q of each Binomial(n, p), by bisection; 0 for n <= 0 or p <= 0, n for p >= 1.

    About log2(n) evaluations for all of them at once, whatever the depth.
    """
    q, n, p = (np.array(v, dtype=float, ndmin=1) for v in np.broadcast_arrays(q, n, p))
    out = np.where((p >= 1) & (n > 0), n, 0.0)
    open_ = np.flatnonzero((n > 0) & (p > 0) & (p < 1))
    low, high = np.full(len(open_), -1.0), n[open_].copy()  # P(X <= low) < q <= P(X <= high)
    while len(at := np.flatnonzero(high - low > 1)):
        middle = np.floor((low[at] + high[at]) / 2)
        enough = binomial_below(middle, n[open_][at], p[open_][at]) >= q[open_][at]
        high[at], low[at] = np.where(enough, middle, high[at]), np.where(enough, low[at], middle)
    out[open_] = high
    return out.astype(np.int64)


def table_walks(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, *, up: bool, most: float = math.inf) -> np.ndarray:
    """Sums of q over the tables with the margins of [[a, b], [c, d]] beside it, of larger first cells or smaller ones.

    q is a table's probability over that of the given one; those above ``most`` are left out. Each step multiplies q by the ratio of
    two neighbours' probabilities for all tables that have not ended; NaN where a count is missing.
    """
    total = np.zeros(len(a))
    steps = np.minimum(b, c) if up else np.minimum(a, d)
    left = np.flatnonzero(steps > 0)
    k, row, column, rest, q = a[left], (a + b)[left], (a + c)[left], (d - a)[left], np.ones(len(left))
    ends = a[left] + (steps[left] if up else -steps[left])
    while len(left):
        q = q * ((row - k) * (column - k) / ((k + 1) * (rest + k + 1)) if up else k * (rest + k) / ((row - k + 1) * (column - k + 1)))
        k = k + (1 if up else -1)
        total[left] += np.where(q <= most, q, 0.0)
        going = (k != ends) & (q > 0)
        if not going.all():
            left, k, row, column, rest, q, ends = (x[going] for x in (left, k, row, column, rest, q, ends))
    return total


def table_tails(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, tail: str) -> np.ndarray:
    """Probability, among the tables with the margins of [[a, b], [c, d]], of those that are ``no likelier`` (slack 1e-8), or of a first
    cell of a or ``less``, or a or ``greater``; NaN where a count is missing or negative."""
    sound = (a >= 0) & (b >= 0) & (c >= 0) & (d >= 0)
    out = np.full(len(a), np.nan)
    a, b, c, d = a[sound], b[sound], c[sound], d[sound]
    choose = lambda n, k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
    observed = np.exp(choose(a + b, a) + choose(c + d, c) - choose(a + b + c + d, a + c))
    beside = np.ones(len(a))
    for up, kind in ((True, "greater"), (False, "less")):
        if tail in ("no likelier", kind):
            beside = beside + table_walks(a, b, c, d, up=up, most=1 + 1e-8 if tail == "no likelier" else math.inf)
    out[sound] = observed * beside
    return out


@F.pandas_udf(DoubleType())
def _chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(gamma_tail(df.to_numpy(float) / 2, x.to_numpy(float) / 2))


@F.pandas_udf(LongType())
def _binomial_quantile(n: pd.Series, p: pd.Series, q: pd.Series) -> pd.Series:
    return pd.Series(binomial_quantiles(q.to_numpy(float), n.to_numpy(float), p.to_numpy(float)))


@F.pandas_udf(DoubleType())
def log_beta_share(k: pd.Series, n: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """ln (B(k + a, n - k + b) / B(a, b)); null unless 0 <= k <= n and n, a, b > 0.

    As columns, its six gamma functions make code that Java does not compile, row by row slower than Arrow batches.
    """
    k, n, a, b = (x.to_numpy(float) for x in (k, n, a, b))
    out = np.full(len(k), np.nan)
    known = (k >= 0) & (k <= n) & (n > 0) & (a > 0) & (b > 0)
    k, n, a, b = k[known], n[known], a[known], b[known]
    out[known] = lgamma(k + a) + lgamma(n - k + b) - lgamma(n + a + b) - lgamma(a) - lgamma(b) + lgamma(a + b)
    return pd.Series(out)


def chi2_tail(x: Column, df: Column) -> Column:
    """The upper tail of chi squared with any degrees of freedom; 1 for statistics that are not positive, null for null ones."""
    return F.when(x.isNotNull() & df.isNotNull(), _chi2_tail(F.coalesce(x.cast("double"), F.lit(0.0)), F.coalesce(df.cast("double"), F.lit(1.0))))


def binomial_quantile(n: Column, p: Column, q: Column) -> Column:
    """The smallest count that Binomial(n, p) does not exceed with a probability of ``q`` or more; null for nulls."""
    known = n.isNotNull() & p.isNotNull() & q.isNotNull()
    return F.when(known, _binomial_quantile(F.coalesce(n.cast("double"), F.lit(0.0)), F.coalesce(p.cast("double"), F.lit(0.0)), F.coalesce(q.cast("double"), F.lit(0.5))))
