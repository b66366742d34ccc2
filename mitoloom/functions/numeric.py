"""Numerics that no column expression holds: EM over alleles, likelihood-ratio allele sets, Beta fits, quantiles, simplex search."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np

#: Chi-squared statistic from which a smaller allele set is given up.
LRT_THRESHOLD = 24.0


def chi2_tail(x: float) -> float:
    """Upper tail of chi squared with one degree of freedom; 1 for statistics that are not positive."""
    return math.erfc(math.sqrt(x / 2)) if x > 0 else 1.0


def normal_tail(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def em(likelihood: np.ndarray, times: np.ndarray, share: np.ndarray, rounds: int = 100, tolerance: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(allele shares, log likelihoods) of many problems at once by EM from starting shares.

    likelihood is problems by observations by alleles, and times says how often each observation was made (0 where a problem has
    fewer of them). The start is not brought to a sum of 1, as the stopping rule and the statistics built on it depend on that. One step
    is taken before the counted rounds; a problem ends when its reads' log likelihoods change by less than ``tolerance`` in sum.
    """
    share, level = share.astype(float).copy(), np.zeros(len(share))
    total = times.sum(axis=1)
    left, before = np.arange(len(share)), None
    for _ in range(rounds + 1):
        joint = likelihood[left] * share[left, None, :]
        marginal = joint.sum(axis=2)
        seen = times[left]
        with np.errstate(divide="ignore", invalid="ignore"):
            log = np.where(seen > 0, np.log(marginal), 0.0)
            share[left] = (np.where(seen > 0, seen / marginal, 0.0)[:, :, None] * joint).sum(axis=1) / total[left, None]
            level[left] = (seen * log).sum(axis=1)
            if before is not None:
                open_ = ~((seen * np.abs(log - before)).sum(axis=1) < tolerance)
                left, log = left[open_], log[open_]
        if not len(left):
            break
        before = log
    return share, level


class Site:
    """Equal observations at one position of one sample: ``which`` numbers an allele, ``error`` is a base's, ``times`` their count.

    ``names`` are all alleles that the error is shared among, in order of length, then code point.
    """

    def __init__(self, names: list[str], which: np.ndarray, error: np.ndarray, times: np.ndarray):
        self.names, self.which, self.error, self.times = names, which, error, times
        self.depth = np.bincount(which, times, len(names))
        self.total = self.depth.sum()

    def likelihood(self, chosen: tuple[int, ...]) -> np.ndarray:
        """Observations by chosen alleles."""
        return np.where(self.which[:, None] == np.array(chosen), 1 - self.error[:, None], self.error[:, None] / (len(self.names) - 1))


def _fits(problems: list[tuple[Site, tuple[int, ...]]], cells: int = 1 << 21) -> list[float]:
    """Log likelihood of each site under each set of alleles; problems of like size go through EM together."""
    out = [0.0] * len(problems)
    order = sorted(range(len(problems)), key=lambda i: (len(problems[i][1]), len(problems[i][0].which)))
    at = 0
    while at < len(order):
        wide, end = len(problems[order[at]][1]), at
        while end < len(order) and len(problems[order[end]][1]) == wide and (end - at + 1) * len(problems[order[end]][0].which) * wide <= max(cells, len(problems[order[at]][0].which) * wide):
            end += 1
        end = max(end, at + 1)
        some = [problems[i] for i in order[at:end]]
        deep = max(len(s.which) for s, _ in some)
        likelihood, times, share = np.ones((len(some), deep, wide)), np.zeros((len(some), deep)), np.zeros((len(some), wide))
        for i, (site, chosen) in enumerate(some):
            n = len(site.which)
            likelihood[i, :n], times[i, :n], share[i] = site.likelihood(chosen), site.times, site.depth[list(chosen)] / site.total
        for i, level in zip(order[at:end], em(likelihood, times, share)[1], strict=True):
            out[i] = float(level)
        at = end
    return out


def allele_sets(sites: list[Site], least_share: float) -> list[tuple[list[int], float]]:
    """(places of the chosen alleles, quality) of each site.

    From all alleles of sufficient share, sets get smaller by one as long as the best smaller set fits about as well (statistic
    below 24). The quality is -10 log10 of the last statistic's tail; 10000 for one allele of over half of more than ten reads.
    """
    active = [tuple(i for i in range(len(s.names)) if s.total and s.depth[i] / s.total >= least_share) for s in sites]
    statistic = np.zeros(len(sites))
    left = [i for i, chosen in enumerate(active) if len(chosen) > 1]
    level = dict(zip(left, _fits([(sites[i], active[i]) for i in left]), strict=True))
    while left:
        tried = [(i, smaller) for i in left for smaller in combinations(active[i], len(active[i]) - 1)]
        best: dict[int, tuple[float, tuple[int, ...]]] = {}
        for (i, smaller), fit in zip(tried, _fits([(sites[i], smaller) for i, smaller in tried]), strict=True):
            if i not in best or fit > best[i][0]:
                best[i] = (fit, smaller)
        going = []
        for i in left:
            statistic[i] = 2 * (level[i] - best[i][0])
            if statistic[i] < LRT_THRESHOLD:
                level[i], active[i] = best[i]
                if len(active[i]) > 1:
                    going.append(i)
        left = going
    out = []
    for site, chosen, x in zip(sites, active, statistic, strict=True):
        if not chosen:
            quality = 0.0
        elif len(chosen) == 1 and site.total > 10 and site.depth[chosen[0]] / site.total > 0.5:
            quality = 10_000.0
        else:
            p = chi2_tail(float(x))
            quality = -10 * math.log10(p) + 0.0 if p > 0 else 10_000.0
        out.append((list(chosen), quality))
    return out


def simplexes(f: Callable[[np.ndarray, np.ndarray], np.ndarray], start: np.ndarray, step: float = 0.5, tolerance: float = 1e-8, rounds: int = 500) -> np.ndarray:
    """Nelder-Mead searches for the minima of many problems at once, each until its vertices' values spread by less than ``tolerance``.

    f takes one point a problem and the problems' numbers, start is problems by parameters. Problems that have ended drop out.
    """
    wide = start.shape[1]
    points = np.concatenate([start[:, None], start[:, None] + step * np.eye(wide)], axis=1)
    left = np.arange(len(start))
    values = np.stack([f(points[:, j], left) for j in range(wide + 1)], axis=1)
    found = np.empty(start.shape)
    for _ in range(rounds):
        order = np.argsort(values, axis=1, kind="stable")
        points, values = np.take_along_axis(points, order[:, :, None], axis=1), np.take_along_axis(values, order, axis=1)
        done = values[:, -1] - values[:, 0] < tolerance
        if done.any():
            found[left[done]] = points[done, 0]
            left, points, values = left[~done], points[~done], values[~done]
        if not len(left):
            return found
        worst, at_worst = points[:, -1].copy(), values[:, -1].copy()
        middle = np.mean(points[:, :-1], axis=1)
        far = middle + (middle - worst)
        at_far = f(far, left)
        points[:, -1], values[:, -1] = far, at_far
        i = np.flatnonzero(at_far < values[:, 0])
        further = middle[i] + 2 * (middle[i] - worst[i])
        at_further = f(further, left[i])
        better = at_further < at_far[i]
        points[i[better], -1], values[i[better], -1] = further[better], at_further[better]
        i = np.flatnonzero(~((at_far < values[:, 0]) | (at_far < values[:, -2])))
        near = middle[i] + 0.5 * (np.where((at_far < at_worst)[i, None], far[i], worst[i]) - middle[i])
        at_near = f(near, left[i])
        better = at_near < np.minimum(at_far[i], at_worst[i])
        points[i[better], -1], values[i[better], -1] = near[better], at_near[better]
        i = i[~better]
        points[i, -1] = worst[i]
        points[i, 1:] = points[i, :1] + 0.5 * (points[i, 1:] - points[i, :1])
        for j in range(1, wide + 1):
            values[i, j] = f(points[i, j], left[i])
    found[left] = points[np.arange(len(left)), np.argmin(values, axis=1)]
    return found


def simplex(f: Callable[[np.ndarray], float], start: np.ndarray) -> np.ndarray:
    """One search of simplexes."""
    return simplexes(lambda points, _: np.array([f(x) for x in points]), start[None])[0]


def lgammas(x: np.ndarray) -> np.ndarray:
    """math.lgamma of each number."""
    return np.array([math.lgamma(v) for v in x.ravel().tolist()]).reshape(x.shape)


def fit_betas(n: np.ndarray, sum_log: np.ndarray, sum_log1m: np.ndarray, default: tuple[float, float] = (2.5, 1680.0)) -> np.ndarray:
    """Two columns of Beta parameters of greatest likelihood from counts and two sums of logarithms; within [0.01, 1e6]; the default
    under three values. All fits go through the search together."""
    out = np.tile(np.array(default), (len(n), 1))
    some = np.flatnonzero(n >= 3)
    count, one, other = n[some].astype(float), sum_log[some], sum_log1m[some]

    def loss(t: np.ndarray, i: np.ndarray) -> np.ndarray:
        a, b = np.exp(np.clip(t, -20, 20)).T
        return -((a - 1) * one[i] + (b - 1) * other[i] - count[i] * (lgammas(a) + lgammas(b) - lgammas(a + b))) / count[i]

    if len(some):
        out[some] = np.clip(np.exp(np.clip(simplexes(loss, np.tile(np.log(np.array(default)), (len(some), 1))), -20, 20)), 0.01, 1e6)
    return out


def fit_beta(n: float, sum_log: float, sum_log1m: float, default: tuple[float, float] = (2.5, 1680.0)) -> tuple[float, float]:
    """One fit of fit_betas."""
    a, b = fit_betas(np.array([n]), np.array([sum_log], float), np.array([sum_log1m], float), default)[0]
    return float(a), float(b)


Counts = tuple[list[float], list[int]]


def fit_beta_binomial(k: Counts, m: Counts, n: Counts, mean: float | None, variance: float | None) -> tuple[float, float]:
    """Beta-Binomial parameters of greatest likelihood; alpha within [0.01, 100], beta within [0.01, 1000].

    k, m and n say which numbers of hits, misses and trials there are and how often each: the likelihood is a sum over each
    of the three alone, so how they go together does not matter. The search starts from the mean and variance of the shares within
    (0, 1); without any, it gives (0.5, 0.2).
    """
    if mean is None or not 0 < mean < 1:
        return 0.5, 0.2
    widest = mean * (1 - mean)
    variance = 1e-10 if variance is None or variance <= 0 else min(variance, widest * 0.99)
    common = widest / variance - 1
    start = np.log([max(mean * common, 0.01), max((1 - mean) * common, 0.01)])
    gamma = np.vectorize(math.lgamma, otypes=[float])
    total = float(sum(n[1]))

    def part(counts: Counts, shift: float) -> float:
        return float((gamma(np.asarray(counts[0], float) + shift) * np.asarray(counts[1], float)).sum())

    def loss(t: np.ndarray) -> float:
        a, b = np.exp(np.clip(t, -20, 20))
        return -(part(k, a) + part(m, b) - part(n, a + b)) / total + math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)

    a, b = np.exp(np.clip(simplex(loss, start), -20, 20))
    return float(min(max(a, 0.01), 100.0)), float(min(max(b, 0.01), 1000.0))


def discrete_pairs(m_alt: np.ndarray, m_ref: np.ndarray, c_alt: np.ndarray, c_dp: np.ndarray, size: np.ndarray, rows: int = 1 << 12) -> np.ndarray:
    """ln sum over k = 0..size of BetaBinomial(k; size, m_alt + 1, m_ref + 1) * Binomial(c_alt; c_dp, k / size) of whole numbers.

    NaN where a number is missing or a count exceeds its total. Places are taken ``rows`` at a time, so that the terms of large sizes fit.
    """
    out = np.full(len(size), np.nan)
    columns = np.array([m_alt, m_ref, c_alt, c_dp, size])
    sound = np.isfinite(columns).all(axis=0) & (columns >= 0).all(axis=0) & (c_alt <= c_dp) & (size >= 1)
    if not sound.any():
        return out
    a, b, x, n, sizes = columns[:, sound].astype(np.int64)
    most = int(max((a + b + sizes).max() + 2, n.max() + 1))
    factorial = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, most + 1)))])
    choose = lambda n, k: factorial[n] - factorial[k] - factorial[n - k]
    found = np.empty(len(sizes))
    for s in np.unique(sizes):
        k = np.arange(s + 1)
        with np.errstate(divide="ignore"):
            hit, miss = np.log(k / s), np.log1p(-k / s)
        which = np.flatnonzero(sizes == s)
        for at in range(0, len(which), rows):
            i = which[at : at + rows, None]
            drawn = choose(s, k) + factorial[k + a[i]] + factorial[s - k + b[i]] - factorial[s + a[i] + b[i] + 1] - (factorial[a[i]] + factorial[b[i]] - factorial[a[i] + b[i] + 1])
            with np.errstate(invalid="ignore"):
                seen = choose(n[i], x[i]) + np.where(x[i] > 0, x[i] * hit, 0.0) + np.where(n[i] > x[i], (n[i] - x[i]) * miss, 0.0)
            terms = drawn + seen
            top = terms.max(axis=1)
            found[i[:, 0]] = top + np.log(np.exp(terms - top[:, None]).sum(axis=1))
    out[sound] = found
    return out


def binomial_quantile(q: float, n: int, p: float) -> int:
    """The smallest k with Binomial(n, p) CDF of q or more; 0 for p <= 0 or n <= 0, n for p >= 1."""
    if n <= 0 or p <= 0:
        return 0
    if p >= 1:
        return n
    log, odds, below = n * math.log1p(-p), math.log(p) - math.log1p(-p), 0.0
    for k in range(n):
        below += math.exp(log)
        if below >= q:
            return k
        log += math.log((n - k) / (k + 1)) + odds
    return n


def rank_sum_p(ranks_of_first: float, first: int, second: int) -> float:
    """Two-sided p of the rank sum of the first of two samples, by the normal approximation without a correction for ties."""
    if not first or not second:
        return math.nan
    expected = first * (first + second + 1) / 2
    return 2 * normal_tail(abs(ranks_of_first - expected) / math.sqrt(first * second * (first + second + 1) / 12))


def golden_section(f: Callable[[float], float], low: float, high: float, tolerance: float = 0.01) -> float:
    """The place of a maximum between low and high."""
    ratio = (math.sqrt(5) - 1) / 2
    x, y = high - ratio * (high - low), low + ratio * (high - low)
    fx, fy = f(x), f(y)
    while high - low > tolerance:
        if fx >= fy:
            high, y, fy = y, x, fx
            x = high - ratio * (high - low)
            fx = f(x)
        else:
            low, x, fx = x, y, fy
            y = low + ratio * (high - low)
            fy = f(y)
    return (low + high) / 2


def trio_likelihood_exact(p: float, m_alt: int, m_dp: int, c_alt: int, c_dp: int, size: float, nodes: int = 200) -> float:
    """The trio's log likelihood with a second bottleneck between mother and child, by Gauss-Legendre quadrature."""
    if not 0 < p < 1:
        return 0.0
    x, w = np.polynomial.legendre.leggauss(nodes)
    x, w = (x + 1) / 2, w / 2
    gamma = np.vectorize(math.lgamma, otypes=[float])
    beta = lambda a, b: gamma(a) + gamma(b) - gamma(a + b)
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    a, b = p * (size - 1), (1 - p) * (size - 1)
    terms = (a - 1) * np.log(x) + (b - 1) * np.log1p(-x) - beta(a, b) + choose(m_dp, m_alt) + m_alt * np.log(x) + (m_dp - m_alt) * np.log1p(-x)
    terms = terms + choose(c_dp, c_alt) + beta(c_alt + x * (size - 1), c_dp - c_alt + (1 - x) * (size - 1)) - beta(x * (size - 1), (1 - x) * (size - 1))
    return float(terms.max() + np.log((w * np.exp(terms - terms.max())).sum()))
