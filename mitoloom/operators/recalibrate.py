"""Score recalibration: standardised features, Gaussian mixtures, cut-offs, tallies."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mitoloom.operators.ordered import durable, running


def standardized(rows: DataFrame) -> DataFrame:
    """features (arrays) as z-scores by the population's deviation; a feature without variance becomes null.

    Each place's mean and deviation come from one partial aggregate and are joined as one row. No rows give none.
    """
    each = rows.select(F.posexplode("features").alias("__d", "__x")).groupBy("__d").agg(F.avg(F.col("__x").cast("double")).alias("m"), F.stddev_pop(F.col("__x").cast("double")).alias("s"))
    stats = each.agg(F.array_sort(F.collect_list(F.struct("__d", "m", "s"))).alias("__stats"))
    z = F.zip_with("features", "__stats", lambda x, t: F.try_divide(x.cast("double") - t["m"], t["s"]))
    return rows.crossJoin(F.broadcast(stats)).withColumn("features", z).drop("__stats")  # one row, as long as a vector


def mixture_lod(features: Column, weights: list[float], means: list[list[float]], variances: list[list[float]]) -> Column:
    """log10 density of a mixture of axis-aligned Gaussians."""
    terms = []
    for w, m, s in zip(weights, means, variances, strict=True):
        t = F.lit(math.log(w))
        for d, (mu, var) in enumerate(zip(m, s, strict=True)):
            t = t + F.lit(-0.5 * math.log(2 * math.pi * var)) - F.pow(features[d].cast("double") - mu, 2) / (2 * var)
        terms.append(t)
    top = F.greatest(*terms) if len(terms) > 1 else terms[0]
    total = F.lit(0.0)
    for t in terms:
        total = total + F.exp(t - top)
    return (top + F.ln(total)) / math.log(10)


@dataclass
class Mixture:
    """Gaussians with full covariances."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    log_likelihood: float = math.nan
    converged: bool = False

    def parts(self, x: np.ndarray) -> np.ndarray:
        """ln of weight times density, by row and Gaussian."""
        out = np.empty((len(x), len(self.weights)))
        for j, (w, m, c) in enumerate(zip(self.weights, self.means, self.covariances, strict=True)):
            low = np.linalg.cholesky(c)
            z = np.linalg.solve(low, (x - m).T)
            out[:, j] = math.log(w) - 0.5 * (z * z).sum(axis=0) - np.log(np.diag(low)).sum() - 0.5 * x.shape[1] * math.log(2 * math.pi)
        return out

    def log10_density(self, x: np.ndarray) -> np.ndarray:
        return _log_sum(self.parts(x)) / math.log(10)

    def log10_by_feature(self, x: np.ndarray) -> np.ndarray:
        """For each feature alone; its variance stands where a normal density has its deviation, as the results are defined."""
        out = np.empty(x.shape)
        for d in range(x.shape[1]):
            s = self.covariances[:, d, d]
            out[:, d] = _log_sum(np.log(self.weights) - np.log(s) - 0.5 * math.log(2 * math.pi) - 0.5 * ((x[:, d, None] - self.means[:, d]) / s) ** 2)
        return out / math.log(10)

    def bic(self, n: int) -> float:
        k, d = self.means.shape
        return (k * d + k * d * (d + 1) / 2 + k - 1) * math.log(max(n, 1)) - 2 * self.log_likelihood


def _log_sum(parts: np.ndarray) -> np.ndarray:
    top = parts.max(axis=1)
    return top + np.log(np.exp(parts - top[:, None]).sum(axis=1))


def _moments(data: DataFrame, models: list[Mixture]) -> list[np.ndarray]:
    """For each model, sums over all rows by Gaussian: of its share of the row, times 1, the features and their products; and, in
    the first Gaussian's last place, of the row's log density.

    All models are taken through the data together; a task gives one row a place, which Spark sums.
    """
    shapes = [(len(m.weights), m.means.shape[1]) for m in models]
    widths = [k * (1 + d + d * d) + 1 for k, d in shapes]
    offsets = np.concatenate([[0], np.cumsum(widths)])
    spread = data.sparkSession.sparkContext.broadcast(models)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(offsets[-1])
        for frame in frames:
            x = np.array(frame["features"].tolist(), dtype=float)
            if not len(x):
                continue
            squares = np.einsum("ni,nj->nij", x, x).reshape(len(x), -1)
            both = np.concatenate([np.ones((len(x), 1)), x, squares], axis=1)
            for model, at, width in zip(spread.value, offsets, widths, strict=False):
                parts = model.parts(x)
                level = _log_sum(parts)
                total[at : at + width - 1] += (np.exp(parts - level[:, None]).T @ both).reshape(-1)
                total[at + width - 1] += level.sum()
        yield pd.DataFrame({"place": np.arange(len(total)), "value": total})

    out = np.zeros(offsets[-1])
    for r in data.mapInPandas(sums, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toLocalIterator():
        out[r["place"]] = r["value"]
    return [out[a : a + w] for a, w in zip(offsets, widths, strict=False)]


def _maximised(model: Mixture, sums: np.ndarray, n: int, floor: float) -> Mixture:
    k, d = model.means.shape
    table = sums[:-1].reshape(k, 1 + d + d * d)
    share = table[:, 0] + 10 * np.finfo(float).eps
    means = table[:, 1 : 1 + d] / share[:, None]
    covariances = table[:, 1 + d :].reshape(k, d, d) / share[:, None, None] - np.einsum("ki,kj->kij", means, means)
    covariances = (covariances + covariances.transpose(0, 2, 1)) / 2 + floor * np.eye(d)
    low = np.linalg.eigvalsh(covariances).min(axis=1)
    for j in np.flatnonzero(low < floor / 2):  # what rounding has made of a covariance without extent
        covariances[j] += (floor - low[j]) * np.eye(d)
    return Mixture(share / share.sum(), means, covariances, float(sums[-1]))


def _starts(seeds: np.ndarray, spread: np.ndarray, k: int, seed: int) -> Mixture:
    """A start for EM: k of the sampled rows, each far from those before it, with the spread of all rows shared out."""
    rng = np.random.default_rng(seed * 1000 + k)
    chosen = [int(rng.integers(len(seeds)))]
    for _ in range(k - 1):
        distance = np.min([((seeds - seeds[c]) ** 2).sum(axis=1) for c in chosen], axis=0)
        chosen.append(int(rng.choice(len(seeds), p=distance / distance.sum())) if distance.sum() > 0 else chosen[-1])
    return Mixture(np.full(k, 1 / k), seeds[chosen].copy(), np.repeat(spread[None] / k ** (2 / spread.shape[0]), k, axis=0))


def fit_mixtures(rows: DataFrame, most: int = 10, *, restarts: int = 2, rounds: int = 150, tolerance: float = 2e-3, floor: float = 1e-6, sample: int = 2000) -> tuple[Mixture, list[tuple[int, float]]]:
    """(the mixture of least BIC among those of 1 to ``most`` Gaussians that converged, k and BIC of each).

    EM over all rows (``features``: arrays): every k and restart goes through the data in the same job a round, until its mean log
    likelihood changes by less than ``tolerance``; of restarts the likeliest is kept. Starts come from ``sample`` rows, those of
    smallest hash, so that reruns agree. A full covariance has ``floor`` added to its diagonal, and needs more rows than features: there
    are as many Gaussians at most as that leaves, but one. No rows raise.
    """
    data = durable(rows.select("features"))
    n = data.count()
    if not n:
        raise ValueError("no rows to fit")
    seeds = np.array([r["features"] for r in data.orderBy(F.xxhash64("features"), "features").limit(sample).collect()], dtype=float)
    one = _moments(data, [Mixture(np.ones(1), seeds[:1], np.eye(seeds.shape[1])[None])])[0]
    whole = _maximised(Mixture(np.ones(1), seeds[:1], np.eye(seeds.shape[1])[None]), one, n, floor)
    models = [whole, *(_starts(seeds, whole.covariances[0], k, s) for k in range(2, min(most, n // (seeds.shape[1] + 1)) + 1) for s in range(restarts))]
    before, left = [-math.inf] * len(models), list(range(len(models)))
    for _ in range(rounds + 1):
        going = []
        for i, sums in zip(left, _moments(data, [models[i] for i in left]), strict=True):
            level = float(sums[-1])
            if abs(level - before[i]) / n < tolerance:
                models[i].log_likelihood, models[i].converged = level, True
                continue
            before[i] = level
            models[i] = _maximised(models[i], sums, n, floor)
            going.append(i)
        left = going
        if not left:
            break
    best = {}
    for m in models:
        k = len(m.weights)
        if k not in best or (m.converged, m.log_likelihood) > (best[k].converged, best[k].log_likelihood):
            best[k] = m
    table = [(k, m.bic(n)) for k, m in sorted(best.items())]
    sound = [(bic, k) for k, bic in table if best[k].converged]
    if not sound:
        raise ValueError("no mixture has converged; allow fewer Gaussians or more rounds")
    return best[min(sound)[1]], table


def scored_by(rows: DataFrame, model: Mixture, name: str) -> DataFrame:
    """rows plus ``name``, the mixture's log10 density of features."""
    spread = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def density(features: pd.Series) -> pd.Series:
        return pd.Series(spread.value.log10_density(np.array(features.tolist(), dtype=float)) if len(features) else [], dtype=float)

    return rows.withColumn(name, density("features"))


def culprits(rows: DataFrame, good: Mixture, bad: Mixture) -> DataFrame:
    """rows plus culprit: the feature, from 0, in which the good mixture has least over the bad one; the first of equal ones."""
    spread = rows.sparkSession.sparkContext.broadcast((good, bad))

    @F.pandas_udf("int")
    def worst(features: pd.Series) -> pd.Series:
        if not len(features):
            return pd.Series([], dtype="int32")
        x = np.array(features.tolist(), dtype=float)
        g, b = spread.value
        return pd.Series((g.log10_by_feature(x) - b.log10_by_feature(x)).argmin(axis=1).astype("int32"))

    return rows.withColumn("culprit", worst("features"))


def recalibrated(rows: DataFrame, *, most: int = 10, prior: float = 2.0, widest: float = 8.0, share: float = 0.95, **options) -> DataFrame:
    """Scores against a mixture of the training rows and one of the worst rows: rows (features, truth) with standardised features,
    failing, negative, score, quality and culprit.

    Features are standardised over all rows; one without variance raises. Rows that lie further than ``widest`` deviations out in a
    feature are failing: they are scored, but train nothing. The good mixture is that of the training rows (truth), the cut-off the
    whole number next to the score that more than ``share`` of them reach, and rows below it (negative) make the bad mixture. Score is
    prior + good - bad, in log10; quality is ten times that, to two places; culprit is the feature that speaks most against the
    row. Rows whose features are null, or hold null or numbers that are not finite, raise, as no score is defined for them.
    """
    broken = F.col("features").isNull() | F.exists("features", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == math.inf))
    checked = rows.withColumn("features", F.when(broken, F.raise_error(F.lit("features that are null or not finite"))).otherwise(F.col("features")))
    data = durable(standardized(checked))
    if data.where(F.exists("features", lambda x: x.isNull())).head(1):
        raise ValueError("a feature has no variance and must be left out")
    data = data.withColumn("failing", F.exists("features", lambda x: F.abs(x) > widest))
    good, _ = fit_mixtures(data.where("truth AND NOT failing"), most, **options)
    scored = durable(scored_by(data, good, "good"))
    cutoff = sensitivity_cutoff(scored.where("NOT failing").select(F.col("good").alias("score"), "truth"), share).first()["cutoff"]
    worst = (F.col("good") < float(round(cutoff))) & ~F.col("failing")
    bad, _ = fit_mixtures(scored.where(worst), most, **options)
    both = scored_by(scored.withColumn("negative", worst), bad, "bad").withColumn("score", F.lit(prior) + F.col("good") - F.col("bad"))
    return culprits(both.withColumn("quality", F.round(F.col("score") * 10, 2)), good, bad).drop("good", "bad")


def report(scored: DataFrame, thresholds: list[float]) -> tuple[DataFrame, DataFrame]:
    """(rows that reach each quality, rows of each culprit) with their shares of all."""
    n = F.lit(float(max(1, scored.count())))
    reached = tally(scored.select(F.col("quality").alias("score")), thresholds).withColumn("share", F.col("n") / n)
    return reached, scored.groupBy("culprit").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / n)


def sensitivity_cutoff(scored: DataFrame, share: float = 0.95) -> DataFrame:
    """(cutoff): the highest score at which more than ``share`` of the true rows lie at or above it. Columns: score, truth."""
    down = scored.where("truth").groupBy("score").agg(F.count("*").alias("n"))
    cumulative = running(down, F.col("n"), [F.col("score").desc()], "got")
    every = cumulative.agg(F.sum("n").alias("all"))
    return cumulative.crossJoin(F.broadcast(every)).where(F.col("got") > share * F.col("all")).agg(F.max("score").alias("cutoff"))  # one row


def worst_feature(features: Column) -> Column:
    """0-based place of the smallest value."""
    return F.array_position(features, F.array_min(features)) - 1


def tally(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """How many rows reach each threshold."""
    counts = scored.agg(*[F.count_if(F.col("score") >= t).alias(f"t{i}") for i, t in enumerate(thresholds)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("n")) for i, t in enumerate(thresholds)])).alias("r")).select("r.*")
