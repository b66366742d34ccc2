"""Likelihood surfaces over bottleneck sizes: sums on a grid, the best size, and a contiguous profile interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mitoloom.functions import stats as st

#: Half of the 95 percent point of chi squared with one degree of freedom.
DROP = 1.92


def _summed_lgamma(rows: DataFrame, keys: list[str], terms: list[tuple[int, Column]]) -> DataFrame:
    """(keys, ll): the sum of times * sign * lgamma(argument) over rows and terms.

    Terms become rows, so that the generated code holds one lgamma, small enough to be compiled, rather than one a term.
    """
    pairs = F.array(*[F.struct((F.col("times") * sign).cast("double").alias("by"), x.cast("double").alias("x")) for sign, x in terms])
    each = rows.select(*keys, F.explode(pairs).alias("t")).select(*keys, "t.by", "t.x")
    return each.groupBy(*keys).agg(F.sum(F.col("by") * st.lgamma(F.col("x"))).alias("ll"))


def _choose(n: str, k: str) -> list[tuple[int, Column]]:
    """ln C(n, k) as terms."""
    return [(1, F.col(n) + 1), (-1, F.col(k) + 1), (-1, F.col(n) - F.col(k) + 1)]


def surface(pairs: DataFrame, sizes: list[float], model: str = "continuous", by: list[str] | None = None) -> DataFrame:
    """(ne, ll): the composite log likelihood at each size. Equal observations are counted once and weighed.

    The grid is an array that each distinct observation is exploded over, and what does not depend on the size is summed apart, so
    each sum is one partial aggregate and one shuffle of a row for each size and partition. Pairs whose mother (for trios:
    grandmother) has one allele only add nothing. No pairs give no rows.
    """
    keys, grid = by or [], F.array(*[F.lit(float(x)) for x in sizes])
    if model == "discrete":
        columns = ["m_alt", "m_dp", "c_alt", "c_dp"]
        distinct = pairs.groupBy(*keys, *columns).agg(F.count("*").alias("times")).withColumn("ne", F.explode(grid))
        ll = st.discrete_pair_likelihood(F.col("m_alt"), F.col("m_dp") - F.col("m_alt"), F.col("c_alt"), F.col("c_dp"), F.col("ne"))
        return distinct.groupBy(*keys, "ne").agg(F.sum(F.col("times") * ll).alias("ll"))
    if model == "trio":
        share, alt, total, counts = F.col("g"), F.col("m_alt") + F.col("c_alt"), F.col("m_dp") + F.col("c_dp"), [("m_dp", "m_alt"), ("c_dp", "c_alt")]
    else:
        share, alt, total, counts = F.col("p"), F.col("c_alt"), F.col("c_dp"), [("c_dp", "c_alt")]
    mixed = pairs.where((share > 0) & (share < 1))
    whole = [c for pair in counts for c in pair]
    apart = mixed.groupBy(*keys, *whole).agg(F.count("*").alias("times"))
    constant = _summed_lgamma(apart, keys, [t for n, k in counts for t in _choose(n, k)]).withColumnRenamed("ll", "constant")
    drawn = mixed.groupBy(*keys, share.alias("share"), alt.alias("alt"), total.alias("total")).agg(F.count("*").alias("times"))
    rows = drawn.withColumn("ne", F.explode(grid))
    a, b, n = F.col("share") * (F.col("ne") - 1), (F.lit(1.0) - F.col("share")) * (F.col("ne") - 1), F.col("ne") - 1
    terms = [(1, F.col("alt") + a), (1, F.col("total") - F.col("alt") + b), (-1, F.col("total") + n), (-1, a), (-1, b), (1, n)]
    sums = _summed_lgamma(rows, [*keys, "ne"], terms)
    every = sums.join(constant, keys) if keys else sums.crossJoin(F.broadcast(constant))  # one row
    return every.select(*keys, "ne", (F.col("ll") + F.col("constant")).alias("ll"))


def pooled(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value: the logarithm of the sum of exp(value) over each key's rows."""
    top = F.max(value).over(Window.partitionBy(*by))
    below = rows.select(*by, value, top.alias("__top")).groupBy(*by).agg(F.max("__top").alias("__top"), F.sum(F.exp(F.col(value) - F.col("__top"))).alias("__s"))
    return below.select(*by, (F.col("__top") + F.ln("__s")).alias(value))


def best_size(grid: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(ne, ll) of the highest value, ties to the smallest size."""
    top = F.max(F.struct("ll", (-F.col("ne")).alias("m"))).alias("t")
    return grid.groupBy(*(by or [])).agg(top).select(*(by or []), (-F.col("t.m")).alias("ne"), F.col("t.ll").alias("ll"))


def profile(grid: DataFrame) -> DataFrame:
    """(ne, ll, deviance): -2 times the fall from the highest value."""
    return grid.withColumn("deviance", -2 * (F.col("ll") - F.max("ll").over(Window.partitionBy())))


def profile_interval(grid: DataFrame) -> DataFrame:
    """(best, low, high, low_clipped, high_clipped): the sizes around the best one that fall by less than 1.92 without a gap."""
    whole = Window.partitionBy()
    best = F.max_by("ne", F.struct("ll", (-F.col("ne")).alias("m"))).over(whole)
    rows = grid.withColumns({"best": best, "top": F.max("ll").over(whole)}).withColumn("bad", F.col("ll") < F.col("top") - DROP)
    walls = rows.withColumns({"left": F.max(F.when(F.col("bad") & (F.col("ne") < F.col("best")), F.col("ne"))).over(whole), "right": F.min(F.when(F.col("bad") & (F.col("ne") > F.col("best")), F.col("ne"))).over(whole)})
    inside = (F.col("left").isNull() | (F.col("ne") > F.col("left"))) & (F.col("right").isNull() | (F.col("ne") < F.col("right")))
    return walls.where(inside).groupBy("best").agg(F.min("ne").alias("low"), F.max("ne").alias("high"), F.first("left").isNull().alias("low_clipped"), F.first("right").isNull().alias("high_clipped"))
