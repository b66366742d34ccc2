"""Small aggregates by key: intervals of means, quantiles, extremes, duplicates, every so-manyth row of a key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mitoloom.operators.ordered import running


def mean_interval(rows: DataFrame, by: Sequence[str], value: str, z: float = 1.96) -> DataFrame:
    """by, n, mean, half (half the width of the mean's interval), low, high. One value has no width; null values take no part, and a
    key without others has zeros."""
    n, mean, sd = F.count(value), F.avg(value), F.stddev_samp(value)
    half = F.when(n > 1, z * sd / F.sqrt(n)).otherwise(F.lit(0.0))
    out = rows.groupBy(*by).agg(n.alias("n"), F.coalesce(mean, F.lit(0.0)).alias("mean"), half.alias("half"))
    return out.withColumns({"low": F.col("mean") - F.col("half"), "high": F.col("mean") + F.col("half")})


def summary(rows: DataFrame, by: Sequence[str], value: str, ident: str) -> DataFrame:
    """by, n, mean, median (of an even number, between the middle two), sd, at_min, at_max: the ids of the extremes, the smallest of
    equal ones."""
    low, high = F.struct(F.col(value), F.col(ident)), F.struct(F.col(value), -F.col(ident))
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_samp(value).alias("sd"), F.min_by(ident, low).alias("at_min"), F.max_by(ident, high).alias("at_max"))


def quantiles(rows: DataFrame, by: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """by and q0, q1, ...: values at the shares, on the line between the two nearest.

    Equal values are counted first, and places come from counts carried over ranges of (by, value), so that no task holds a key.
    """
    counted = rows.groupBy(*by, F.col(value).cast("double").alias("__value")).agg(F.count(value).alias("__n"))
    placed = running(counted, F.col("__n"), [F.col(c) for c in (*by, "__value")], "__to")
    keys = [F.col(c).alias(f"__key{i}") for i, c in enumerate(by)]
    ends = placed.groupBy(*keys).agg(F.sum("__n").alias("__all"), F.min(F.col("__to") - F.col("__n")).alias("__start"))
    same = reduce(lambda a, i: a & F.col(by[i]).eqNullSafe(F.col(f"__key{i}")), range(len(by)), F.lit(True))
    to = F.col("__to") - F.col("__start")
    at = lambda place: F.max(F.when((to - F.col("__n") <= place) & (place < to), F.col("__value")))
    whole = [(F.col("__all") - 1) * F.lit(float(s)) for s in shares]
    found = placed.join(ends, same).groupBy(*by).agg(*[x for i, p in enumerate(whole) for x in (at(F.floor(p)).alias(f"__l{i}"), at(F.ceil(p)).alias(f"__h{i}"), F.first(p).alias(f"__p{i}"))])

    def between(i: int) -> Column:
        low, high, p = F.col(f"__l{i}"), F.col(f"__h{i}"), F.col(f"__p{i}")
        return F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)

    return found.select(*by, *[between(i).alias(f"q{i}") for i in range(len(shares))])


def duplicates(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that several rows have, and how many; null counts as a value."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def every_nth_of(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], step: int) -> DataFrame:
    """The first of every ``step`` rows of each key; see ordered.every_nth for one order over a whole table."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("__place", place).where((F.col("__place") - 1) % step == 0).drop("__place")


def first_rows(rows: DataFrame, order: Sequence[Column | str], most: int) -> DataFrame:
    """The first ``most`` rows of an order."""
    return rows.orderBy(*order).limit(most)


def concatenated(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of all parts, by column name; a column that some part lacks is null there."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
