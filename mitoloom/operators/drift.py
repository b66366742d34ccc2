"""Drift moments: retention b, bins, grids, trimming and outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mitoloom.operators.ordered import numbered, running

CLIP = 1e-9


def terms(pairs: DataFrame) -> DataFrame:
    """pairs (p, c, m_dp, c_dp) plus w = p(1-p), d = (c-p)^2, s (expected sampling variance), r = d - s, F = r / w."""
    p, c = F.col("p"), F.col("c")
    w = p * (F.lit(1.0) - p)
    sampling = w / F.col("m_dp") + c * (F.lit(1.0) - c) / F.col("c_dp")
    rows = pairs.where((p > 0) & (p < 1)).withColumns({"w": w, "d": (c - p) * (c - p), "s": sampling})
    return rows.withColumn("r", F.col("d") - F.col("s")).withColumn("f", F.col("r") / F.col("w"))


def retention() -> Column:
    """b = 1 - sum r / sum w, kept within [1e-9, 1 - 1e-9]."""
    return F.least(F.lit(1 - CLIP), F.greatest(F.lit(CLIP), F.lit(1.0) - F.sum("r") / F.sum("w")))


def kimura(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """b, ne = 1 / (1 - b) and n, over all rows or by key."""
    out = rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), retention().alias("b"))
    return out.withColumn("ne", F.lit(1.0) / (F.lit(1.0) - F.col("b")))


def trimmed(rows: DataFrame, share: float, order: list[str]) -> DataFrame:
    """rows without the floor(share * n) of highest F; ties by ``order``, and among rows that tie there too, any of them.

    Rows are numbered over ranges of F, so no task sees more than its range. No rows give none.
    """
    drop = int(share * rows.count())
    if not drop:
        return rows
    return numbered(rows, [F.col("f").desc(), *map(F.col, order)], "__n").where(F.col("__n") >= drop).drop("__n")


def outliers(rows: DataFrame, k: int, order: list[str]) -> DataFrame:
    """The k rows of highest F."""
    return rows.orderBy(F.col("f").desc(), *order).limit(k)


def binned(rows: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """Counts, mean share, mean F and its standard error by bin of p; empty bins are there with n 0."""
    width = (high - low) / bins
    index = F.least(F.greatest(F.floor((F.col("p") - low) / width), F.lit(0)), F.lit(bins - 1)).cast("int")
    found = rows.groupBy(index.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("f").alias("mean_f"), (F.stddev_samp("f") / F.sqrt(F.count("*"))).alias("se_f"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").fillna({"n": 0})


def squared_residuals(rows: DataFrame, sizes: list[float]) -> DataFrame:
    """sum (r - w / ne)^2 for each ne, from three sums; and the best 1/ne, sum rw / sum w^2."""
    sums = rows.agg(F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("r") * F.col("w")).alias("rw"), F.sum(F.col("w") * F.col("w")).alias("ww"))
    grid = F.explode(F.array(*[F.lit(float(x)) for x in sizes])).alias("ne")
    return sums.select("rr", "rw", "ww", grid).select("ne", (F.col("rr") - 2 * F.col("rw") / F.col("ne") + F.col("ww") / (F.col("ne") * F.col("ne"))).alias("ssr"), F.try_divide("ww", "rw").alias("best_ne"))


def expected(p: Column, ne: Column) -> Column:
    return p * (F.lit(1.0) - p) / ne


def kept_share(ne: Column, generations: Column) -> Column:
    """(1 - 1/ne)^t."""
    return F.pow(F.lit(1.0) - F.lit(1.0) / ne, generations)


def bootstrap(rows: DataFrame, times: int, seed: int, order: list[str]) -> DataFrame:
    """(low, high): 2.5 and 97.5 percent of b over resamples with replacement, by Poisson weights from a hash of row and draw.

    Each resample is a weighted sum, so the rows are never shuffled: the partial sums are one row for each draw and partition.
    """
    u = (F.xxhash64(F.lit(seed), F.col("draw"), *order).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / F.lit(float(1 << 52))
    weight, below = F.lit(0), 0.0
    term = 0.36787944117144233
    for k in range(1, 9):
        below += term
        weight = weight + F.when(u > below, 1).otherwise(0)
        term /= k
    drawn = rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(times)))).withColumn("k", weight)
    each = drawn.groupBy("draw").agg(F.least(F.lit(1 - CLIP), F.greatest(F.lit(CLIP), F.lit(1.0) - F.try_divide(F.sum(F.col("k") * F.col("r")), F.sum(F.col("k") * F.col("w"))))).alias("b"))
    return each.agg(F.percentile("b", F.lit(0.025)).alias("low"), F.percentile("b", F.lit(0.975)).alias("high"))


def ranked(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """rows plus avg_rank: average ranks with ties, from counts of each value rather than a sort of all rows."""
    counts = rows.groupBy(*(by or []), value).agg(F.count("*").alias("__n"))
    if by:
        upto = counts.withColumn("__upto", F.sum("__n").over(Window.partitionBy(*by).orderBy(value)))
    else:
        upto = running(counts, F.col("__n"), [F.col(value)], "__upto")
    placed = upto.select(*(by or []), value, (F.col("__upto") - F.col("__n") + (F.col("__n") + 1) / 2).alias("avg_rank"))
    return rows.join(placed, [*(by or []), value])
