"""Cohort simulation and its moments."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mitoloom.functions.special import binomial_quantile

PAIRS = "pos int, fam string, mother string, child string, m_dp int, m_alt int, c_dp int, c_alt int, qc string"


def cohort(spark: SparkSession, pairs: int, sites: int, size: int, *, depth: int = 2000, generations: int = 1, model: str = "discrete", outliers: float = 0.0, missing: float = 0.0, seed: int = 1) -> DataFrame:
    """Mother-child pairs through a bottleneck of ``size``: multinomial (discrete) or Dirichlet (continuous) draws.

    Each pair has its own seed, so the cohort is the same however it is partitioned. Outliers get a child share of their own;
    missing rows carry LOW_DEPTH.
    """

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for i in frame["id"]:
                rng = np.random.default_rng([seed, int(i)])
                p = rng.uniform(0.1, 0.9, sites)
                q = p
                for _ in range(generations):
                    q = rng.binomial(size, q) / size if model == "discrete" else rng.beta(np.maximum(q * (size - 1), 1e-9), np.maximum((1 - q) * (size - 1), 1e-9))
                q = np.where(rng.random(sites) < outliers, rng.random(sites), q)
                out.append(pd.DataFrame({"pos": np.arange(1, sites + 1, dtype=np.int32), "fam": f"F{i}", "mother": f"M{i}", "child": f"C{i}", "m_dp": np.int32(depth), "m_alt": rng.binomial(depth, p).astype(np.int32), "c_dp": np.int32(depth), "c_alt": rng.binomial(depth, q).astype(np.int32), "qc": np.where(rng.random(sites) < missing, "LOW_DEPTH", "PASS")}))
            if out:
                yield pd.concat(out)

    return spark.range(pairs).mapInPandas(draw, PAIRS)


def offspring(pairs: DataFrame, size: int, order: Sequence[str], *, generations: int = 1, seed: int = 1) -> DataFrame:
    """pairs (p, c_dp, ...) with children drawn for their mothers through a bottleneck of ``size``, in place of c_alt and c.

    A draw is the quantile of a hash of the seed and the columns ``order``, so that it depends on neither partitions nor reruns.
    Each generation passes ``size`` copies on; the child's reads are then drawn from the last.
    """
    u = lambda k: (F.xxhash64(F.lit(seed), F.lit(k), *order).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / F.lit(float(1 << 52))
    rows = pairs.withColumn("__q", F.col("p"))
    for k in range(generations):
        rows = rows.withColumn("__q", binomial_quantile(F.lit(size), F.col("__q"), u(k)) / F.lit(float(size)))
    rows = rows.withColumn("c_alt", binomial_quantile(F.col("c_dp"), F.col("__q"), u(generations)).cast("int"))
    return rows.withColumn("c", F.try_divide("c_alt", "c_dp")).drop("__q")


def expected_drift(size: float, generations: int) -> float:
    """E[F] = 1 - (1 - 1/size)^generations."""
    return 1 - (1 - 1 / size) ** generations
