"""Annotation: a star of keyed dimensions, trinucleotides, pairing of RNA bases, alignment columns, NUMT correlation."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from mitoloom.functions import numeric
from mitoloom.operators.drift import ranked

# Base pairs of Watson and Crick.
PAIRS = ("AT", "TA", "AU", "UA", "CG", "GC")


def star(variants: DataFrame, dimensions: list[tuple[DataFrame, list[str], dict[str, object]]]) -> DataFrame:
    """Left joins of dimensions (table, key, defaults by column); a key must be unique in its table.

    Spark broadcasts each dimension that its statistics show to be small and shuffles the others.
    """
    for table, key, defaults in dimensions:
        names = {k: f"__k_{k}" for k in key}
        right = table.select(*[F.col(k).alias(names[k]) for k in key], *defaults)
        condition = [variants[k].eqNullSafe(right[names[k]]) for k in key]
        variants = variants.join(right, condition, "left").drop(*names.values()).fillna({c: d for c, d in defaults.items() if d is not None})
    return variants


def membership(rows: DataFrame, members: DataFrame, key: list[str], name: str) -> DataFrame:
    """rows plus a 0/1 column: whether the key is in the list."""
    marked = members.select(*key).distinct().withColumn("__in", F.lit(1))
    return rows.join(marked, key, "left").withColumn(name, F.coalesce("__in", F.lit(0))).drop("__in")


def circular_neighbours(bases: DataFrame, by: list[str]) -> DataFrame:
    """bases (pos, base) plus before and after, round the end; a spacer N counts as no position."""
    kept = bases.where("base <> 'N'")
    order, whole = Window.partitionBy(*by).orderBy("pos"), Window.partitionBy(*by)
    first, last = F.min_by("base", "pos").over(whole), F.max_by("base", "pos").over(whole)
    return kept.withColumns({"before": F.coalesce(F.lag("base").over(order), last), "after": F.coalesce(F.lead("base").over(order), first)})


def base_pairing(bases: DataFrame) -> DataFrame:
    """bases (gene, pos, base, pair_pos) plus pairing: WC, non-WC or loop, by the base at pair_pos of the same gene."""
    other = bases.select("gene", F.col("pos").alias("pair_pos"), F.col("base").alias("pair_base"))
    joined = bases.join(other, ["gene", "pair_pos"], "left")
    return joined.withColumn("pairing", F.when(F.col("pair_base").isNull(), "loop").when(F.concat("base", "pair_base").isin(*PAIRS), "WC").otherwise("non-WC"))


def alignment_columns(rows: DataFrame, one: Column, other: Column, start: int, length: int, keep: Sequence[str] = ()) -> DataFrame:
    """keep, pos, one, other: a row for each column where ``one`` has no gap, numbered from ``start`` round ``length``.

    Places come from exploding and are numbered in generated code; only gaps are told by a function over the array.
    """
    both = F.arrays_zip(F.split(one, "").alias("one"), F.split(other, "").alias("other"))
    kept = F.filter(both, lambda x: (x["one"] != "-") & (x["one"] != ""))
    columns = rows.select(*keep, F.posexplode(kept).alias("__i", "__x"))
    return columns.select(*keep, (F.pmod(F.col("__i") + (start - 1), F.lit(length)) + 1).alias("pos"), F.col("__x.one").alias("one"), F.col("__x.other").alias("other"))


def spearman(rows: DataFrame, by: list[str], x: str, y: str, least: int) -> DataFrame:
    """Rank correlation by key, for keys with ``least`` rows or more; ranks are averages over ties."""
    one = ranked(rows, x, by).withColumnRenamed("avg_rank", "rx")
    both = ranked(one, y, by).withColumnRenamed("avg_rank", "ry")
    return both.groupBy(*by).agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("rho")).where(F.col("n") >= least)


def rank_sums(rows: DataFrame, by: list[str], value: str, first: str) -> DataFrame:
    """by, n1, n2, z, p: the rank-sum test of the rows where ``first`` is true against the others, without a correction for ties.

    Ranks are averages over ties, the largest value first. Rows whose value is null take no part; a key with one side only has
    null z and p.
    """
    ranks = ranked(rows.where(F.col(value).isNotNull()).withColumn("__down", -F.col(value)), "__down", by)
    one = F.col(first)
    sums = ranks.groupBy(*by).agg(F.count_if(one).alias("n1"), F.count_if(~one).alias("n2"), F.sum(F.when(one, F.col("avg_rank"))).alias("__s"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    z = F.try_divide(F.col("__s") - n1 * (n1 + n2 + 1) / 2, F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12))
    return sums.withColumn("z", z).withColumn("p", two_sided("z")).drop("__s")


@F.pandas_udf(DoubleType())
def two_sided(z: pd.Series) -> pd.Series:
    """Probability that a standard normal number lies further from 0 than z; null for null."""
    return z.map(lambda x: 2 * numeric.normal_tail(abs(x)), na_action="ignore").astype(float)


def inbreeding(counts: DataFrame) -> DataFrame:
    """counts (hom_ref, het, hom_alt) plus f = 1 - het / (2 p q n); null for sites with one allele."""
    n = F.col("hom_ref") + F.col("het") + F.col("hom_alt")
    p = (2 * F.col("hom_ref") + F.col("het")) / (2 * n)
    return counts.withColumn("f", F.lit(1.0) - F.try_divide(F.col("het"), 2 * p * (F.lit(1.0) - p) * n))


def merged_by_position(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Union in which the second side's rows replace the first's with the same key."""
    both = first.withColumn("__side", F.lit(0)).unionByName(second.withColumn("__side", F.lit(1)))
    return both.withColumn("__last", F.max("__side").over(Window.partitionBy(*key))).where("__side = __last").drop("__side", "__last")


def unshifted(pos: Column, shift: int = 8000, length: int = 16569) -> Column:
    """Positions of a reference turned by ``shift`` back on the plain one."""
    return F.when(pos <= length - shift, pos + shift).otherwise(pos - (length - shift))


def residue_positions(residues: DataFrame, codons: DataFrame, key: list[str]) -> DataFrame:
    """Each residue with the positions of its codon (codons: key, pos); residues that no codon makes give none."""
    return residues.join(codons.select(*key, "pos").distinct(), key)
