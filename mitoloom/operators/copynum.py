"""Copy numbers: fragments by contig, length-normalised ratios, and ratios to the autosomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mitoloom.functions.alleles import autosome, base_count, gc_count, mitochondrial
from mitoloom.operators.filters import PAIRED, flag


def paired_end(reads: DataFrame, first: int = 1000) -> DataFrame:
    """(paired): whether any of the first mapped reads is paired."""
    return reads.where(~flag("flag", 4)).orderBy("read_id").limit(first).agg(F.coalesce(F.bool_or(flag("flag", PAIRED)), F.lit(False)).alias("paired"))


def fragments(reads: DataFrame, paired: bool) -> DataFrame:
    """Fragments by contig: reads for single ends; for paired ones first reads, and reads whose mate has no first read there."""
    if not paired:
        return reads.groupBy(F.col("rname").alias("contig")).agg(F.count("*").alias("fragments"))
    names = reads.groupBy("rname", "qname").agg(F.count_if(flag("flag", 64)).alias("__first"))
    return names.groupBy(F.col("rname").alias("contig")).agg(F.sum(F.greatest("__first", F.lit(1))).alias("fragments"))


def ratios(counts: DataFrame) -> DataFrame:
    """counts (contig, fragments, length) plus ratio: share of fragments over share of length."""
    whole = Window.partitionBy()
    return counts.withColumn("ratio", (F.col("fragments") / F.sum("fragments").over(whole)) / (F.col("length") / F.sum("length").over(whole)))


def copy_numbers(normalised: DataFrame) -> DataFrame:
    """contig, ratio, cn, cn_low, cn_high: mean over autosomes of weight * ratio / autosome's ratio, with 1.96 standard errors.

    The weight is 2 for mitochondrial contigs, else 1. One autosome collapses the interval; none gives zeros. There are at most
    22 autosomes, so the pairing is 22 rows a contig.
    """
    autosomes = normalised.where(autosome(F.col("contig")) & (F.col("ratio") > 0)).select(F.col("contig").alias("__a"), F.col("ratio").alias("__r"))
    pairs = normalised.join(autosomes, F.lit(True), "left")
    weight = F.when(mitochondrial(F.col("contig")), 2.0).otherwise(1.0)
    value = weight * F.col("ratio") / F.col("__r")
    out = pairs.groupBy("contig", "ratio").agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("cn"), F.coalesce(F.when(F.count(value) > 1, 1.96 * F.stddev_samp(value) / F.sqrt(F.count(value))), F.lit(0.0)).alias("__h"))
    return out.withColumns({"cn_low": F.col("cn") - F.col("__h"), "cn_high": F.col("cn") + F.col("__h")}).drop("__h")


def gc_share(sequences: DataFrame, by: str, sequence: str) -> DataFrame:
    """GC over A, C, G and T of all sequences of a key, so longer ones weigh more; null without bases."""
    return sequences.groupBy(by).agg(F.try_divide(F.sum(gc_count(F.col(sequence))), F.sum(base_count(F.col(sequence)))).alias("gc"))
