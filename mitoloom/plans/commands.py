"""The commands over files: read, run the operators, write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mitoloom.functions import alleles as al
from mitoloom.operators import annotate, cohort, copynum, filters, intervals
from mitoloom.plans import bottleneck
from mitoloom.sources import sinks, text


def records_of(spark: SparkSession, path: str) -> DataFrame:
    """A VCF's calls, a row for each record and sample: chrom, pos, ref, alts, filter, sample, gt, ad, dp, af, aq."""
    rows, _ = text.vcf(spark, path)
    field = lambda key: F.get(F.map_values(F.map_filter("fields", lambda k, _: k == key)), F.lit(0))
    return rows.where("sample IS NOT NULL").select("record", "chrom", "pos", "ref", "alts", "filter", "sample", al.genotype(field("GT")).alias("gt"), text.numbers(field("AD")).alias("ad"), field("DP").try_cast("int").alias("dp"), text.numbers(field("AF"), "double").alias("af"), text.numbers(field("AQ"), "double").alias("aq"))


def long_calls(records: DataFrame) -> DataFrame:
    """A row for each allele of each genotype, from arrays that are aligned to it."""
    rows = records.withColumn("a", F.explode(F.arrays_zip(F.col("gt").alias("idx"), F.col("ad").alias("ad"), F.col("af").alias("af"), F.col("aq").alias("aq"))))
    known = rows.where("a.idx IS NOT NULL")
    return known.select(F.struct("record", "chrom", "pos").alias("pos"), "ref", "alts", "sample", "a.idx", "a.ad", "a.af", "a.aq", "dp", F.size("gt").alias("ploidy"))


def subsam(spark: SparkSession, path: str, samples: list[str], keep_all: bool = False) -> DataFrame:
    """Recomputed site INFO of a subset of a VCF's samples, a row for each site and alternative that they have (idx null without
    any); a sample that the file lacks raises."""
    calls = long_calls(records_of(spark, path))
    asked = spark.createDataFrame([(s,) for s in samples], "sample string")
    absent = [r["sample"] for r in cohort.absent_samples(records_of(spark, path), asked).collect()]
    if absent:
        raise ValueError(f"samples not in the file: {absent}")
    kept = cohort.subset(calls, asked, keep_all)
    return cohort.site_info(kept, "subset").join(cohort.alt_shares(kept, "subset"), "pos", "left")


def copy_number_report(reads: DataFrame, contigs: DataFrame, regions: DataFrame | None = None, min_mapq: int = 0) -> DataFrame:
    """contig, fragments, length, ratio, cn and its interval; with regions, reads count whose 5' end lies in a merged region."""
    kept = filters.countable(reads, min_mapq)
    lengths = contigs.select("contig", "length")
    if regions is not None:
        cut, _ = intervals.clamped(regions, contigs)
        islands = intervals.merged(cut, ["chrom"])
        anchor = F.when(filters.flag("flag", filters.REVERSE), F.col("ref_end")).otherwise(F.col("pos") + 1)
        kept = intervals.binned_join(kept.withColumns({"chrom": F.col("rname"), "__at": anchor}), islands.drop("n"), "__at", ["chrom"], how="left_semi").drop("chrom", "__at")
        lengths = intervals.effective_lengths(lengths, cut).select("contig", F.col("effective_length").alias("length")).where("length > 0")
    paired = bool(copynum.paired_end(kept.withColumn("read_id", F.monotonically_increasing_id())).first().paired)
    counts = lengths.join(copynum.fragments(kept, paired), "contig", "left").fillna({"fragments": 0})
    rows = copynum.ratios(counts)
    return rows.join(copynum.copy_numbers(rows).drop("ratio"), "contig")


def transmission_table(spark: SparkSession, vcf: str, fam: str, out: str, grandmothers: str | None = None, least_depth: int = 500) -> DataFrame:
    """Pairs of a VCF and a FAM file, written as the pair table."""
    from mitoloom.operators import pedigree

    trios = text.fam(spark, fam).where("ok")
    links = text.fam(spark, grandmothers) if grandmothers else trios
    pairs = bottleneck.from_records(pedigree.with_grandmother(trios, links).select("fam", "child", "mother", "grandmother"), records_of(spark, vcf), least_depth)
    rows = sinks.pair_rows(pairs)
    sinks.write_table(rows, out)
    return rows


def tidy_table(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, ref, alt, sample, type, ad, dp, vaf of a VCF's alternative alleles, without common suffixes."""
    calls = long_calls(records_of(spark, path)).where("idx > 0 OR ploidy = 1")
    rows = calls.select("pos.chrom", "pos.pos", "ref", F.when(F.col("idx") > 0, F.get("alts", F.col("idx") - 1)).otherwise(F.col("ref")).alias("alt"), "sample", "ad", "dp", F.col("af").alias("vaf"))
    return al.suffix_trimmed(rows).withColumn("type", al.allele_class(F.col("ref"), F.col("alt")))


def numt_candidates(calls: DataFrame, least: int = 15, rho: float = -0.4) -> DataFrame:
    """Variants (pos, alt) whose share falls with the copy number: Spearman over log10(copynum + 1) below rho."""
    rows = calls.withColumn("__cn", F.log10(F.col("copynum") + 1))
    return annotate.spearman(rows, ["pos", "alt"], "__cn", "vaf", least).where(F.col("rho") < rho)
