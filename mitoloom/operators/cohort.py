"""Cohort records: site summaries, subsets, tidy rows, allele clean-up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mitoloom.functions import alleles as al


def _genotypes(calls: DataFrame, mode: str) -> DataFrame:
    """A row for each site and sample: depth, and whether its genotype is ref, hom or het.

    In a fresh call each allele stands once, so that two make a mixed genotype; a genotype of a file may repeat one, and is
    mixed only if its alleles differ.
    """
    het = F.count("*") > 1 if mode == "call" else F.min("idx") < F.max("idx")
    return calls.where("idx IS NOT NULL").groupBy("pos", "sample").agg(F.max("dp").alias("dp"), het.alias("het"), F.max("idx").alias("top"))


def site_info(calls: DataFrame, mode: str = "call") -> DataFrame:
    """AN, REF_N, HET_N, HOM_N, DP_MEAN, DP_MEDIAN and PT of each site.

    calls has a row for each site, sample and allele of the sample's genotype: pos, sample, idx (0: reference, null: missing) and
    dp. AN counts the samples with a genotype. ``call`` rounds depths half to even, ``subset`` truncates them, both over known
    ones. A site is Ref, Hom, Het or Mixed by what its samples are; sites without a genotype give no row.
    """
    ref, hom = ~F.col("het") & (F.col("top") == 0), ~F.col("het") & (F.col("top") > 0)
    depth = (lambda c: F.bround(c).cast("bigint")) if mode == "call" else (lambda c: F.floor(c).cast("bigint"))
    counts = {"an": F.count("*"), "ref_n": F.count_if(ref), "het_n": F.count_if("het"), "hom_n": F.count_if(hom)}
    depths = {"dp_mean": depth(F.avg("dp")), "dp_median": depth(F.percentile("dp", F.lit(0.5)))}
    sites = _genotypes(calls, mode).groupBy("pos").agg(*[c.alias(name) for name, c in (counts | depths).items()])
    varied = F.when((F.col("het_n") > 0) & (F.col("hom_n") > 0), "Mixed").when(F.col("het_n") > 0, "Het")
    return sites.withColumn("pt", varied.when(F.col("hom_n") > 0, "Hom").when(F.col("ref_n") > 0, "Ref").otherwise("Unknown"))


def alt_shares(calls: DataFrame, mode: str = "call") -> DataFrame:
    """(pos, idx, vaf_mean, vaf_mean_het) of each site's alternative alleles.

    The first mean counts every sample with a genotype, 0 where it lacks the allele; the second counts the mixed genotypes with
    it, and is 0 without any. ``subset`` takes shares in single precision, as files hold them; unknown shares are left out.
    """
    share = F.col("af") if mode == "call" else F.col("af").cast("float").cast("double")
    samples = _genotypes(calls, mode)
    alts = calls.where("idx > 0").join(samples.select("pos", "sample", "het"), ["pos", "sample"])
    means = alts.groupBy("pos", "idx").agg(F.coalesce(F.sum(share), F.lit(0.0)).alias("total"), F.coalesce(F.avg(F.when(F.col("het"), share)), F.lit(0.0)).alias("vaf_mean_het"))
    counted = samples.groupBy("pos").agg(F.count("*").alias("an"))
    return means.join(counted, "pos").select("pos", "idx", (F.col("total") / F.col("an")).alias("vaf_mean"), "vaf_mean_het")


def rebased(calls: DataFrame, by: list[str]) -> DataFrame:
    """calls of several samples brought onto one reference a site: site_ref, alt and idx (0: reference, then by length and text).

    ref is an allele's own reference, and allele is a base, ``+`` with the inserted or ``-`` with the deleted bases. The site's
    reference is the longest of them; every alternative is extended to its end.
    """
    first = calls.groupBy(*by).agg(F.max_by("ref", F.struct(F.length("ref"), "ref")).alias("site_ref"))
    ref, allele = F.col("ref"), F.col("allele")
    own = F.when(allele.startswith("-"), F.substring(ref, F.lit(1), F.lit(1))).when(allele.startswith("+"), F.concat(ref, F.substring(allele, F.lit(2), F.length(allele)))).otherwise(allele)
    whole = al.rebased(ref, own, F.col("site_ref"))
    named = calls.join(first, by).withColumn("alt", whole)
    alts = named.where("alt <> site_ref").groupBy(*by).agg(F.array_sort(F.collect_set(F.struct(F.length("alt").alias("n"), "alt"))).alias("alts"))
    with_alts = named.join(alts, by, "left").withColumn("alts", F.coalesce(F.col("alts.alt"), F.array().cast("array<string>")))
    return with_alts.withColumn("idx", F.array_position("alts", F.col("alt")).cast("int"))


def subset(calls: DataFrame, samples: DataFrame, keep_all: bool = False) -> DataFrame:
    """calls of the listed samples (column sample, distinct); sites without depth or without an alternative go unless kept."""
    chosen = calls.join(samples.select("sample").distinct(), "sample", "left_semi")
    if keep_all:
        return chosen
    site = Window.partitionBy("pos")
    return chosen.withColumns({"__d": F.sum("dp").over(site), "__i": F.max("idx").over(site)}).where("__d > 0 AND __i > 0").drop("__d", "__i")


def absent_samples(calls: DataFrame, samples: DataFrame) -> DataFrame:
    return samples.join(calls.select("sample").distinct(), "sample", "left_anti")


def tidy(records: DataFrame) -> DataFrame:
    """A row for each allele of a genotype, from arrays aligned to it; the reference allele of a mixed genotype is left out."""
    rows = records.withColumn("__a", F.explode(F.arrays_zip(F.col("gt").alias("gt"), F.col("alleles").alias("allele"), F.col("ad").alias("ad"), F.col("af").alias("af"))))
    several = F.size("gt") > 1
    return rows.where(~(several & (F.col("__a.gt") == 0))).select(*[c for c in records.columns if c not in ("gt", "alleles", "ad", "af")], F.col("__a.gt").alias("idx"), F.col("__a.allele").alias("allele"), F.col("__a.ad").alias("ad"), F.col("__a.af").alias("af"))


def reindexed(calls: DataFrame, by: list[str]) -> DataFrame:
    """Allele numbers made dense again after a filter, in their old order."""
    return calls.withColumn("new_idx", F.dense_rank().over(Window.partitionBy(*by).orderBy("idx")) - 1)


def renamed_format(text: Column) -> Column:
    """Older FORMAT keys under their present names."""
    for old, new in (("LHF", "LAF"), ("HF", "AF"), ("HQ", "AQ")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def allele_counts(calls: DataFrame) -> DataFrame:
    """AC, AN and AF of each site's alternative alleles."""
    counted = calls.groupBy("pos", "idx").agg(F.count("*").alias("ac"))
    total = counted.withColumn("an", F.sum("ac").over(Window.partitionBy("pos")))
    return total.where("idx > 0").withColumn("af", F.col("ac") / F.col("an"))


def by_length(alleles: Column) -> Column:
    """An array of texts by length, then by code points."""
    return F.transform(F.array_sort(F.transform(alleles, lambda a: F.struct(F.length(a).alias("n"), a.alias("a")))), lambda x: x["a"])


def allele_universe(seen: DataFrame, by: list[str]) -> DataFrame:
    """by, alleles: all alleles seen and the four bases, by length, then text. N and null alleles do not count."""
    named = F.when(F.col("allele") != "N", F.col("allele"))
    return seen.groupBy(*by).agg(by_length(F.array_union(F.collect_set(named), F.array(*map(F.lit, "ACGT")))).alias("alleles"))


def first_seen(rows: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    """The value of each key's first row by ``order``, which should leave no ties; rows with a null there or for a value take no part."""
    whole = reduce(lambda a, c: a & F.col(c).isNotNull(), order, F.col(value).isNotNull())
    return rows.groupBy(*by).agg(F.min_by(value, F.when(whole, F.struct(*order))).alias(value))


def major_alleles(calls: DataFrame, by: list[str]) -> DataFrame:
    """by, allele, ad: the deepest allele, the first by text of equal ones."""
    top = calls.groupBy(*by).agg(F.min_by(F.struct("allele", "ad"), F.struct((-F.col("ad")).alias("m"), "allele")).alias("__t"))
    return top.select(*by, "__t.allele", "__t.ad")


def indel_shares(calls: DataFrame, by: list[str], indel: Column, least: float) -> DataFrame:
    """by, indel, n, share: the depth of indels and of the rest out of all, where that is ``least`` or more."""
    split = calls.groupBy(*by, indel.cast("int").alias("indel")).agg(F.sum("ad").alias("n"), F.max("dp").alias("__dp"))
    return split.withColumn("share", F.try_divide("n", "__dp")).where(F.col("share") >= least).drop("__dp")


def site_alleles(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, longest (the longest reference, of equal ones the last by text) and alts (different alternatives, by length, then text)."""
    return rows.groupBy(*by).agg(F.max_by("ref", F.struct(F.length("ref"), "ref")).alias("longest"), by_length(F.collect_set("alt")).alias("alts"))


def site_quality(calls: DataFrame, by: list[str], below: float) -> DataFrame:
    """by, quality: the best of the samples' qualities that lie below a number which stands for no bound; null without any."""
    return calls.groupBy(*by).agg(F.max(F.when(F.col("qual") < below, F.col("qual"))).alias("quality"))


def used_alleles(calls: DataFrame, by: list[str]) -> DataFrame:
    """by, used: the alternatives that some genotype names, by length, then text; empty where all are the reference."""
    return calls.groupBy(*by).agg(by_length(F.collect_set(F.when(F.col("idx") > 0, F.col("allele")))).alias("used"))


def site_pass(calls: DataFrame, by: list[str], mutation: Column) -> DataFrame:
    """by, pass: whether any sample's call is a mutation; unknown ones are not."""
    return calls.groupBy(*by).agg(F.bool_or(F.coalesce(mutation, F.lit(False))).alias("pass"))


def sample_counts(calls: DataFrame, good: Column) -> DataFrame:
    """sample, total, good: how many alternatives each sample has, and how many of them are good."""
    return calls.where("idx > 0").groupBy("sample").agg(F.count("*").alias("total"), F.count_if(good).alias("good"))


def varied_sites(calls: DataFrame, by: list[str]) -> DataFrame:
    """Sites with some depth and some sample that is not the reference."""
    return calls.groupBy(*by).agg(F.sum("dp").alias("__d"), F.max("idx").alias("__i")).where("__d > 0 AND __i > 0").select(*by)


def tidy_calls(calls: DataFrame) -> DataFrame:
    """Known alleles, without the reference allele of mixed genotypes."""
    return calls.where("idx IS NOT NULL AND NOT (idx = 0 AND ploidy > 1)")


def mixed_alternatives(calls: DataFrame) -> DataFrame:
    """The alternatives of mixed genotypes."""
    return calls.where("ploidy > 1 AND idx > 0")


def with_results(calls: DataFrame, results: DataFrame, sites: DataFrame) -> DataFrame:
    """calls with what is known of their sample at the site (results: pos, sample, ...) and of the site (sites: pos, ...), else null."""
    return calls.join(results, ["pos", "sample"], "left").join(sites, "pos", "left")


def with_metadata(calls: DataFrame, metadata: DataFrame, key: list[str]) -> DataFrame:
    """All calls, with their sample's metadata where there is any."""
    return metadata.join(calls, key, "right")
