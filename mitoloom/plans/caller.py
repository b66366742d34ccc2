"""The caller: reads and a reference to calls by sample and site, in two shuffles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mitoloom.functions import alleles as al
from mitoloom.functions import stats as st
from mitoloom.functions.numeric import Site, allele_sets
from mitoloom.operators import cohort, filters, pileup

#: Het threshold as a single-precision number widened to double, so that products with depths truncate alike.
HET = float(np.float32(0.01))
CALL = "sample string, contig string, pos int, ref string, allele string, ad int, dp int, af double, quality double, fwd int, rev int, major string, major_ad int, major_fwd int, major_rev int"


def called_alleles(table: DataFrame, het: float = HET) -> DataFrame:
    """Calls by likelihood from (sample, contig, pos, ref, allele, strand, qual, n): n equal observations.

    Observations are counted before they travel, so a position's group is bounded by alleles * strands * qualities, however deep
    the sequencing, and EM weighs each by its count. All positions of an Arrow batch go through EM together. ref is the allele's
    own reference; alleles that begin with N count for nothing.
    """

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys, sites, refs, forward = [], [], [], []
            for sample, contig, pos, seen in zip(frame["sample"], frame["contig"], frame["pos"], frame["seen"], strict=True):
                names = sorted({x["allele"] for x in seen} | set("ACGT"), key=lambda a: (len(a), a))
                place = {a: i for i, a in enumerate(names)}
                counts: dict[tuple[int, int], int] = {}
                strands, own = np.zeros(len(names), dtype=np.int64), {}
                for x in seen:
                    i = place[x["allele"]]
                    counts[i, x["qual"]] = counts.get((i, x["qual"]), 0) + x["n"]
                    strands[i] += x["n"] if x["strand"] == "+" else 0
                    own[i] = min(own.get(i, x["ref"]), x["ref"])
                which, quality = (np.array(c) for c in zip(*counts, strict=True))
                keys.append((sample, contig, pos))
                sites.append(Site(names, which, 10 ** (-quality.astype(float) / 10), np.array(list(counts.values()), dtype=float)))
                refs.append(own)
                forward.append(strands)
            out = []
            for key, site, own, fwd, (chosen, quality) in zip(keys, sites, refs, forward, allele_sets(sites, het), strict=True):
                if not chosen:
                    continue
                depth, total = site.depth.astype(int), int(site.total)
                top = max(chosen, key=lambda i, depth=depth: (depth[i], -i))
                out += [(*key, own[i], site.names[i], depth[i], total, depth[i] / total, quality, fwd[i], depth[i] - fwd[i], site.names[top], depth[top], fwd[top], depth[top] - fwd[top]) for i in chosen]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CALL.split(", ")])

    known = table.where(~F.upper("allele").startswith("N"))
    counted = known.groupBy("sample", "contig", "pos", "ref", "allele", "strand", "qual").agg(F.sum("n").cast("int").alias("n"))
    sites = counted.groupBy("sample", "contig", "pos").agg(F.collect_list(F.struct("ref", "allele", "strand", "qual", "n")).alias("seen"))
    return sites.mapInPandas(call, CALL)


def with_statistics(calls: DataFrame, het: float = HET) -> DataFrame:
    """calls plus ci_low, ci_high, fs, sor, aq, laf and type."""
    low, high = st.proportion_interval(F.col("ad"), F.col("dp"))
    is_major = F.col("allele") == F.col("major")
    half = F.floor(F.col("ad") / 2).cast("int")
    mf, mr = F.when(is_major, half).otherwise(F.col("major_fwd")), F.when(is_major, half).otherwise(F.col("major_rev"))
    minor = F.floor(F.lit(het) * F.col("dp")).cast("int")
    expected = F.floor(F.lit(1 - het) * F.col("dp")).cast("int")
    aq = st.phred(st.fisher_less(F.col("major_ad"), F.col("ad"), expected, minor)).cast("int")
    kind = F.when(F.col("allele").startswith("+"), "INS").when(F.col("allele").startswith("-"), "DEL").otherwise(al.allele_class(F.col("ref"), F.col("allele")))
    return calls.withColumns({"ci_low": low, "ci_high": high, "fs": st.phred(st.fisher_two_sided(mf, mr, F.col("fwd"), F.col("rev"))), "sor": st.strand_odds_ratio(mf, mr, F.col("fwd"), F.col("rev")), "aq": aq, "laf": st.logit(F.col("af")), "type": kind})


def observations(reads: DataFrame, reference: DataFrame, *, min_quality: int = 20, het: float = HET) -> DataFrame:
    """(sample, contig, pos, ref, allele, strand, qual, indel, n): counted bases, and indels at the base before them.

    Equal observations are counted first; what follows is joined and moved by distinct observation, not by read.
    """
    seen = pileup.from_reads(reads, min_quality)
    counted = seen.groupBy("sample", "contig", "pos", "allele", "strand", "qual", "indel", "lost").agg(F.count("*").alias("n"))
    moved = pileup.displaced(pileup.with_deleted(counted, reference), het, ["sample", "contig"])
    anchored = moved.join(reference.select("contig", "pos", F.upper("ref").alias("__anchor")), ["contig", "pos"])
    return anchored.withColumn("ref", F.concat("__anchor", "gone")).select("sample", "contig", "pos", "ref", "allele", "strand", "qual", "indel", "n")


def call_variants(reads: DataFrame, reference: DataFrame, *, min_mapq: int = 20, min_quality: int = 20, het: float = HET, proper_only: bool = False, same_contig: bool = False) -> tuple[DataFrame, DataFrame]:
    """(calls, sites): alleles of each sample and site with their statistics, and sites with cohort INFO.

    reads: sample, qname, flag, rname, pos (0-based), mapq, rnext, cigar, seq, qual. reference: contig, pos (1-based), ref. Indels
    stand at the base before them and displace what stood there; so they also do at the edges of any region, as there are no
    chunks here. Calls carry the site's reference, their alternative on it, and its number. Sites keep those with an alternative;
    QUAL is the best sample's below 10000, and vaf_mean and vaf_mean_het stand in the order of alts. No reads give no rows.
    """
    kept = filters.read_qc(reads, min_mapq, proper_only, same_contig)
    called = called_alleles(observations(kept, reference, min_quality=min_quality, het=het), het)
    calls = cohort.rebased(with_statistics(called, het), ["contig", "pos"])
    numbered = calls.withColumn("pos", F.struct("contig", "pos"))
    info = cohort.site_info(numbered)
    shares = cohort.alt_shares(numbered).groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("idx", "vaf_mean", "vaf_mean_het"))).alias("__v"))
    best = F.max(F.when(F.col("quality") < st.INFINITE, F.col("quality")))
    site = numbered.groupBy("pos").agg(best.alias("quality"), F.first("site_ref").alias("ref"), F.first("alts").alias("alts"))
    sites = site.where(F.size("alts") > 0).join(info, "pos").join(shares, "pos")
    columns = [c for c in info.columns if c != "pos"]
    return calls, sites.select("pos.contig", "pos.pos", "ref", "alts", F.coalesce("quality", F.lit(0.0)).alias("quality"), *columns, F.col("__v.vaf_mean").alias("vaf_mean"), F.col("__v.vaf_mean_het").alias("vaf_mean_het"))


def genotypes(calls: DataFrame, sites: DataFrame, samples: DataFrame) -> DataFrame:
    """A row for every site and sample (contig, pos, sample, gt, dp, ad, af): uncovered ones have a missing genotype and depth 0.

    The rows are the output's own size: sites times samples, as a table of calls has them.
    """
    entry = F.struct("idx", "ad", "af")
    own = calls.groupBy("contig", "pos", "sample").agg(F.array_sort(F.collect_list(entry)).alias("__e"), F.max("dp").alias("dp"))
    grid = sites.select("contig", "pos").crossJoin(samples.select("sample").distinct())
    full = grid.join(own, ["contig", "pos", "sample"], "left")
    gt = F.when(F.col("__e").isNull(), ".").otherwise(F.array_join(F.transform("__e.idx", lambda i: i.cast("string")), "/"))
    return full.select("contig", "pos", "sample", gt.alias("gt"), F.coalesce("dp", F.lit(0)).alias("dp"), F.col("__e.ad").alias("ad"), F.col("__e.af").alias("af"))
