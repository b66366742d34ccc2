"""Pileups: allele depths, strand counts, major alleles, indel anchors and read-level joins to the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mitoloom.functions import stats as st
from mitoloom.operators import cigar


def from_reads(reads: DataFrame, min_quality: int = 20) -> DataFrame:
    """(sample, contig, pos 1-based, allele, qual, mapq, strand, indel, lost) of each aligned base and indel.

    An insertion is ``+`` with its bases at the base after it and takes the quality of the base before it, or its own mean at a
    read's start. A deletion is ``-`` at its first base, of ``lost`` bases, and takes the read's mean. Lower qualities go.
    """
    strand = F.when(F.col("flag").bitwiseAND(16) != 0, "-").otherwise("+")
    bases = cigar.aligned_pairs(reads.withColumn("strand", strand)).where("op IN ('M', '=', 'X', 'I', 'D')")
    quality = lambda at: F.ascii(F.substring("qual", at, F.lit(1))) - 33
    start = F.floor(cigar.mean_quality(F.substring("qual", F.lit(1), F.length("base"))))
    inserted = F.when(F.col("query_pos") > 0, quality(F.col("query_pos"))).otherwise(start)
    q = F.when(F.col("op") == "D", F.floor(cigar.mean_quality(F.col("qual")))).when(F.col("op") == "I", inserted).otherwise(quality(F.col("query_pos") + 1))
    rows = bases.withColumn("__q", q.cast("int")).where(F.col("__q") >= min_quality)
    allele = F.when(F.col("op") == "I", F.concat(F.lit("+"), F.upper("base"))).when(F.col("op") == "D", F.lit("-")).otherwise(F.upper("base"))
    lost = F.when(F.col("op") == "D", F.col("op_len")).otherwise(0)
    return rows.select("sample", F.col("rname").alias("contig"), (F.col("ref_pos") + 1).alias("pos"), allele.alias("allele"), F.col("__q").alias("qual"), "mapq", "strand", F.col("op").isin("I", "D").cast("int").alias("indel"), lost.alias("lost"))


def with_deleted(counted: DataFrame, reference: DataFrame) -> DataFrame:
    """counted with the deleted bases of the reference (contig, pos, ref) as ``gone`` and behind the ``-`` of deletions.

    Only the different deletions are spelt out, a row for each of their bases. Bases beyond the reference are N.
    """
    gaps = counted.where("lost > 0").select("contig", "pos", "lost").distinct()
    spelt = gaps.withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("lost") - 1))).withColumn("__p", F.col("pos") + F.col("__i"))
    known = reference.select("contig", F.col("pos").alias("__p"), F.upper("ref").alias("__b"))
    letters = F.array_sort(F.collect_list(F.struct("__i", F.coalesce("__b", F.lit("N")).alias("b"))))
    words = spelt.join(known, ["contig", "__p"], "left").groupBy("contig", "pos", "lost").agg(F.array_join(letters["b"], "").alias("gone"))
    joined = counted.join(words, ["contig", "pos", "lost"], "left").withColumn("gone", F.coalesce("gone", F.lit("")))
    return joined.withColumn("allele", F.when(F.col("lost") > 0, F.concat(F.lit("-"), "gone")).otherwise(F.col("allele")))


def displaced(counted: DataFrame, least_share: float, by: list[str]) -> DataFrame:
    """Indels moved to the base before them, where they displace what stood there; counted has pos, indel and n.

    Where a position has indels, its indels and its bases each stay only with a share of ``least_share`` or more of all there. At the
    first position of a contig there is no base before: there, bases displace indels.
    """
    here = Window.partitionBy(*by, "pos")
    share = F.sum("n").over(Window.partitionBy(*by, "pos", "indel")) / F.sum("n").over(here)
    kept = counted.withColumns({"__share": share, "__any": F.max("indel").over(here)}).where((F.col("__any") == 0) | (F.col("__share") >= least_share))
    moved = kept.withColumn("__edge", F.when((F.col("pos") == 1) & (F.col("indel") == 1), -1).otherwise(F.col("indel"))).withColumn("pos", F.greatest(F.col("pos") - F.col("indel"), F.lit(1)))
    wins = F.max("__edge").over(Window.partitionBy(*by, "pos"))
    return moved.withColumn("__wins", wins).where("__edge = __wins").drop("__share", "__any", "__edge", "__wins")


def allele_depths(pileup: DataFrame, by: list[str]) -> DataFrame:
    """Depth of each allele and of all, by group: one partial aggregate, then a window over few rows a group."""
    counts = pileup.groupBy(*by, "allele").agg(F.count("*").alias("ad"))
    return counts.withColumn("dp", F.sum("ad").over(Window.partitionBy(*by)))


def strand_counts(pileup: DataFrame, by: list[str]) -> DataFrame:
    forward = F.col("strand") == "+"
    return pileup.groupBy(*by, "allele").agg(F.count_if(forward).cast("int").alias("fwd"), F.count_if(~forward).cast("int").alias("rev"), F.count("*").cast("int").alias("depth"))


def with_major(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """counts plus the group's deepest allele's strands; ties go to the smaller allele."""
    by = by or ["pos"]
    rank = Window.partitionBy(*by).orderBy(F.col("depth").desc(), "allele")
    whole = rank.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return counts.withColumns({"major": F.first("allele").over(whole), "major_fwd": F.first("fwd").over(whole), "major_rev": F.first("rev").over(whole), "is_major": F.row_number().over(rank) == 1})


def strand_bias(counts: DataFrame, by: list[str]) -> DataFrame:
    """FS and SOR of each allele against the major one; the major allele is held against an even split of itself."""
    rows = with_major(counts, by)
    half = F.floor(F.col("depth") / 2).cast("int")
    mf, mr = F.when(F.col("is_major"), half).otherwise(F.col("major_fwd")), F.when(F.col("is_major"), half).otherwise(F.col("major_rev"))
    p = st.fisher_two_sided(mf, mr, F.col("fwd"), F.col("rev"))
    return rows.withColumns({"fs": st.phred(p), "sor": st.strand_odds_ratio(mf, mr, F.col("fwd"), F.col("rev"))})


def filled_grid(calls: DataFrame, by: str = "sample") -> DataFrame:
    """A row for every covered position and every sample; absent calls have depth 0.

    Positions and samples are distinct lists; the samples (one row each) are joined to every position, which is the output's
    own size.
    """
    grid = calls.select("pos").distinct().crossJoin(calls.select(by).distinct())
    return grid.join(calls, ["pos", by], "left").fillna({"dp": 0})
