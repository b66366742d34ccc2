"""Row filters and labels of reads, alleles, records and pairs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mitoloom.functions.alleles import autosome, mitochondrial

PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 1, 2, 4, 8, 16, 256, 512, 1024, 2048

# Inclusive ranges that are never called, for record QC and for the merged-call filter.
BLACKLIST = [(299, 317), (511, 525), (564, 571), (952, 955), (3105, 3108), (5895, 5899), (8268, 8279), (13645, 13650), (16180, 16187)]
MERGED_BLOCKLIST = [(299, 317), (511, 524), (564, 571), (952, 955), (3106, 3108), (8268, 8279), (13646, 13650), (16179, 16183)]


def flag(column: str, bit: int) -> Column:
    return F.col(column).bitwiseAND(F.lit(bit)) != 0


def read_qc(reads: DataFrame, min_mapq: int, proper_only: bool = False, same_contig: bool = False) -> DataFrame:
    """Reads for calling: mapping quality, no duplicates or QC failures; secondary and supplementary ones stay."""
    kept = reads.where((F.col("mapq") >= min_mapq) & ~flag("flag", DUPLICATE) & ~flag("flag", QC_FAIL))
    if proper_only:
        kept = kept.where(~flag("flag", PAIRED) | flag("flag", PROPER))
    return kept.where(~flag("flag", PAIRED) | (F.col("rname") == F.col("rnext"))) if same_contig else kept


def countable(reads: DataFrame, min_mapq: int) -> DataFrame:
    """Reads for copy numbers: mapped, primary, not supplementary."""
    return reads.where(~flag("flag", UNMAPPED) & ~flag("flag", SECONDARY) & ~flag("flag", SUPPLEMENTARY) & (F.col("mapq") >= min_mapq))


def valid_record(ref: Column, alt: Column) -> Column:
    return ref.rlike("^[ACGTNacgtn]+$") & (F.length(alt) > 0) & (ref != alt)


def passing(filter_column: Column) -> Column:
    """No filter, or PASS alone."""
    return filter_column.isNull() | filter_column.isin("PASS", ".", "")


def contig_class(name: Column) -> Column:
    return F.when(autosome(name), "autosome").when(mitochondrial(name), "mito").otherwise("other")


def depth_label(mother: Column, child: Column, least: int) -> Column:
    return F.when((mother < least) | (child < least), "LOW_DEPTH").otherwise("PASS")


def usable_pairs(pairs: DataFrame, low: float = 0.10, high: float = 0.90) -> DataFrame:
    """Pairs that pass QC, whose mother's share as printed to six places lies in [low, high], with sound counts."""
    share = F.round(F.col("m_alt") / F.col("m_dp"), 6)
    sound = (F.col("m_dp") > 0) & (F.col("c_dp") > 0) & F.col("m_alt").between(0, F.col("m_dp")) & F.col("c_alt").between(0, F.col("c_dp"))
    return pairs.where((F.col("qc") == "PASS") & sound).withColumns({"p": share, "c": F.round(F.col("c_alt") / F.col("c_dp"), 6)}).where(F.col("p").between(low, high))


def informative(pairs: DataFrame) -> DataFrame:
    return pairs.where((F.col("p") > 0) & (F.col("p") < 1))


def in_ranges(position: Column, ranges: Iterable[tuple[int, int]], width: Column | None = None) -> Column:
    """Whether [position, position + width - 1] meets any of a fixed list of inclusive ranges."""
    last = position if width is None else position + width - 1
    out = F.lit(False)
    for low, high in ranges:
        out = out | ((position <= high) & (last >= low))
    return out


def background_ready(calls: DataFrame, least_depth: int, least_quality: float, most_strand: float = 100.0, most_odds: float = 5.0) -> DataFrame:
    """One-allele samples deep, sure and even enough over strands to measure a site's background error on.

    calls: ploidy, dp, aq, fs, sor. A missing fs or sor does not hold a sample back; a missing depth or quality does.
    """
    even = (F.coalesce("fs", F.lit(0.0)) <= most_strand) & (F.coalesce("sor", F.lit(0.0)) <= most_odds)
    return calls.where((F.col("ploidy") == 1) & (F.col("dp") >= least_depth) & (F.col("aq") >= least_quality) & even)


def call_state(fields: Iterable[str]) -> Column:
    """``missing`` where a sample lacks one of the fields, else ``ready``."""
    lacks = F.lit(False)
    for name in fields:
        lacks = lacks | F.col(name).isNull()
    return F.when(lacks, "missing").otherwise("ready")
