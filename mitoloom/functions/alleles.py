"""Alleles, genotypes and text fields as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the mitochondrial contig, and ids that stand for a missing parent.
MITO = ("chrM", "chrMT", "MT", "M")
MISSING = ("", "0", ".", "-9")


def allele_class(ref: Column, alt: Column) -> Column:
    """REF, SNV, INS, DEL or MNV by equality and length."""
    a, b = F.length(ref), F.length(alt)
    return F.when(ref == alt, "REF").when((a == 1) & (b == 1), "SNV").when(a < b, "INS").when(a > b, "DEL").otherwise("MNV")


def rebased(ref: Column, alt: Column, longest: Column) -> Column:
    """An allele given against ``ref``, extended to the site's longest reference."""
    return F.concat(alt, F.substring(longest, F.length(ref) + 1, F.length(longest)))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix."""
    same = F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1))), lambda i: (i <= F.least(F.length(a), F.length(b))) & (F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))
    return F.size(F.filter(same, lambda x: x))


def suffix_trimmed(rows: DataFrame, ref: str = "ref", alt: str = "alt") -> DataFrame:
    """rows with both alleles freed of their common suffix, of which one base at least stays on each."""
    n = F.least(common_prefix(F.reverse(ref), F.reverse(alt)), F.length(ref) - 1, F.length(alt) - 1)
    cut = rows.withColumn("__n", n)
    return cut.withColumns({c: F.substring(c, F.lit(1), F.length(c) - F.col("__n")) for c in (ref, alt)}).drop("__n")


def prefix_trimmed(rows: DataFrame, pos: str = "pos", ref: str = "ref", alt: str = "alt") -> DataFrame:
    """rows of alleles as long as their reference freed of their common prefix, one base at least staying; pos moves along."""
    n = F.when(F.length(ref) == F.length(alt), F.least(common_prefix(F.col(ref), F.col(alt)), F.length(ref) - 1)).otherwise(0)
    cut = rows.withColumn("__n", n)
    return cut.withColumns({ref: F.substring(ref, F.col("__n") + 1, F.length(ref)), alt: F.substring(alt, F.col("__n") + 1, F.length(alt)), pos: F.col(pos) + F.col("__n")}).drop("__n")


def genotype(text: Column) -> Column:
    """Allele numbers of a GT text of any ploidy; missing ones are null."""
    return F.transform(F.split(text, r"[/|]"), lambda x: x.try_cast("int"))


def by_genotype(gt: Column, values: Column, allele: Column) -> Column:
    """The value of an allele in an array that is aligned to GT; 0 where GT lacks it, null where GT is missing or sizes differ."""
    sound = (F.size(gt) == F.size(values)) & ~F.exists(gt, lambda g: g.isNull())
    return F.when(sound, F.coalesce(F.get(values, F.array_position(gt, allele).cast("int") - 1), F.lit(0)))


def autosome(name: Column) -> Column:
    return name.rlike(r"^(chr)?([1-9]|1[0-9]|2[0-2])$")


def mitochondrial(name: Column) -> Column:
    return name.isin(*MITO)


def missing_id(value: Column) -> Column:
    return value.isNull() | value.isin(*MISSING)


def trimmed_number(x: Column, digits: int = 6) -> Column:
    """Fixed-point text without trailing zeros or point; null for null."""
    return F.when(x.isNotNull(), F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits}f", x), "0+$", ""), r"\.$", ""))


def info_map(info: Column) -> Column:
    """``k=v;k=v`` as a map; flags have a null value."""
    return F.str_to_map(info, F.lit(";"), F.lit("="))


def gc_count(sequence: Column) -> Column:
    return F.length(F.regexp_replace(sequence, "[^GCgc]", ""))


def base_count(sequence: Column) -> Column:
    return F.length(F.regexp_replace(sequence, "[^ACGTacgt]", ""))


def rotated(sequence: Column, shift: Column) -> Column:
    """The sequence turned so that position ``shift`` (modulo its length) comes first."""
    at = F.when(F.length(sequence) > 0, F.pmod(shift, F.length(sequence))).otherwise(F.lit(0))
    return F.concat(F.substring(sequence, at + 1, F.length(sequence)), F.substring(sequence, F.lit(1), at))


def mitotip_class(quartile: Column) -> Column:
    return F.when(quartile == "Q1", "likely pathogenic").when(quartile == "Q2", "possibly pathogenic").when(quartile == "Q3", "possibly benign").when(quartile == "Q4", "likely benign").otherwise("")


def general_number(x: Column, digits: int = 6) -> Column:
    """Text of so many significant digits without trailing zeros, with an exponent where the number is below 1e-4 or too long; null for
    null."""
    text = F.when(x == 0, "0").when(x.isNotNull(), F.format_string(f"%.{digits}g", x))
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")
