"""Pedigrees and transmission pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mitoloom.functions import alleles as al
from mitoloom.operators.filters import depth_label


def parse_fam(lines: DataFrame) -> DataFrame:
    """FAM lines (value, line) as fam, child, father, mother, ok: `#` lines go, under four fields or missing ids are not ok."""
    text = F.trim(F.regexp_replace("value", "\r$", ""))
    rows = lines.where(~F.startswith(text, F.lit("#")) & (text != "")).withColumn("__f", F.split(text, r"\s+"))
    field = lambda i: F.get("__f", F.lit(i))
    out = rows.select("line", field(0).alias("fam"), field(1).alias("child"), field(2).alias("father"), field(3).alias("mother"), (F.size("__f") >= 4).alias("__enough"))
    return out.withColumn("ok", F.col("__enough") & ~al.missing_id(F.col("child")) & ~al.missing_id(F.col("mother"))).drop("__enough")


def mother_status(pedigree: DataFrame, samples: DataFrame) -> DataFrame:
    """pedigree plus has_child, has_mother: whether each is a sample. One join for both, on samples' distinct names."""
    names = samples.select("sample").distinct()
    both = pedigree.join(names.withColumnRenamed("sample", "__c").withColumn("has_child", F.lit(True)), F.col("child") == F.col("__c"), "left")
    both = both.join(names.withColumnRenamed("sample", "__m").withColumn("has_mother", F.lit(True)), F.col("mother") == F.col("__m"), "left")
    return both.drop("__c", "__m").fillna({"has_child": False, "has_mother": False})


def match_report(status: DataFrame) -> DataFrame:
    """Counters; a line whose child and mother both lack counts in both."""
    return status.agg(F.count("*").alias("trios"), F.count_if(F.col("has_child") & F.col("has_mother")).alias("matched"), F.count_if(~F.col("has_child")).alias("no_child"), F.count_if(~F.col("has_mother")).alias("no_mother"))


def with_grandmother(pedigree: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """pedigree plus grandmother: the mother of the mother in the first valid line that names her as a child."""
    links = pedigree if links is None else links
    valid = links.where(~al.missing_id(F.col("child")) & ~al.missing_id(F.col("mother")))
    first = valid.groupBy(F.col("child").alias("__m")).agg(F.min_by("mother", "line").alias("grandmother"))
    return pedigree.join(first, F.col("mother") == F.col("__m"), "left").drop("__m")


def unique_children(pedigree: DataFrame) -> DataFrame:
    """Children named on more than one line."""
    return pedigree.groupBy("child").agg(F.count("*").alias("n")).where("n > 1")


def transmission_pairs(pedigree: DataFrame, calls: DataFrame, least_depth: int = 500) -> DataFrame:
    """A row for each trio, site and alternative allele that both mother and child can be read for.

    pedigree: fam, child, mother, grandmother (may be null). calls: pos, alt, sample, dp, ad_alt; a call takes part with dp > 0
    and ad_alt known. The grandmother's counts join only where she was read too (has_g). Calls are shuffled once by (pos, alt,
    sample) for each role; the pedigree is the smaller side and keeps its own rows.
    """
    usable = calls.where("dp > 0 AND ad_alt IS NOT NULL")

    def role(name: str) -> DataFrame:
        return usable.select(F.col("sample").alias(name), F.col("pos"), F.col("alt"), F.col("dp").alias(f"{name}_dp"), F.col("ad_alt").alias(f"{name}_alt"))

    pairs = pedigree.join(role("mother"), "mother").join(role("child"), ["child", "pos", "alt"]).join(role("grandmother"), ["grandmother", "pos", "alt"], "left")
    return pairs.withColumns({"has_g": F.col("grandmother_dp").isNotNull().cast("int"), "mother_vaf": F.col("mother_alt") / F.col("mother_dp"), "child_vaf": F.col("child_alt") / F.col("child_dp"), "qc": depth_label(F.col("mother_dp"), F.col("child_dp"), least_depth)})


def families(pairs: DataFrame) -> DataFrame:
    """Counts and mean depths by (fam, mother); an empty fam is ALL."""
    fam = F.when(F.coalesce("fam", F.lit("")) == "", "ALL").otherwise(F.col("fam"))
    return pairs.groupBy(fam.alias("fam"), "mother").agg(F.count("*").alias("sites"), F.count_distinct("child").alias("children"), F.avg("m_dp").alias("mother_depth"), F.avg("c_dp").alias("child_depth"), F.count_if((F.col("p") > 0) & (F.col("p") < 1)).alias("informative"))


def last_by(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    rank = Window.partitionBy(*by).orderBy(F.col(order).desc())
    return rows.withColumn("__r", F.row_number().over(rank)).where("__r = 1").drop("__r")
