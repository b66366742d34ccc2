"""Writers: VCF lines and headers, TSV with comment lines, JSON, quality-controlled calls."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mitoloom.functions.alleles import trimmed_number

# Column names of the written tables.
PAIR_COLUMNS = "CHROM POS REF ALT FAM_ID GRANDMOTHER_ID MOTHER_ID CHILD_ID GRANDMOTHER_DP GRANDMOTHER_AD_REF GRANDMOTHER_AD_ALT GRANDMOTHER_VAF HAS_G MOTHER_DP MOTHER_AD_REF MOTHER_AD_ALT MOTHER_VAF CHILD_DP CHILD_AD_REF CHILD_AD_ALT CHILD_VAF QC".split()
COPYNUM_COLUMNS = "#Chromosome Fragments Chrom_Length GC_Content Fragment_Normalized_Ratio CopyNum CopyNum-CI95-Lower CopyNum-CI95-Upper Effective_Length Regions_Used".split()
QC_COLUMNS = "sample chrom pos ref alt ploidy q_alpha q_beta p_error posterior is_mutation".split()


def vcf_line(chrom: str = "chrom", pos: str = "pos", ref: str = "ref", alts: str = "alts", qual: str = "qual", filter_: str = "filter", info: str = "info", format_: str = "format", samples: str = "samples") -> Column:
    """A VCF body line; qualities that are not positive and empty lists of alternatives are points."""
    quality = F.when(F.col(qual) > 0, trimmed_number(F.col(qual), 2)).otherwise(".")
    alt = F.when(F.size(alts) > 0, F.array_join(alts, ",")).otherwise(".")
    return F.concat_ws("\t", F.col(chrom), F.col(pos).cast("string"), F.lit("."), F.col(ref), alt, quality, F.coalesce(filter_, F.lit(".")), F.coalesce(info, F.lit(".")), F.col(format_), F.array_join(samples, "\t"))


def vcf_header(contigs: Sequence[tuple[str, int]], samples: Sequence[str], formats: Sequence[tuple[str, str, str, str]], infos: Sequence[tuple[str, str, str, str]], command: str = "") -> list[str]:
    """Header lines; formats and infos are (id, number, type, description)."""
    out = ["##fileformat=VCFv4.2", '##FILTER=<ID=PASS,Description="All filters passed">']
    for kind, fields in (("FORMAT", formats), ("INFO", infos)):
        out += [f'##{kind}=<ID={i},Number={n},Type={t},Description="{d}">' for i, n, t, d in fields]
    out += [f"##contig=<ID={name},length={length}>" for name, length in contigs]
    if command:
        out.append(f"##command={command}")
    return [*out, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]


def write_lines(body: DataFrame, order: Sequence[str], line: Column, head: Sequence[str], path: str, gzip: bool = False) -> None:
    """Header, then body lines in order, as parts of the folder ``path`` whose names stand in that order; see merge_parts.

    The body is sorted by ranges, each written by a task of its own; the header is the first part. No rows leave the header alone.
    """
    spark = body.sparkSession
    rows = body.orderBy(*order).select(line.alias("value"))
    if head:
        rows = spark.createDataFrame([("\n".join(head),)], "value string").coalesce(1).unionByName(rows)
    rows.write.mode("overwrite").option("compression", "gzip" if gzip else "none").text(path)


def _store(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """(file system, path) of any store that Spark reaches."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def merge_parts(spark: SparkSession, folder: str, path: str) -> None:
    """The parts of a folder as one file, in the order of their names; gzip parts give one gzip file.

    One task copies them as streams, a piece at a time; the driver has their names alone.
    """
    from mitoloom.sources.variants import store_of

    store, root = store_of(folder)
    parts = sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("part-"))
    target = store_of(path)[1]

    def copy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = store_of(folder)
        for frame in frames:
            with store.open_output_stream(target, compression=None) as out:
                for part in frame["parts"].iloc[0]:
                    with store.open_input_file(part) as source:
                        while data := source.read(1 << 20):
                            out.write(data)
            yield pd.DataFrame({"path": [target]})

    spark.createDataFrame([(parts,)], "parts array<string>").coalesce(1).mapInPandas(copy, "path string").collect()


def write_table(rows: DataFrame, path: str, comments: Sequence[str] = (), order: Sequence[str] = ()) -> None:
    """TSV with a header; with comments, one file whose first lines they are."""
    if not comments:
        (rows.orderBy(*order) if order else rows).write.mode("overwrite").csv(path, sep="\t", header=True)
        return
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in rows.columns])
    write_lines(rows, order or rows.columns[:1], line, [*(f"#{c}" for c in comments), "\t".join(rows.columns)], path)


def pair_rows(pairs: DataFrame) -> DataFrame:
    """Transmission pairs under the columns of the pair table; absent grandmothers are NA with zero counts."""
    count = lambda c: F.coalesce(c, F.lit(0))
    share = lambda k, n: trimmed_number(F.when(F.col(n) > 0, F.col(k) / F.col(n)).otherwise(F.lit(0.0)))
    g_seen = pairs.withColumns({c: count(F.col(c)) for c in ("grandmother_dp", "grandmother_alt")})
    columns = [F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt"), F.col("fam"), F.coalesce("grandmother", F.lit("NA")), F.col("mother"), F.col("child"), F.col("grandmother_dp"), F.col("grandmother_dp") - F.col("grandmother_alt"), F.col("grandmother_alt"), share("grandmother_alt", "grandmother_dp"), F.col("has_g"), F.col("mother_dp"), F.col("mother_dp") - F.col("mother_alt"), F.col("mother_alt"), share("mother_alt", "mother_dp"), F.col("child_dp"), F.col("child_dp") - F.col("child_alt"), F.col("child_alt"), share("child_alt", "child_dp"), F.col("qc")]
    return g_seen.select(*[c.alias(n) for c, n in zip(columns, PAIR_COLUMNS, strict=True)])


def write_json(spark: SparkSession, result: dict[str, Any], path: str) -> None:
    """One JSON document in any store that Spark reaches; numbers that are not finite become strings."""
    clean = lambda x: {k: clean(v) for k, v in x.items()} if isinstance(x, dict) else [clean(v) for v in x] if isinstance(x, list) else str(x) if isinstance(x, float) and not math.isfinite(x) else x
    store, place = _store(spark, path)
    out = store.create(place, True)
    try:
        out.write(bytearray(json.dumps(clean(result), indent=2).encode()))
    finally:
        out.close()


def qc_rows(scored: DataFrame) -> DataFrame:
    """Called mutations with an alternative allele, under the columns of the QC table.

    scored: sample, chrom, pos, ref, alt, ploidy, alpha, beta, error, pp, mutation, idx; a column that is absent raises.
    """
    columns = ["sample", "chrom", "pos", "ref", "alt", "ploidy", "alpha", "beta", "error", "pp", "mutation"]
    kept = scored.where("mutation AND idx > 0")
    return kept.select(*[F.col(c).alias(n) for c, n in zip(columns, QC_COLUMNS, strict=True)])


def copynum_rows(report: DataFrame) -> DataFrame:
    """A copy-number report under its table's columns.

    report: contig, fragments, length, gc, ratio, cn, cn_low, cn_high, effective_length, regions; numbers have six places, and null
    ones are NA.
    """
    places = {"gc", "ratio", "cn", "cn_low", "cn_high"}
    columns = ["contig", "fragments", "length", "gc", "ratio", "cn", "cn_low", "cn_high", "effective_length", "regions"]
    text = lambda c: F.coalesce(trimmed_number(F.col(c)) if c in places else F.col(c).cast("string"), F.lit("NA"))
    return report.select(*[text(c).alias(n) for c, n in zip(columns, COPYNUM_COLUMNS, strict=True)])
