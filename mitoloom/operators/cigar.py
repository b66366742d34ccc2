"""CIGAR strings: aligned pairs, blocks and indels by array functions, without a shuffle or a Python worker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ON_REFERENCE, ON_QUERY, MATCHES = ("M", "=", "X", "D", "N"), ("M", "=", "X", "I", "S"), ("M", "=", "X")


def operations(cigar: Column) -> Column:
    """array<struct<len, op>> in order."""
    pattern = F.lit("([0-9]+)([MIDNSHP=X])")
    lengths = F.regexp_extract_all(cigar, pattern, F.lit(1))
    return F.zip_with(lengths, F.regexp_extract_all(cigar, pattern, F.lit(2)), lambda n, op: F.struct(n.cast("int").alias("len"), op.alias("op")))


def placed(cigar: Column, pos: Column) -> Column:
    """array<struct<len, op, ref_at, query_at>>: operations with 0-based places of their first base."""
    start = F.struct(pos.cast("int").alias("r"), F.lit(0).alias("q"), F.array().cast("array<struct<len:int,op:string,ref_at:int,query_at:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct(
            (acc["r"] + F.when(x["op"].isin(*ON_REFERENCE), x["len"]).otherwise(0)).alias("r"),
            (acc["q"] + F.when(x["op"].isin(*ON_QUERY), x["len"]).otherwise(0)).alias("q"),
            F.concat(acc["out"], F.array(F.struct(x["len"].alias("len"), x["op"].alias("op"), acc["r"].alias("ref_at"), acc["q"].alias("query_at")))).alias("out"),
        )

    return F.aggregate(operations(cigar), start, step, lambda acc: acc["out"])


def aligned_pairs(reads: DataFrame) -> DataFrame:
    """reads' columns plus op, op_len, ref_pos, query_pos, base: a row for each aligned base, one for each I, S, P, D or N; H none."""
    rows = reads.withColumn("__op", F.explode(placed(F.col("cigar"), F.col("pos")))).where("__op.op <> 'H' AND __op.len > 0")
    single = ~F.col("__op.op").isin(*MATCHES)
    rows = rows.withColumn("__i", F.explode(F.sequence(F.lit(0), F.when(single, F.lit(0)).otherwise(F.col("__op.len") - 1))))
    at = F.col("__op.query_at") + F.col("__i")
    base = F.when(F.col("__op.op").isin("I", "S"), F.substring("seq", F.col("__op.query_at") + 1, F.col("__op.len"))).when(single, "").otherwise(F.substring("seq", at + 1, F.lit(1)))
    return rows.withColumns({"op": F.col("__op.op"), "op_len": F.col("__op.len"), "ref_pos": F.col("__op.ref_at") + F.col("__i"), "query_pos": at, "base": base}).drop("__op", "__i")


def summary(reads: DataFrame) -> DataFrame:
    """reads plus ref_end, query_start, query_end, blocks, longest_insertion, longest_deletion."""
    ops = placed(F.col("cigar"), F.col("pos"))
    longest = lambda kind: F.coalesce(F.array_max(F.transform(F.filter("__ops", lambda x: x["op"] == kind), lambda x: x["len"])), F.lit(0))
    last = F.element_at("__ops", -1)
    end = last["ref_at"] + F.when(last["op"].isin(*ON_REFERENCE), last["len"]).otherwise(0)
    matched = F.filter("__ops", lambda x: x["op"].isin(*MATCHES))
    return (
        reads.withColumn("__ops", ops)
        .withColumns({"ref_end": end, "blocks": F.size(matched), "query_start": F.get(matched, F.lit(0))["query_at"], "query_end": F.element_at(matched, -1)["query_at"] + F.element_at(matched, -1)["len"], "longest_insertion": longest("I"), "longest_deletion": longest("D")})
        .drop("__ops")
    )


def indels(reads: DataFrame) -> DataFrame:
    """reads plus ref_pos and allele: +SEQ for insertions; deletions are -SEQ from ``ref_seq`` if there, else -N..N."""
    rows = reads.withColumn("__op", F.explode(F.filter(placed(F.col("cigar"), F.col("pos")), lambda x: x["op"].isin("I", "D"))))
    lost = F.substring("ref_seq", F.col("__op.ref_at") + 1, F.col("__op.len")) if "ref_seq" in reads.columns else F.expr("repeat('N', __op.len)")
    allele = F.when(F.col("__op.op") == "I", F.concat(F.lit("+"), F.substring("seq", F.col("__op.query_at") + 1, F.col("__op.len")))).otherwise(F.concat(F.lit("-"), lost))
    return rows.withColumns({"ref_pos": F.col("__op.ref_at"), "allele": allele}).drop("__op")


def overlapping(reads: DataFrame, contig: str, start: int, end: int) -> DataFrame:
    """Reads of a contig that overlap [start, end), 0-based; needs ref_end (see summary)."""
    return reads.where((F.col("rname") == contig) & (F.col("pos") < end) & (F.col("ref_end") > start))


def mean_quality(qual: Column) -> Column:
    """Mean base quality of a Phred+33 string; null where it is empty."""
    values = F.transform(F.split(qual, ""), lambda c: F.ascii(c) - 33)
    return F.when(F.length(qual) > 0, F.aggregate(values, F.lit(0), lambda acc, x: acc + x) / F.length(qual))
