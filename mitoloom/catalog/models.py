"""Iterative models, text formats and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mitoloom.catalog.base import Views, query
from mitoloom.operators import drift, filters, pedigree, simulate
from mitoloom.plans import bottleneck, caller, variant_qc
from mitoloom.sources import sinks, text


@query("agg05_agg06_agg07_em_lrt")
def _(v: Views) -> DataFrame:
    table = v.pileup.where("allele <> 'N'").groupBy("sample", "contig", "pos", "allele", "strand", "qual").agg(F.count("*").alias("n")).withColumn("ref", F.lit("A"))
    return caller.with_statistics(caller.called_alleles(table)).select("sample", "pos", "allele", "ad", "dp", F.round("af", 6).alias("af"), F.round("quality", 4).alias("quality"), F.round("ci_low", 6).alias("ci_low"), F.round("ci_high", 6).alias("ci_high"), F.round("fs", 4).alias("fs"), F.round("sor", 4).alias("sor"), "aq", "type")


@query("caller_pipeline")
def _(v: Views) -> DataFrame:
    names = v.reads.select(F.col("rname").alias("contig")).distinct()
    reference = names.withColumn("pos", F.explode(F.sequence(F.lit(1), F.lit(16100)))).withColumn("ref", F.substring(F.lit("ACGT"), F.col("pos") % 4 + 1, F.lit(1)))
    _, sites = caller.call_variants(v.reads, reference, min_quality=0)
    return sites.select("contig", "pos", "ref", F.array_join("alts", ",").alias("alts"), "an", "het_n", "hom_n", "dp_mean", "pt")


@query("agg29_bootstrap_ci")
def _(v: Views) -> DataFrame:
    return drift.bootstrap(drift.terms(filters.usable_pairs(v.pairs)), 100, 42, ["row_a", "row_b"])


@query("agg34_family_fits")
def _(v: Views) -> DataFrame:
    return bottleneck.families(filters.usable_pairs(v.pairs))


@query("win07_refined_size")
def _(v: Views) -> DataFrame:
    pairs = filters.usable_pairs(v.pairs).withColumn("g", F.lit(None).cast("double"))
    fit = bottleneck.estimate(pairs, 2, 40)
    return v.spark.createDataFrame([(float(fit["ne"]), float(fit["ci_low"]), float(fit["ci_high"]), float(fit["max_ll"]), int(fit["n"]))], "ne double, ci_low double, ci_high double, max_ll double, n long")


@query("agg35_beta_mle")
def _(v: Views) -> DataFrame:
    calls = v.genotyped.withColumns({"af": F.col("af") * 0.99, "fs": F.lit(0.0), "sor": F.lit(1.0)})
    return variant_qc.background(calls, 1, 0.0)


@query("agg39_qc_loop")
def _(v: Views) -> DataFrame:
    calls = v.genotyped.withColumns({"srf": F.lit(0.8), "ad": F.col("ad") * 60, "dp": F.col("dp") * 60, "fs": F.lit(0.0), "sor": F.lit(1.0)})
    scored, sites = variant_qc.quality_control(calls, least_depth=50, least_quality=10.0)
    return scored.join(sites, "pos").select("pos", "sample", "idx", F.round("pp", 6).alias("pp"), "good", "kept", "mutation", "pass")


@query("sim01_sim02_cohort")
def _(v: Views) -> DataFrame:
    rows = drift.terms(simulate.offspring(filters.usable_pairs(v.pairs), 10, ["row_a", "row_b"]))
    return drift.kimura(rows).select("n", F.round("b", 6).alias("b"), F.lit(1 - simulate.expected_drift(10, 1)).alias("expected_b"))


LINES = "(SELECT c_custkey AS line, CASE c_custkey % 5 WHEN 0 THEN '# ' || c_name WHEN 1 THEN 'F1 ' || c_custkey || ' 0 ' || c_nationkey || ' 1 -9' WHEN 2 THEN '  F2' || chr(9) || c_custkey || chr(9) || '0' || chr(9) || c_nationkey WHEN 3 THEN 'F3 ' || c_custkey ELSE 'F4 ' || c_custkey || ' . 0 2 1' END AS value FROM customer)"


@query("src09_src10_src11_fam_lines", f"SELECT line, f[1] AS fam, f[2] AS child, f[4] AS mother, len(f) >= 4 AND f[2] NOT IN ('', '0', '.', '-9') AND f[4] NOT IN ('', '0', '.', '-9') AS ok FROM (SELECT line, regexp_split_to_array(trim(value), '\\s+') AS f FROM {LINES} WHERE NOT starts_with(trim(value), '#'))")
def _(v: Views) -> DataFrame:
    key = F.col("c_custkey")
    k = key.cast("string")
    nation = F.col("c_nationkey").cast("string")
    value = F.when(key % 5 == 0, F.concat(F.lit("# "), "c_name")).when(key % 5 == 1, F.concat(F.lit("F1 "), k, F.lit(" 0 "), nation, F.lit(" 1 -9"))).when(key % 5 == 2, F.concat(F.lit("  F2\t"), k, F.lit("\t0\t"), nation)).when(key % 5 == 3, F.concat(F.lit("F3 "), k)).otherwise(F.concat(F.lit("F4 "), k, F.lit(" . 0 2 1")))
    rows = pedigree.parse_fam(v.customer.select(key.alias("line"), value.alias("value")))
    return rows.select("line", "fam", "child", "mother", F.when(F.col("mother").isNull(), F.lit(False)).otherwise(F.col("ok")).alias("ok"))


@query("src12_pair_loader", "SELECT m_dp, m_alt, c_dp, c_alt, CAST(count(*) AS BIGINT) AS n FROM pairs WHERE qc = 'PASS' AND row_a % 7 <> 0 AND m_dp > 0 AND CAST(m_alt AS DOUBLE) / m_dp BETWEEN 0.1 AND 0.9 AND c_alt BETWEEN 0 AND c_dp GROUP BY 1, 2, 3, 4")
def _(v: Views) -> DataFrame:
    share = lambda a, n: (F.col(a) / F.col(n)).cast("string")
    raw = v.pairs.where("m_dp > 0").select(F.lit("chrM").alias("CHROM"), F.when(F.col("row_a") % 7 == 0, "x").otherwise(F.col("pos").cast("string")).alias("POS"), F.lit("A").alias("REF"), F.lit("G").alias("ALT"), F.col("fam").alias("FAM_ID"), F.col("mother").alias("MOTHER_ID"), F.col("child").alias("CHILD_ID"), *[F.col(c).cast("string").alias(n) for c, n in (("m_dp", "MOTHER_DP"), ("m_alt", "MOTHER_AD_ALT"), ("c_dp", "CHILD_DP"), ("c_alt", "CHILD_AD_ALT"))], share("m_alt", "m_dp").alias("MOTHER_VAF"), share("c_alt", "c_dp").alias("CHILD_VAF"), F.col("qc").alias("QC"))
    return bottleneck.load_pairs(raw).groupBy("m_dp", "m_alt", "c_dp", "c_alt").agg(F.count("*").alias("n"))


@query("src13_region_tokens", "SELECT region_id, chrom, greatest(s, 1) AS s, CASE WHEN region_id % 3 = 0 THEN CAST(4294967295 AS BIGINT) ELSE e END AS e FROM regions")
def _(v: Views) -> DataFrame:
    token = F.concat(F.lit(" "), "chrom", F.lit(":"), F.col("s").cast("string"), F.lit("-"), F.when(F.col("region_id") % 3 == 0, "").otherwise(F.col("e").cast("string")), F.lit(" "))
    rows = text.regions(v.regions.select(token.alias("value")))
    return rows.join(v.regions.select("chrom", F.greatest("s", F.lit(1)).alias("s"), "region_id"), ["chrom", "s"]).select("region_id", "chrom", "s", "e")


@query("src14_strict_regions", "SELECT chrom, greatest(s, 1) AS s, e FROM regions")
def _(v: Views) -> DataFrame:
    token = F.concat("chrom", F.lit(":"), F.col("s").cast("string"), F.lit("-"), F.col("e").cast("string"))
    return text.regions(v.regions.select(token.alias("value")), strict=True)


@query("src05_sample_of_path", "SELECT o_orderkey, 's' || (o_custkey % 9) AS sample FROM orders")
def _(v: Views) -> DataFrame:
    path = F.concat(F.lit("/data/run.1/s"), (F.col("o_custkey") % 9).cast("string"), F.lit(".sorted.bam"))
    return v.orders.select("o_orderkey", text.sample_of_path(path).alias("sample"))


@query("src17_format_numbers", "SELECT pos, sample, ad, dp FROM calls WHERE ad < dp")
def _(v: Views) -> DataFrame:
    fields = v.calls.select("pos", "sample", F.concat(F.col("ad").cast("string"), F.lit(",.,"), F.col("dp").cast("string")).alias("x")).withColumn("n", text.numbers(F.col("x")))
    return fields.select("pos", "sample", F.col("n")[0].alias("ad"), F.col("n")[2].alias("dp")).where("ad < dp")


@query("snk01_vcf_line", "SELECT pos, 'chrM' || chr(9) || pos || chr(9) || '.' || chr(9) || ref || chr(9) || CASE WHEN pos % 3 = 0 THEN '.' ELSE alt END || chr(9) || CASE WHEN pos % 2 = 0 THEN '.' ELSE CAST(pos AS STRING) END || chr(9) || 'PASS' || chr(9) || '.' || chr(9) || 'GT' || chr(9) || '0' || chr(9) || '1' AS line FROM alts")
def _(v: Views) -> DataFrame:
    rows = v.alts.select("pos", F.lit("chrM").alias("chrom"), "ref", F.when(F.col("pos") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("alt")).alias("alts"), F.when(F.col("pos") % 2 == 0, 0.0).otherwise(F.col("pos").cast("double")).alias("qual"), F.lit("PASS").alias("filter"), F.lit(None).cast("string").alias("info"), F.lit("GT").alias("format"), F.array(F.lit("0"), F.lit("1")).alias("samples"))
    return rows.select("pos", sinks.vcf_line().alias("line"))


@query("stream_windowed_depth", "SELECT event_type, CAST(sum(n) AS BIGINT) AS n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1) GROUP BY 1")
def _(v: Views) -> DataFrame:
    from mitoloom.streaming.depth import run_latest, windowed_depth

    stream = v.spark.readStream.schema(v.events.schema).parquet(f"{v.sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    latest = run_latest(windowed_depth(stream, "ts", ["event_type"], "1 hour", "3650 days"), ["event_type"], _shared(v.spark), "depth")
    return latest.groupBy("event_type").agg(F.sum("n").alias("n"))


def _shared(spark) -> str:
    """A new folder in ``spark.checkpoint.dir``; a temporary one only where that is unset and all tasks run on this machine."""
    import re
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp()
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"
