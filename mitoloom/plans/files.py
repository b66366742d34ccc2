"""Commands from files to files: variant QC, calling, estimates of bottleneck sizes."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mitoloom.functions import alleles as al
from mitoloom.functions import stats as st
from mitoloom.operators import drift, filters
from mitoloom.operators.ordered import durable
from mitoloom.operators.records import format_field
from mitoloom.plans import bottleneck, caller, variant_qc
from mitoloom.sources import bam, sinks, text, variant_sinks, variants
from mitoloom.sources.headers import VcfHeader

# What quality control adds to a header.
QC_LINES = [
    '##FORMAT=<ID=PP,Number=1,Type=Float,Description="Posterior probability of true genotype">',
    '##FORMAT=<ID=GOOD_CALL,Number=1,Type=String,Description="Good call (True/False)">',
    '##FILTER=<ID=PASS,Description="Passed mtDNA QC filter">',
    '##FILTER=<ID=BLACKLISTED_SITE,Description="Site is in the blacklisted regions">',
    '##FILTER=<ID=LOW_QUALITY,Description="Low quality site based on KL divergence">',
]
QC_FIELDS = ("PP", "GOOD_CALL")


def _key() -> Column:
    """A text that stands for a record and sorts by its place."""
    return F.concat_ws("\t", "chrom", F.lpad(F.col("pos").cast("string"), 10, "0"), F.lpad(F.col("place").cast("string"), 20, "0"), "file")


def qc_calls(records: DataFrame) -> DataFrame:
    """A row for each allele of each sample's genotype, from arrays that are aligned to it: pos (the record's key), sample (the sample's
    place), j (the allele's place in the genotype), idx, ploidy, dp, ad, af, aq, fs, sor, srf. Genotypes with a missing allele give none.
    """
    one = records.withColumn("key", _key()).select("key", "format", F.posexplode("samples").alias("sample", "value"))
    field = lambda k: format_field(F.col("format"), F.col("value"), k)
    ratio = lambda sb: F.when(F.size(F.split(sb, ",")) >= 2, st.strand_ratio(F.get(F.split(sb, ","), F.lit(0)).try_cast("double"), F.get(F.split(sb, ","), F.lit(1)).try_cast("double")))
    lists = {"gt": al.genotype(field("GT")), "ad": text.numbers(field("AD")), "af": text.numbers(field("AF"), "double"), "aq": text.numbers(field("AQ"), "double"), "fs": text.numbers(field("FS"), "double"), "sor": text.numbers(field("SOR"), "double"), "srf": F.transform(F.split(field("SB"), ";"), lambda sb: F.coalesce(ratio(sb), F.lit(0.5)))}
    rows = one.withColumns(lists | {"dp": field("DP").try_cast("int")}).where("gt IS NOT NULL AND size(gt) > 0 AND NOT exists(gt, g -> g IS NULL)")
    rows = rows.select(F.col("key").alias("pos"), "sample", "dp", F.size("gt").alias("ploidy"), F.posexplode("gt").alias("j", "idx"), *lists)
    return rows.select("pos", "sample", "j", "idx", "ploidy", "dp", *[F.get(c, F.col("j")).alias(c) for c in ("ad", "af", "aq", "fs", "sor")], F.coalesce(F.get("srf", F.col("j")), F.lit(0.5)).alias("srf"))


def qc_records(records: DataFrame, *, most_alternatives: int = 2, **options: Any) -> tuple[DataFrame, DataFrame]:
    """(records as quality control leaves them, its table of calls).

    records: the columns of variants.SCHEMA. All records stay. FILTER says whether the site is called in any sample; QUAL is the
    divergence of its shares from its error model, in whole numbers, 0 where that is unknown. Each sample gets its posterior (PP)
    and whether it is a call (GOOD_CALL); in genotypes, which become unphased, alleles that some round has found below the posterior
    are missing. Other fields stay byte for byte. Records on the blacklist, with too many alternatives or without background
    samples are not called; their genotypes stay.
    """
    taken = records.where(~filters.in_ranges(F.col("pos"), filters.BLACKLIST, F.length("ref")) & (F.when(F.col("alt") == ".", 0).otherwise(F.size(F.split("alt", ","))) <= most_alternatives))
    calls = durable(qc_calls(taken))
    scored, sites = variant_qc.quality_control(calls, **options)
    scored, sites = durable(scored), durable(sites)
    allele = F.when(F.col("pre_filtered") | (F.col("idx") == 0) | F.col("kept"), F.col("idx"))
    each = scored.groupBy("pos", "sample").agg(F.max("pp").alias("pp"), F.bool_or("mutation").alias("good"), F.array_sort(F.collect_list(F.struct("j", allele.alias("allele")))).alias("g"), F.first("alpha").alias("alpha"), F.first("beta").alias("beta"), F.first("error").alias("error"), F.first("ploidy").alias("ploidy"), F.array_sort(F.collect_list(F.struct("j", "idx"))).alias("own"))
    each = durable(each.withColumn("gt", F.array_join(F.transform("g", lambda x: F.coalesce(x["allele"].cast("string"), F.lit("."))), "/")))
    # a record's samples, of which it has as many itself
    by_record = each.groupBy("pos").agg(F.map_from_entries(F.collect_list(F.struct("sample", F.struct("pp", "good", "gt")))).alias("__m"))
    joined = records.withColumn("__key", _key()).join(by_record.withColumnRenamed("pos", "__key"), "__key", "left").join(sites.select(F.col("pos").alias("__key"), "pass", "kl"), "__key", "left")
    keys = F.split("format", ":")
    place = F.array_position(keys, "GT")
    stays = lambda fields: F.filter(fields, lambda _, i: ~F.coalesce(F.get(keys, i), F.lit("")).isin(*QC_FIELDS))

    def rewritten(sample: Column, i: Column) -> Column:
        found = F.element_at("__m", i.cast("int"))
        fields = F.split(sample, ":")
        padded = F.concat(fields, F.array_repeat(F.lit("."), F.greatest(F.size(keys) - F.size(fields), F.lit(0)).cast("int")))
        changed = F.transform(padded, lambda f, k: F.when(k == place - 1, F.coalesce(found["gt"], F.replace(f, F.lit("|"), F.lit("/")))).otherwise(f))
        pp = al.general_number(F.coalesce(found["pp"], F.lit(0.0)))
        return F.array_join(F.concat(stays(changed), F.array(pp, F.when(found["good"], "True").otherwise("False"))), ":")

    label = F.when(filters.in_ranges(F.col("pos"), filters.BLACKLIST), "BLACKLISTED_SITE").when(F.col("pass"), "PASS").otherwise("LOW_QUALITY")
    changed = joined.withColumns({"samples": F.transform("samples", rewritten), "format": F.array_join(F.concat(stays(keys), F.array(*map(F.lit, QC_FIELDS))), ":"), "filter": label, "qual": F.coalesce(F.round("kl").cast("long"), F.lit(0)).cast("string")})
    places = records.select(_key().alias("pos"), "chrom", F.col("pos").alias("position"), "ref", F.concat(F.array("ref"), F.split("alt", ",")).alias("alleles"))
    called = each.where("good").join(places, "pos").withColumn("texts", F.transform("own", lambda x: F.coalesce(F.get("alleles", x["idx"]), F.lit("."))))
    varied = called.where(F.exists("texts", lambda a: (a != F.col("ref")) & (a != ".")))
    table = varied.select("sample", "chrom", F.col("position").alias("pos"), "ref", F.array_join("texts", ",").alias("alt"), "ploidy", "alpha", "beta", "error", "pp", F.col("good").alias("mutation"))
    return changed.select(*records.columns), table


def qc_files(spark: SparkSession, path: str, folder: str, table: str | None = None, *, region: str | None = None, binary: bool = False, single: str | None = None, command: str = "", **options: Any) -> DataFrame:
    """Quality control from VCF or BCF to VCF or BCF (see variant_sinks.write_variants) and a TSV of the calls; returns the files."""
    header = variants.header(path)
    for line in QC_LINES:
        header = header.with_declared(line)
    if command:
        header = header.with_line(f"##variant_qc_command={command}")
    changed, called = qc_records(variants.records(spark, path, region), **options)
    written = variant_sinks.write_variants(changed, header, folder, binary=binary, single=single)
    if table:
        names = F.array(*[F.lit(s) for s in header.samples]) if header.samples else F.array().cast("array<string>")
        fixed = {"alpha": 4, "beta": 4, "error": 8, "pp": 6}
        rows = called.withColumns({"sample": F.get(names, F.col("sample")), **{c: F.format_string(f"%.{n}f", c) for c, n in fixed.items()}, "mutation": F.when(F.col("mutation"), "True").otherwise("False")})
        sinks.write_table(rows.toDF(*sinks.QC_COLUMNS), table, order=["chrom", "pos", "sample"])
    return written


# The fields of called records, as (id, number, type).
CALL_FORMATS = [("GT", "1", "String"), ("GQ", "1", "Integer"), ("DP", "1", "Integer"), ("AD", ".", "Integer"), ("AF", ".", "Float"), ("CI", "1", "String"), ("AQ", ".", "Integer"), ("LAF", ".", "Float"), ("SB", "1", "String"), ("FS", ".", "Float"), ("SOR", ".", "Float"), ("VT", "1", "String")]
CALL_INFOS = [("AN", "1", "Integer"), ("REF_N", "1", "Integer"), ("HET_N", "1", "Integer"), ("HOM_N", "1", "Integer"), ("DP_MEAN", "1", "Integer"), ("DP_MEDIAN", "1", "Integer"), ("VAF_MEAN", "A", "Float"), ("VAF_MEAN_HET", "A", "Float"), ("PT", "1", "String")]


def call_records(calls: DataFrame, sites: DataFrame, samples: Sequence[str]) -> DataFrame:
    """Called sites as records (the columns of variants.SCHEMA but for file and place), with all samples in their order.

    A sample's lists go along its genotype; CI and SB have pairs with semicolons between them. A sample without a call at a
    site has a missing genotype and depth 0. A site's row holds one text a sample, as its line does.
    """
    fixed = lambda c, n: F.when(F.col(c) >= st.INFINITE, "10000").otherwise(F.format_string(f"%.{n}f", c))
    pair = lambda a, b, n: F.concat_ws(",", F.format_string(f"%.{n}f", a), F.format_string(f"%.{n}f", b)) if n else F.concat_ws(",", F.col(a).cast("string"), F.col(b).cast("string"))
    texts = {"gt": F.col("idx").cast("string"), "ad": F.col("ad").cast("string"), "af": al.general_number(F.col("ad") / F.col("dp")), "ci": pair("ci_low", "ci_high", 4), "aq": F.col("aq").cast("string"), "laf": F.when(F.col("ad") >= F.col("dp"), "inf").otherwise(al.general_number(F.col("laf"))), "sb": pair("fwd", "rev", 0), "fs": fixed("fs", 3), "sor": fixed("sor", 3), "vt": F.col("type")}
    rows = calls.groupBy("contig", "pos", "sample").agg(F.array_sort(F.collect_list(F.struct(F.col("idx").alias("i"), *[t.alias(c) for c, t in texts.items()]))).alias("__a"), F.max("dp").alias("dp"), F.max("quality").alias("quality"))
    joined = lambda c, by=",": F.array_join(F.transform("__a", lambda x: x[c]), by)
    value = F.concat_ws(":", joined("gt", "/"), F.floor("quality").cast("string"), F.col("dp").cast("string"), joined("ad"), joined("af"), joined("ci", ";"), joined("aq"), joined("laf"), joined("sb", ";"), joined("fs"), joined("sor"), joined("vt"))
    by_site = rows.groupBy("contig", "pos").agg(F.map_from_entries(F.collect_list(F.struct("sample", value.alias("value")))).alias("__m"))
    every = F.array(*[F.coalesce(F.element_at("__m", F.lit(s)), F.lit(".:0:0")) for s in samples]) if samples else F.array().cast("array<string>")
    numbers = lambda c: F.array_join(F.transform(c, lambda x: al.general_number(x)), ",")
    info = F.concat_ws(";", *[F.concat(F.lit(f"{i}="), numbers(i.lower()) if n == "A" else F.col(i.lower()).cast("string")) for i, n, _ in CALL_INFOS])
    qual = F.when(F.col("quality") > 0, al.general_number(F.col("quality"))).otherwise(".")
    return sites.join(by_site, ["contig", "pos"], "left").select(F.col("contig").alias("chrom"), "pos", F.lit(".").alias("id"), "ref", F.array_join("alts", ",").alias("alt"), qual.alias("qual"), F.lit(".").alias("filter"), info.alias("info"), F.lit(":".join(f for f, *_ in CALL_FORMATS)).alias("format"), every.alias("samples"))


def call_files(spark: SparkSession, reads: str, reference: str, folder: str, *, region: str | None = None, single: str | None = None, binary: bool = False, command: str = "", **options: Any) -> DataFrame:
    """Calls from BAM files and a FASTA file to VCF or BCF with an index; returns the files."""
    contigs = text.fasta(spark, reference)
    rows = bam.reads(spark, reads, region)
    bases = contigs.select("contig", F.posexplode(F.split("sequence", "")).alias("pos", "ref")).where("ref <> ''").withColumn("pos", F.col("pos") + 1)
    calls, sites = caller.call_variants(rows, bases, **options)
    calls, sites = durable(calls), durable(sites)
    if region:
        inside = F.lit(False)
        for chrom, low, high in variants.parsed_regions(region):
            inside = inside | ((F.col("contig") == chrom) & F.col("pos").between(low, high))
        sites = sites.where(inside)
    samples = sorted(r["sample"] for r in rows.select("sample").distinct().collect())
    described = lambda fields: [(i, n, t, i) for i, n, t in fields]
    lengths = [(r["contig"], r["length"]) for r in contigs.select("contig", "length").orderBy("contig").collect()]
    header = VcfHeader(sinks.vcf_header(lengths, samples, described(CALL_FORMATS), described(CALL_INFOS), command))
    return variant_sinks.write_variants(call_records(calls, sites, samples), header, folder, single=single, binary=binary)


# Columns of the tables of estimates.
FAMILY_COLUMNS = "FAM_ID MOTHER_ID N_CHILDREN N_PAIRS N_INFORMATIVE NE_MMLE CI_95_LOW CI_95_HIGH CI_LOW_CLIPPED CI_HIGH_CLIPPED MAX_LOG_LIK MEAN_MOTHER_DP MEAN_CHILD_DP SKIPPED WARNING".split()
BIN_COLUMNS = "bin_idx bin_low bin_high bin_center n_pairs mean_pm mean_pc obs_var obs_var_corr obs_F obs_F_se expected_var_at_ne expected_var_at_ne_ci_low expected_var_at_ne_ci_high expected_F_at_ne expected_F_at_ne_ci_low expected_F_at_ne_ci_high".split()
PROFILE_COLUMNS = "ne_candidate mmle_log_lik mmle_delta_2ll kimura_ssr kimura_norm_ssr".split()


def family_table(pairs: DataFrame, fits: DataFrame, kimura: bool = False) -> DataFrame:
    """Families' fits (bottleneck.families) under their table's columns: counts of children and mean depths beside them, NA where a
    family was skipped; with ``kimura``, its drift moments as well."""
    fam = F.when(F.coalesce("fam", F.lit("")) == "", "ALL").otherwise(F.col("fam"))
    child = F.when(F.col("child") != "", F.col("child"))
    counts = pairs.groupBy(fam.alias("fam"), "mother").agg(F.count_distinct(child).alias("children"), F.avg("m_dp").alias("mother_dp"), F.avg("c_dp").alias("child_dp"))
    rows = fits.join(counts, ["fam", "mother"], "left")
    fitted = lambda c: F.when(F.col("skipped"), "NA").otherwise(c)
    truth = lambda c: F.when(F.col(c), "TRUE").otherwise("FALSE")
    values = [F.col("fam"), F.col("mother"), F.col("children"), F.col("sites"), F.col("informative"), *(fitted(al.general_number(F.col(c), 4)) for c in ("ne", "ci_low", "ci_high")), *(fitted(truth(c)) for c in ("low_clipped", "high_clipped")), fitted(al.general_number(F.col("max_ll"), 8)), *(al.general_number(F.col(c), 2) for c in ("mother_dp", "child_dp"))]
    names, more = FAMILY_COLUMNS[:-2], []
    if kimura:
        moments = drift.kimura(drift.terms(pairs.withColumn("fam", fam)), ["fam", "mother"]).select("fam", "mother", F.col("b").alias("k_b"), F.col("ne").alias("k_ne"), F.col("n").alias("k_n"))
        rows = rows.join(moments, ["fam", "mother"], "left")
        more = [F.coalesce(al.general_number(F.col(c), 8), F.lit("NA")) for c in ("k_b", "k_ne")] + [F.coalesce(F.col("k_n").cast("string"), F.lit("NA"))]
        names = [*names, "KIMURA_b", "KIMURA_NE", "KIMURA_N_INFORMATIVE"]
    values += [*more, truth("skipped"), F.coalesce("warning", F.lit(""))]
    return rows.select(*[v.alias(n) for v, n in zip(values, [*names, *FAMILY_COLUMNS[-2:]], strict=True)])


def bin_table(pairs: DataFrame, fit: dict[str, Any], low: float, high: float, bins: int) -> DataFrame:
    """Means of drift by bin of the mother's share, empty bins with zeros, beside what the fitted size makes one expect at the bin's middle.

    A smaller size means more drift: the lower expectation comes from the interval's upper end.
    """
    width = (high - low) / bins
    index = F.least(F.greatest(F.floor((F.col("p") - low) / width), F.lit(0)), F.lit(bins - 1)).cast("int")
    sums = {"mean_pm": F.avg("p"), "mean_pc": F.avg("c"), "obs_var": F.avg("d"), "obs_var_corr": F.avg("r"), "obs_F": F.avg("f"), "obs_F_se": F.coalesce(F.stddev_samp("f") / F.sqrt(F.count("*")), F.lit(0.0))}
    found = drift.terms(pairs).where(F.col("p").between(low, high)).groupBy(index.alias("bin_idx")).agg(F.count("*").alias("n_pairs"), *[c.alias(n) for n, c in sums.items()])
    every = pairs.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin_idx"))
    ends = {"bin_low": F.lit(low) + width * F.col("bin_idx"), "bin_high": F.when(F.col("bin_idx") == bins - 1, F.lit(high)).otherwise(F.lit(low) + width * (F.col("bin_idx") + 1))}
    rows = every.join(found, "bin_idx", "left").fillna(0).withColumns(ends).withColumn("bin_center", (F.col("bin_low") + F.col("bin_high")) / 2)
    spread = F.col("bin_center") * (1 - F.col("bin_center"))
    sizes = {"at_ne": fit["ne"], "at_ne_ci_low": fit["ci_high"] or fit["ne"], "at_ne_ci_high": fit["ci_low"] or fit["ne"]}
    for name, ne in sizes.items():
        rows = rows.withColumns({f"expected_var_{name}": spread / ne if ne else F.lit(0.0), f"expected_F_{name}": F.lit(1 / ne if ne else 0.0)})
    return rows.select(*BIN_COLUMNS)


def profile_table(pairs: DataFrame, low: float, high: float, step: float, model: str = "continuous") -> DataFrame:
    """The likelihood and the drift's squared residuals over a grid of sizes, each beside its distance from the best of them."""
    sizes = [low + step * i for i in range(int((high - low) / step + 1e-9) + 1)]
    grid = likelihood_grid(pairs, sizes, model)
    residuals = drift.squared_residuals(drift.terms(pairs), sizes).select(F.round("ne", 6).alias("ne"), "ssr")
    best = grid.agg(F.max("ll").alias("top")).crossJoin(residuals.agg(F.min("ssr").alias("least")))  # one row
    rows = grid.join(residuals, "ne").crossJoin(F.broadcast(best))
    ratio = F.when(F.col("least") > 0, F.col("ssr") / F.col("least")).otherwise(F.lit(1.0))
    return rows.select("ne", "ll", (-2 * (F.col("ll") - F.col("top"))).alias("d"), "ssr", ratio.alias("ratio")).toDF(*PROFILE_COLUMNS)


def likelihood_grid(pairs: DataFrame, sizes: Sequence[float], model: str) -> DataFrame:
    informative = pairs.where("p > 0 AND p < 1")
    return bottleneck.surface(informative, list(sizes), model).select(F.round("ne", 6).alias("ne"), "ll")


def estimate_files(spark: SparkSession, pairs: str, out: str, *, families: str | None = None, bins: str | None = None, profile: str | None = None, low_share: float = 0.10, high_share: float = 0.90, low: int = 1, high: int = 100, model: str = "continuous", n_bins: int = 10, step: float = 0.1, least: int = 3, resamples: int = 1000, seed: int = 42, command: str = "") -> dict[str, Any]:
    """The bottleneck size of a pair table as JSON, and on demand tables by family, by bin of the mother's share and by size; each table
    begins with what it was made from, as ``#key=value`` lines. Returns what the JSON holds."""
    rows = durable(bottleneck.load_pairs(text.pair_table(spark, pairs), low_share, high_share))
    fit = bottleneck.estimate(rows, low, high, model)
    moments = bottleneck.kimura(rows)
    if moments["n"] and resamples:
        ends = drift.bootstrap(drift.terms(rows), resamples, seed, ["chrom", "pos", "alt", "fam", "mother", "child", "m_alt", "m_dp", "c_alt", "c_dp"]).first()
        moments |= {"ne_low": 1 / (1 - ends["low"]), "ne_high": 1 / (1 - ends["high"])}
    result = {"model": model, "min_vaf": low_share, "max_vaf": high_share, "min_ne": low, "max_ne": high, "fit": fit, "kimura": moments}
    head = [command] * bool(command) + [f"{k}={v}" for k, v in {"model": model, "min_vaf": low_share, "max_vaf": high_share}.items()]
    number = lambda x: "NA" if x is None else f"{x:.8g}"
    fitted = [f"fitted_ne={number(fit['ne'])}", f"fitted_ne_ci_low={number(fit['ci_low'])}", f"fitted_ne_ci_high={number(fit['ci_high'])}", f"max_marginal_log_lik={number(fit['max_ll'])}"]
    drifted = [f"kimura_{k}={number(moments[k])}" for k in ("b", "ne") if moments[k] is not None]
    if families:
        fits = durable(bottleneck.families(rows, max(low, 2), high, least))
        counts = {r["skipped"]: r["n"] for r in fits.groupBy("skipped").agg(F.count("*").alias("n")).collect()}
        lines = [*head, f"min_ne={low}", f"max_ne={high}", f"n_families={sum(counts.values())}", f"n_families_estimated={counts.get(False, 0)}", f"n_families_skipped={counts.get(True, 0)}", f"population_ne={number(fit['ne'])}", f"population_ne_ci_low={number(fit['ci_low'])}", f"population_ne_ci_high={number(fit['ci_high'])}"]
        sinks.write_table(family_table(rows, fits, kimura=moments["n"] > 0), families, lines, ["FAM_ID", "MOTHER_ID"])
        result["families"] = sum(counts.values())
    numeric = lambda df: df.select(*[al.general_number(F.col(c), 8).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    if bins:
        table = bin_table(rows, fit, low_share, high_share, n_bins)
        ordered = numeric(table)
        sinks.write_table(ordered, bins, [*head, f"n_bins={n_bins}", f"n_pairs_used={fit['n']}", *fitted, *drifted], ["bin_idx"])
    if profile:
        table = durable(profile_table(rows, float(max(low, 2) if model == "continuous" else low), float(high), step, model))
        best = table.agg(F.max_by("ne_candidate", F.struct("mmle_log_lik", -F.col("ne_candidate"))).alias("ll"), F.min_by("ne_candidate", F.struct("kimura_ssr", "ne_candidate")).alias("ssr")).first()
        lines = [*head, f"n_pairs_used={fit['n']}", f"profile_min_ne={low}", f"profile_max_ne={high}", f"profile_step={step}", *fitted, f"best_ne_mmle_on_grid={number(best['ll'])}", f"best_ne_kimura_on_grid={number(best['ssr'])}", *drifted]
        text_rows = numeric(table).withColumn("ne_candidate", F.col("ne_candidate").cast("double"))
        sinks.write_table(text_rows, profile, lines, ["ne_candidate"])
    sinks.write_json(spark, result, out)
    return result
