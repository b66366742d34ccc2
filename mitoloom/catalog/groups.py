"""Aggregates, joins, windows and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mitoloom.catalog.base import Views, query
from mitoloom.catalog.rows import CONTINUOUS, MAJOR, USABLE, Z, sql_ranges
from mitoloom.functions import alleles as al
from mitoloom.functions import stats as st
from mitoloom.operators import annotate, cohort, copynum, drift, filters, intervals, likelihood, pedigree, pileup, summaries
from mitoloom.operators.filters import BLACKLIST

# ---- aggregates


@query("agg01_agg02_allele_depth", "SELECT pos, sample, allele, CAST(ad AS BIGINT) AS ad, CAST(dp AS BIGINT) AS dp FROM calls")
def _(v: Views) -> DataFrame:
    return pileup.allele_depths(v.pileup, ["pos", "sample"]).select("pos", "sample", "allele", "ad", "dp")


@query("agg03_allele_universe", "SELECT pos, array_to_string(list_sort(list_distinct(list(allele) || ['A', 'C', 'G', 'T'])), ',') AS alleles FROM pileup WHERE allele <> 'N' GROUP BY pos")
def _(v: Views) -> DataFrame:
    return cohort.allele_universe(v.pileup.where("allele <> 'N'"), ["pos"]).select("pos", F.array_join("alleles", ",").alias("alleles"))


@query("agg04_first_ref", "SELECT pos, sample, min_by(allele, read_id * 10 + rank_in_read) AS ref FROM pileup GROUP BY 1, 2")
def _(v: Views) -> DataFrame:
    # rows of equal read and rank: the first in the table
    return cohort.first_seen(v.placed("pileup"), ["pos", "sample"], "allele", ["read_id", "rank_in_read", "file", "row"]).withColumnRenamed("allele", "ref")


@query("agg08_major_allele", "SELECT pos, sample, allele, ad FROM calls QUALIFY row_number() OVER (PARTITION BY pos, sample ORDER BY ad DESC, allele) = 1")
def _(v: Views) -> DataFrame:
    return cohort.major_alleles(v.calls, ["pos", "sample"])


@query("agg09_strand_counts", MAJOR + "SELECT pos, allele, fwd, rev, depth, k = 1 AS is_major, round(CASE WHEN mr * fwd <= 0 THEN 10000.0 ELSE CAST(mf * rev AS DOUBLE) / (mr * fwd) END, 6) AS sor FROM m")
def strand_counts(v: Views) -> DataFrame:
    rows = pileup.with_major(pileup.strand_counts(v.pileup, ["pos"]), ["pos"])
    sor = st.strand_odds_ratio(F.col("major_fwd"), F.col("major_rev"), F.col("fwd"), F.col("rev"))
    return rows.select("pos", "allele", "fwd", "rev", "depth", "is_major", F.round(sor, 6).alias("sor"))


@query("agg10_agg11_site_alleles", "SELECT pos, arg_max(ref, length(ref) * 1000 + ascii(ref)) AS longest, array_to_string(list_sort(list_distinct(list(alt))), ',') AS alts FROM alts GROUP BY pos")
def _(v: Views) -> DataFrame:
    return cohort.site_alleles(v.alts, ["pos"]).select("pos", "longest", F.array_join(F.array_sort("alts"), ",").alias("alts"))


@query("agg12_site_quality", "SELECT pos, max(CASE WHEN qual < 50 THEN qual END) AS quality FROM pileup GROUP BY pos")
def _(v: Views) -> DataFrame:
    return cohort.site_quality(v.pileup, ["pos"], 50)


SITE = """
WITH g AS (SELECT * FROM genotyped WHERE {chosen}),
smp AS (SELECT pos, sample, max(dp) AS dp, {het} AS het, max(idx) AS top FROM g GROUP BY 1, 2),
site AS (SELECT pos, CAST(count(*) AS BIGINT) AS an,
  CAST(count(CASE WHEN NOT het AND top = 0 THEN 1 END) AS BIGINT) AS ref_n, CAST(count(CASE WHEN het THEN 1 END) AS BIGINT) AS het_n,
  CAST(count(CASE WHEN NOT het AND top > 0 THEN 1 END) AS BIGINT) AS hom_n,
  CAST({depth}(avg(dp){digits}) AS BIGINT) AS dp_mean, CAST({depth}(median(dp){digits}) AS BIGINT) AS dp_median FROM smp GROUP BY pos),
alt AS (SELECT g.pos, g.idx, sum({vaf}) AS total, coalesce(avg(CASE WHEN smp.het THEN {vaf} END), 0.0) AS vaf_mean_het
  FROM g JOIN smp ON smp.pos = g.pos AND smp.sample = g.sample WHERE g.idx > 0 GROUP BY 1, 2)
SELECT site.pos, site.an, ref_n, het_n, hom_n, dp_mean, dp_median, alt.idx, round(alt.total / site.an, {places}) AS vaf_mean,
  round(alt.vaf_mean_het, {places}) AS vaf_mean_het,
  CASE WHEN het_n > 0 AND hom_n > 0 THEN 'Mixed' WHEN het_n > 0 THEN 'Het' WHEN hom_n > 0 THEN 'Hom' WHEN ref_n > 0 THEN 'Ref' ELSE 'Unknown' END AS pt
FROM site LEFT JOIN alt ON alt.pos = site.pos"""


def _site_rows(calls: DataFrame, mode: str, places: int) -> DataFrame:
    rows = cohort.site_info(calls, mode).join(cohort.alt_shares(calls, mode), "pos", "left")
    return rows.withColumns({c: F.round(c, places) for c in ("vaf_mean", "vaf_mean_het")})


@query("agg13_site_info", SITE.format(chosen="true", het="count(*) > 1", vaf="g.af", depth="round_even", digits=", 0", places=9))
def _(v: Views) -> DataFrame:
    return _site_rows(v.genotyped, "call", 9)


@query("agg17_subset_info", SITE.format(chosen="sample IN ('s1', 's3', 's5', 's7')", het="min(idx) < max(idx)", vaf="CAST(CAST(g.af AS FLOAT) AS DOUBLE)", depth="floor", digits="", places=5))
def _(v: Views) -> DataFrame:
    chosen = v.spark.createDataFrame([(f"s{i}",) for i in (1, 3, 5, 7)], "sample string")
    kept = cohort.subset(v.genotyped, chosen, keep_all=True)
    return _site_rows(kept, "subset", 5)


@query("agg18_used_alleles", "SELECT pos, array_to_string(list_sort(list_distinct(list(allele) FILTER (WHERE idx > 0))), ',') AS used FROM genotyped GROUP BY pos")
def _(v: Views) -> DataFrame:
    return cohort.used_alleles(v.genotyped, ["pos"]).select("pos", F.when(F.size("used") > 0, F.array_join(F.array_sort("used"), ",")).alias("used"))


@query("agg19_fragments", "SELECT contig, CAST(sum(greatest(f, 1)) AS BIGINT) AS fragments FROM (SELECT rname AS contig, qname, count(CASE WHEN flag & 64 <> 0 THEN 1 END) AS f FROM reads WHERE flag & 4 = 0 AND flag & 256 = 0 AND flag & 2048 = 0 GROUP BY 1, 2) GROUP BY contig")
def _(v: Views) -> DataFrame:
    return copynum.fragments(filters.countable(v.reads, 0), paired=True)


@query("agg20_sequencing_type", "SELECT bool_or(flag & 1 <> 0) AS paired FROM (SELECT flag FROM reads WHERE flag & 4 = 0 ORDER BY read_id LIMIT 1000)")
def _(v: Views) -> DataFrame:
    return copynum.paired_end(v.reads)


@query("agg21_gc_share", "SELECT source, round(CAST(sum(length(regexp_replace(seq, '[^GCgc]', '', 'g'))) AS DOUBLE) / nullif(sum(length(regexp_replace(seq, '[^ACGTacgt]', '', 'g'))), 0), 6) AS gc FROM segments GROUP BY source")
def _(v: Views) -> DataFrame:
    return copynum.gc_share(v.segments, "source", "seq").withColumn("gc", F.round("gc", 6))


MERGED = "WITH o AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS fresh FROM regions), i AS (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM o), merged AS (SELECT chrom, min(s) AS s, max(e) AS e, CAST(count(*) AS BIGINT) AS n FROM i GROUP BY chrom, island) "


@query("agg22_interval_merge", MERGED + "SELECT chrom, s, e, n FROM merged")
def _(v: Views) -> DataFrame:
    return intervals.merged(v.regions, ["chrom"]).select("chrom", "s", "e", "n")


@query("agg22_effective_length", MERGED + "SELECT contig, coalesce(CAST(sum(e - s + 1) AS BIGINT), 0) AS effective_length FROM contigs LEFT JOIN merged ON chrom = contig GROUP BY contig")
def _(v: Views) -> DataFrame:
    return intervals.effective_lengths(v.contigs, v.regions).select("contig", "effective_length")


COUNTS = "WITH c AS (SELECT contig, length, CAST(count(*) AS BIGINT) AS fragments FROM contigs JOIN customer ON c_nationkey = nation JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2), r AS (SELECT contig, fragments, (CAST(fragments AS DOUBLE) / sum(fragments) OVER ()) / (CAST(length AS DOUBLE) / sum(length) OVER ()) AS ratio FROM c) "


def contig_counts(v: Views) -> DataFrame:
    people = v.customer.select("c_custkey", F.col("c_nationkey").cast("bigint").alias("nation"))
    orders = v.orders.groupBy(F.col("o_custkey").alias("c_custkey")).count()
    return orders.join(people, "c_custkey").groupBy("nation").agg(F.sum("count").alias("fragments")).join(v.contigs, "nation").select("contig", "length", "fragments")


@query("agg23_ratio", COUNTS + "SELECT contig, fragments, round(ratio, 6) AS ratio FROM r")
def _(v: Views) -> DataFrame:
    return copynum.ratios(contig_counts(v)).select("contig", "fragments", F.round("ratio", 6).alias("ratio"))


@query("agg24_mean_interval", "SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(1.96 * stddev_samp(l_quantity) / sqrt(count(*)), 6) AS half FROM lineitem GROUP BY 1")
def _(v: Views) -> DataFrame:
    return summaries.mean_interval(v.lineitem, ["l_returnflag"], "l_quantity").select("l_returnflag", F.round("mean", 6).alias("mean"), F.round("half", 6).alias("half"))


@query("agg25_copy_number", COUNTS + "SELECT b.contig, round(avg(x), 6) AS cn, round(avg(x) - 1.96 * stddev_samp(x) / sqrt(count(x)), 6) AS cn_low, round(avg(x) + 1.96 * stddev_samp(x) / sqrt(count(x)), 6) AS cn_high FROM (SELECT b.contig, CASE WHEN b.contig = 'chrM' THEN 2.0 ELSE 1.0 END * b.ratio / a.ratio AS x FROM r b, r a WHERE regexp_full_match(a.contig, '(chr)?([1-9]|1[0-9]|2[0-2])')) b GROUP BY b.contig")
def _(v: Views) -> DataFrame:
    return copynum.copy_numbers(copynum.ratios(contig_counts(v))).select("contig", *[F.round(c, 6).alias(c) for c in ("cn", "cn_low", "cn_high")])


@query("agg26_match_report", "SELECT CAST(count(*) AS BIGINT) AS trios, CAST(count(CASE WHEN c.sample IS NOT NULL AND m.sample IS NOT NULL THEN 1 END) AS BIGINT) AS matched, CAST(count(CASE WHEN c.sample IS NULL THEN 1 END) AS BIGINT) AS no_child, CAST(count(CASE WHEN m.sample IS NULL THEN 1 END) AS BIGINT) AS no_mother FROM pedigree LEFT JOIN (SELECT DISTINCT CAST(o_custkey AS STRING) AS sample FROM orders) c ON child = c.sample LEFT JOIN (SELECT DISTINCT CAST(o_custkey AS STRING) AS sample FROM orders) m ON mother = m.sample")
def _(v: Views) -> DataFrame:
    return pedigree.match_report(pedigree.mother_status(v.pedigree, v.orders.select(F.col("o_custkey").cast("string").alias("sample"))))


SIZES = [2.0, 4.0, 6.0, 9.0, 13.0, 20.0, 30.0, 50.0, 80.0]
SURFACE = USABLE + f", grid AS (SELECT unnest({SIZES}) AS ne), surface AS (SELECT ne, sum({CONTINUOUS}) AS ll FROM usable, grid WHERE p > 0 AND p < 1 GROUP BY ne) "


def grid_of(v: Views) -> DataFrame:
    return likelihood.surface(filters.informative(filters.usable_pairs(v.pairs)), SIZES)


@query("agg27_ll_surface", SURFACE + "SELECT ne, round(ll, 2) AS ll FROM surface")
def _(v: Views) -> DataFrame:
    return grid_of(v).select("ne", F.round("ll", 2).alias("ll"))


TERMS = USABLE + ", terms AS (SELECT *, r / w AS f FROM (SELECT *, d - s AS r FROM (SELECT row_a, row_b, fam, mother, child, m_dp, c_dp, p, c, p * (1 - p) AS w, (c - p) * (c - p) AS d, p * (1 - p) / m_dp + c * (1 - c) / c_dp AS s FROM usable WHERE p > 0 AND p < 1))) "


def term_rows(v: Views) -> DataFrame:
    return drift.terms(filters.usable_pairs(v.pairs))


@query("scl22_drift_terms", TERMS + "SELECT row_a, row_b, round(w, 12) AS w, round(d, 12) AS d, round(s, 15) AS s, round(f, 9) + 0.0 AS f FROM terms")
def _(v: Views) -> DataFrame:
    return term_rows(v).select("row_a", "row_b", *[F.round(c, n).alias(c) for c, n in (("w", 12), ("d", 12), ("s", 15))], (F.round("f", 9) + F.lit(0.0)).alias("f"))


@query("agg28_kimura_b", TERMS + "SELECT CAST(count(*) AS BIGINT) AS n, round(b, 6) AS b, round(1 / (1 - b), 4) AS ne FROM (SELECT row_a, least(1 - 1e-9, greatest(1e-9, 1 - sum(r) OVER () / sum(w) OVER ())) AS b FROM terms) GROUP BY b")
def _(v: Views) -> DataFrame:
    return drift.kimura(term_rows(v)).select("n", F.round("b", 6).alias("b"), F.round("ne", 4).alias("ne"))


@query("agg30_trimmed_b", TERMS + ", k AS (SELECT *, row_number() OVER (ORDER BY f DESC, row_a, row_b) AS i, count(*) OVER () AS n FROM terms) SELECT CAST(count(*) AS BIGINT) AS n, round(1 - sum(r) / sum(w), 6) AS b FROM k WHERE i > floor(0.05 * n)")
def _(v: Views) -> DataFrame:
    return drift.kimura(drift.trimmed(term_rows(v), 0.05, ["row_a", "row_b"])).select("n", F.round("b", 6).alias("b"))


@query("agg31_bins", TERMS + "SELECT CAST(bin AS INT) AS bin, CAST(count(f) AS BIGINT) AS n, round(avg(p), 6) AS mean_p, round(avg(f), 6) AS mean_f, round(stddev_samp(f) / sqrt(count(f)), 6) AS se_f FROM (SELECT unnest(range(0, 10)) AS bin) LEFT JOIN terms ON least(greatest(floor((p - 0.1) / ((0.9 - 0.1) / 10)), 0), 9) = bin GROUP BY bin")
def _(v: Views) -> DataFrame:
    return drift.binned(term_rows(v), 0.1, 0.9, 10).select("bin", "n", *[F.round(c, 6).alias(c) for c in ("mean_p", "mean_f", "se_f")])


@query("agg32_ssr", TERMS + f"SELECT ne, round(sum((r - w / ne) * (r - w / ne)), 5) AS ssr, round(sum(w * w) / sum(r * w), 4) AS best_ne FROM terms, (SELECT unnest({SIZES}) AS ne) GROUP BY ne")
def _(v: Views) -> DataFrame:
    return drift.squared_residuals(term_rows(v), SIZES).select("ne", F.round("ssr", 5).alias("ssr"), F.round("best_ne", 4).alias("best_ne"))


@query("agg33_families", USABLE + "SELECT fam, mother, CAST(count(*) AS BIGINT) AS sites, CAST(count(DISTINCT child) AS BIGINT) AS children, round(avg(m_dp), 6) AS mother_depth, round(avg(c_dp), 6) AS child_depth, CAST(count(CASE WHEN p > 0 AND p < 1 THEN 1 END) AS BIGINT) AS informative FROM usable GROUP BY 1, 2")
def _(v: Views) -> DataFrame:
    return pedigree.families(filters.usable_pairs(v.pairs)).withColumns({c: F.round(c, 6) for c in ("mother_depth", "child_depth")})


@query("agg35_background_mean", "SELECT pos, CAST(count(*) AS BIGINT) AS n, round(avg(1 - af), 6) AS error FROM calls WHERE af >= 0.5 GROUP BY pos")
def _(v: Views) -> DataFrame:
    return v.calls.where("af >= 0.5").groupBy("pos").agg(F.count("*").alias("n"), F.round(F.avg(1 - F.col("af")), 6).alias("error"))


DENSITY = "exp((2.0 - 1) * ln(m) + (5.0 - 1) * ln(1 - m) - (lgamma(2.0) + lgamma(5.0) - lgamma(7.0)))"


@query("agg37_kl_histogram", f"WITH h AS (SELECT pos, least(9, floor(af * 10)) AS b, CAST(count(*) AS DOUBLE) AS n FROM calls WHERE af > 0 AND af < 1 GROUP BY 1, 2), t AS (SELECT *, n / sum(n) OVER (PARTITION BY pos) AS q, (b + 0.5) / 10 AS m FROM h) SELECT pos, round(sum(q * ln(q / ({DENSITY} / 10))), 5) AS kl FROM t GROUP BY pos")
def _(v: Views) -> DataFrame:
    from mitoloom.plans.variant_qc import histogram_divergence

    return histogram_divergence(v.calls, ["pos"], 10, 2.0, 5.0).select("pos", F.round("kl", 5).alias("kl"))


@query("agg38_site_pass", "SELECT pos, bool_or(ad >= 2 AND af >= 0.4 AND idx > 0) AS pass FROM calls GROUP BY pos")
def _(v: Views) -> DataFrame:
    return cohort.site_pass(v.calls, ["pos"], (F.col("ad") >= 2) & (F.col("af") >= 0.4) & (F.col("idx") > 0))


@query("agg40_allele_counts", "SELECT pos, idx, ac, an, round(CAST(ac AS DOUBLE) / an, 6) AS af FROM (SELECT pos, idx, CAST(count(*) AS BIGINT) AS ac, CAST(sum(count(*)) OVER (PARTITION BY pos) AS BIGINT) AS an FROM genotyped GROUP BY 1, 2) WHERE idx > 0")
def _(v: Views) -> DataFrame:
    return cohort.allele_counts(v.genotyped.select("pos", "idx")).select("pos", "idx", "ac", "an", F.round("af", 6).alias("af"))


RANKS = "rank() OVER ({p} ORDER BY {x}) + (count(*) OVER (PARTITION BY {k}{x}) - 1) / 2.0"


@query("agg41_spearman_rho", f"WITH r AS (SELECT l_returnflag AS k, l_linenumber AS g, {RANKS.format(p='PARTITION BY l_returnflag, l_linenumber', x='l_quantity', k='l_returnflag, l_linenumber, ')} AS x, {RANKS.format(p='PARTITION BY l_returnflag, l_linenumber', x='l_discount', k='l_returnflag, l_linenumber, ')} AS y FROM lineitem) SELECT k, g, CAST(count(*) AS BIGINT) AS n, round(corr(x, y), 6) AS rho FROM r GROUP BY 1, 2 HAVING count(*) >= 15")
def _(v: Views) -> DataFrame:
    rows = v.lineitem.select(F.col("l_returnflag").alias("k"), F.col("l_linenumber").alias("g"), "l_quantity", "l_discount")
    return annotate.spearman(rows, ["k", "g"], "l_quantity", "l_discount", 15).withColumn("rho", F.round("rho", 6))


@query("scl06_rank_sum", f"WITH r AS (SELECT l_returnflag AS k, l_linestatus = 'O' AS one, {RANKS.format(p='PARTITION BY l_returnflag', x='l_quantity DESC', k='l_returnflag, ').replace('l_returnflag, l_quantity DESC', 'l_returnflag, l_quantity')} AS x FROM lineitem), s AS (SELECT k, count(CASE WHEN one THEN 1 END)::DOUBLE AS n1, count(CASE WHEN NOT one THEN 1 END)::DOUBLE AS n2, sum(CASE WHEN one THEN x END) AS s FROM r GROUP BY k) SELECT k, n1::BIGINT AS n1, n2::BIGINT AS n2, CASE WHEN n1 > 0 AND n2 > 0 THEN round((s - n1 * (n1 + n2 + 1) / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12), 6) END AS z FROM s")
def _(v: Views) -> DataFrame:
    rows = v.lineitem.select(F.col("l_returnflag").alias("k"), (F.col("l_linestatus") == "O").alias("one"), "l_quantity")
    return annotate.rank_sums(rows, ["k"], "l_quantity", "one").select("k", "n1", "n2", F.round("z", 6).alias("z"))


@query("agg42_sample_counts", "SELECT sample, CAST(count(*) AS BIGINT) AS total, CAST(count(CASE WHEN ad >= 2 THEN 1 END) AS BIGINT) AS good FROM calls WHERE idx > 0 GROUP BY sample")
def _(v: Views) -> DataFrame:
    return cohort.sample_counts(v.calls, F.col("ad") >= 2)


@query("agg43_z_scores", Z + "SELECT vec_id, CAST(d AS INT) AS d, round(z, 5) + 0.0 AS z FROM z")
def _(v: Views) -> DataFrame:
    from mitoloom.operators.recalibrate import standardized

    rows = standardized(v.embeddings.select("vec_id", F.col("embedding").alias("features")))
    each = rows.select("vec_id", F.posexplode("features").alias("at", "z"))
    return each.select("vec_id", (F.col("at") + 1).alias("d"), (F.round("z", 5) + F.lit(0.0)).alias("z"))


@query("agg44_gmm")
def _(v: Views) -> DataFrame:
    from mitoloom.operators.recalibrate import fit_mixtures

    rows = v.part.select(F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("features"))
    return v.spark.createDataFrame([(k, round(float(b), 4)) for k, b in fit_mixtures(rows, 10)[1]], "k int, bic double")


@query("agg44_agg45_recalibrated")
def _(v: Views) -> DataFrame:
    from mitoloom.operators.recalibrate import recalibrated

    return recalibrated(v.vectors).select("vec_id", "truth", "failing", "negative", F.round("score", 4).alias("score"), F.round("quality", 1).alias("quality"), "culprit")


@query("agg45_sensitivity_cutoff", "SELECT max(score) AS cutoff FROM (SELECT l_extendedprice AS score, count(*) OVER (ORDER BY l_extendedprice DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS got, count(*) OVER () AS n FROM lineitem WHERE l_returnflag = 'R') WHERE got > 0.95 * n")
def _(v: Views) -> DataFrame:
    from mitoloom.operators.recalibrate import sensitivity_cutoff

    return sensitivity_cutoff(v.lineitem.select(F.col("l_extendedprice").alias("score"), (F.col("l_returnflag") == "R").alias("truth")))


@query("agg45_worst_feature", "SELECT vec_id, CAST(list_position(embedding, list_min(embedding)) - 1 AS BIGINT) AS worst FROM embeddings")
def _(v: Views) -> DataFrame:
    from mitoloom.operators.recalibrate import worst_feature

    return v.embeddings.select("vec_id", worst_feature(F.col("embedding")).alias("worst"))


@query("agg46_tally", "SELECT threshold, CAST(count(CASE WHEN value >= threshold THEN 1 END) AS BIGINT) AS n FROM events, (SELECT unnest([10.0, 50.0, 90.0]) AS threshold) GROUP BY threshold")
def _(v: Views) -> DataFrame:
    from mitoloom.operators.recalibrate import tally

    return tally(v.events.select(F.col("value").alias("score")), [10.0, 50.0, 90.0])


@query("agg47_inbreeding", "SELECT pos, round(1 - het / (2 * p * (1 - p) * n), 6) AS f FROM (SELECT *, hom_ref + het + hom_alt AS n, (2.0 * hom_ref + het) / (2.0 * (hom_ref + het + hom_alt)) AS p FROM (SELECT pos, CAST(count(CASE WHEN allele = 'A' THEN 1 END) AS DOUBLE) AS hom_ref, CAST(count(CASE WHEN allele = 'N' THEN 1 END) AS DOUBLE) AS het, CAST(count(CASE WHEN allele = 'R' THEN 1 END) AS DOUBLE) AS hom_alt FROM pileup GROUP BY pos)) WHERE p > 0 AND p < 1")
def _(v: Views) -> DataFrame:
    counts = v.pileup.groupBy("pos").agg(*[F.count_if(F.col("allele") == a).cast("double").alias(n) for a, n in (("A", "hom_ref"), ("N", "het"), ("R", "hom_alt"))])
    return annotate.inbreeding(counts).where("f IS NOT NULL").select("pos", F.round("f", 6).alias("f"))


@query("agg48_summary_helpers", "SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS sd, arg_max(event_id, value * 1e6 - event_id / 1e9) AS at_max FROM events GROUP BY 1")
def _(v: Views) -> DataFrame:
    return summaries.summary(v.events, ["event_type"], "value", "event_id").select("event_type", *[F.round(c, 6).alias(c) for c in ("mean", "median", "sd")], "at_max")


@query("agg49_duplicates", "SELECT l_orderkey, l_suppkey, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(v: Views) -> DataFrame:
    return summaries.duplicates(v.lineitem, ["l_orderkey", "l_suppkey"])


# ---- joins


@query("jn01_filled_grid", "SELECT p.pos, s.sample, coalesce(sum(c.ad), 0)::BIGINT AS depth FROM (SELECT DISTINCT pos FROM calls) p CROSS JOIN (SELECT DISTINCT sample FROM calls) s LEFT JOIN calls c ON c.pos = p.pos AND c.sample = s.sample GROUP BY 1, 2")
def _(v: Views) -> DataFrame:
    depths = v.pileup.groupBy("pos", "sample").agg(F.count("*").alias("dp"))
    return pileup.filled_grid(depths).select("pos", "sample", F.col("dp").alias("depth"))


@query("jn02_reference_base", "SELECT pos, allele, substring('ACGTN', 1 + pos % 5, 1) AS ref, CAST(count(*) AS BIGINT) AS n FROM pileup GROUP BY 1, 2, 3")
def _(v: Views) -> DataFrame:
    reference = v.part.select(F.col("p_partkey").cast("int").alias("pos"), F.substring(F.lit("ACGTN"), (1 + F.col("p_partkey") % 5).cast("int"), F.lit(1)).alias("ref"))
    return v.pileup.join(reference, "pos").groupBy("pos", "allele", "ref").agg(F.count("*").alias("n"))


@query("jn03_child_and_mother", "SELECT child, mother FROM pedigree WHERE child IN (SELECT CAST(o_custkey AS STRING) FROM orders) AND mother IN (SELECT CAST(o_custkey AS STRING) FROM orders)")
def _(v: Views) -> DataFrame:
    status = pedigree.mother_status(v.pedigree, v.orders.select(F.col("o_custkey").cast("string").alias("sample")))
    return status.where("has_child AND has_mother").select("child", "mother")


@query("jn04_first_grandmother", "SELECT p.child, g.grandmother FROM pedigree p LEFT JOIN (SELECT child, min_by(mother, line) AS grandmother FROM pedigree WHERE mother NOT IN ('', '0', '.', '-9') AND child NOT IN ('', '0', '.', '-9') GROUP BY child) g ON p.mother = g.child")
def _(v: Views) -> DataFrame:
    return pedigree.with_grandmother(v.pedigree).select("child", "grandmother")


READ = "(SELECT 's' || (l_suppkey % 10) AS sample, CAST(l_partkey AS INT) AS pos, 'R' AS alt, CAST(count(*) AS INT) AS dp, CAST(count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS INT) AS ad_alt FROM lineitem GROUP BY 1, 2)"


@query("jn05_pairs", f"WITH t AS (SELECT 's' || i AS child, 's' || ((i + 3) % 10) AS mother, 's' || ((i + 6) % 12) AS grandmother FROM (SELECT unnest(range(0, 10)) AS i)), c AS {READ} SELECT t.child, t.mother, m.pos, m.dp AS m_dp, m.ad_alt AS m_alt, k.dp AS c_dp, k.ad_alt AS c_alt, CASE WHEN g.sample IS NULL THEN 0 ELSE 1 END AS has_g, CASE WHEN m.dp < 3 OR k.dp < 3 THEN 'LOW_DEPTH' ELSE 'PASS' END AS qc FROM t JOIN c m ON m.sample = t.mother JOIN c k ON k.sample = t.child AND k.pos = m.pos LEFT JOIN c g ON g.sample = t.grandmother AND g.pos = m.pos")
def _(v: Views) -> DataFrame:
    trios = v.spark.createDataFrame([("f", f"s{i}", f"s{(i + 3) % 10}", f"s{(i + 6) % 12}") for i in range(10)], "fam string, child string, mother string, grandmother string")
    calls = v.pileup.groupBy("sample", "pos").agg(F.count("*").cast("int").alias("dp"), F.count_if(F.col("allele") == "R").cast("int").alias("ad_alt")).withColumn("alt", F.lit("R"))
    pairs = pedigree.transmission_pairs(trios, calls, 3)
    return pairs.select("child", "mother", "pos", F.col("mother_dp").alias("m_dp"), F.col("mother_alt").alias("m_alt"), F.col("child_dp").alias("c_dp"), F.col("child_alt").alias("c_alt"), "has_g", "qc")


@query("jn06_clamped_regions", "SELECT region_id, contig, greatest(s, 1) AS s, least(e, length - 999000) AS e FROM regions JOIN contigs ON chrom = contig WHERE greatest(s, 1) <= least(e, length - 999000)")
def _(v: Views) -> DataFrame:
    cut, _ = intervals.clamped(v.regions, v.contigs.withColumn("length", F.col("length") - 999000))
    return cut.select("region_id", F.col("chrom").alias("contig"), "s", "e")


@query("jn07_anchor_in_interval", "SELECT read_id, region_id FROM reads JOIN regions ON rname = chrom AND pos BETWEEN s AND e")
def _(v: Views) -> DataFrame:
    return intervals.binned_join(v.reads.withColumnRenamed("rname", "chrom"), v.regions, "pos", ["chrom"], 64).select("read_id", "region_id")


@query("jn08_ratio_pairs", COUNTS + "SELECT b.contig, a.contig AS autosome, round(b.ratio / a.ratio, 6) AS x FROM r b, r a WHERE regexp_full_match(a.contig, '(chr)?([1-9]|1[0-9]|2[0-2])')")
def _(v: Views) -> DataFrame:
    rows = copynum.ratios(contig_counts(v)).select("contig", "ratio")
    return rows.join(rows.where(al.autosome(F.col("contig"))).select(F.col("contig").alias("autosome"), F.col("ratio").alias("ra")), F.lit(True)).select("contig", "autosome", F.round(F.col("ratio") / F.col("ra"), 6).alias("x"))


@query("jn09_jn10_results_back", "SELECT c.pos, c.sample, c.allele, q.good, s.pass FROM calls c LEFT JOIN (SELECT pos, sample, max(ad) >= 2 AS good FROM calls WHERE dp > 1 GROUP BY 1, 2) q ON q.pos = c.pos AND q.sample = c.sample LEFT JOIN (SELECT pos, bool_or(ad >= 3) AS pass FROM calls GROUP BY 1) s ON s.pos = c.pos")
def _(v: Views) -> DataFrame:
    good = v.calls.where("dp > 1").groupBy("pos", "sample").agg((F.max("ad") >= 2).alias("good"))
    sites = cohort.site_pass(v.calls, ["pos"], F.col("ad") >= 3)
    return cohort.with_results(v.calls, good, sites).select("pos", "sample", "allele", "good", "pass")


@query("jn11_sample_subset", "SELECT pos, sample, idx, ad FROM genotyped WHERE sample IN ('s2', 's4') AND pos IN (SELECT pos FROM genotyped WHERE sample IN ('s2', 's4') GROUP BY pos HAVING sum(dp) > 0 AND max(idx) > 0)")
def _(v: Views) -> DataFrame:
    return cohort.subset(v.genotyped, v.spark.createDataFrame([("s2",), ("s4",)], "sample string")).select("pos", "sample", "idx", "ad")


@query("jn12_range_anti", "SELECT l.l_orderkey, l.l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM regions r WHERE r.chrom = 'chr1' AND l.l_partkey BETWEEN r.s AND r.e)")
def _(v: Views) -> DataFrame:
    rows = v.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return intervals.binned_join(rows, v.regions.where("chrom = 'chr1'"), "l_partkey", [], 64, "left_anti").select("l_orderkey", "l_linenumber")


@query("jn14_range_first", "SELECT p.pos, arg_min(r.region_id, r.s * 1000000 + r.e) AS region_id FROM (SELECT DISTINCT l_partkey AS pos FROM lineitem) p LEFT JOIN regions r ON p.pos BETWEEN r.s AND r.e GROUP BY p.pos")
def _(v: Views) -> DataFrame:
    points = v.lineitem.select(F.col("l_partkey").alias("pos")).distinct()
    return intervals.first_containing(points, v.regions, "pos", [], "region_id").select("pos", "region_id")


@query("jn13_annotation_star", "SELECT p_partkey AS pos, coalesce(n_name, '') AS region, coalesce(r_name, '') AS area, coalesce(s_acctbal, 0.0) AS score FROM part LEFT JOIN nation ON p_partkey % 30 = n_nationkey LEFT JOIN region ON p_partkey % 7 = r_regionkey LEFT JOIN supplier ON p_partkey % 200 = s_suppkey")
def _(v: Views) -> DataFrame:
    rows = v.part.select(F.col("p_partkey").alias("pos"), (F.col("p_partkey") % 30).alias("a"), (F.col("p_partkey") % 7).alias("b"), (F.col("p_partkey") % 200).alias("c"))
    star = [(v.nation.select(F.col("n_nationkey").cast("bigint").alias("a"), F.col("n_name").alias("region")), ["a"], {"region": ""}), (v.region.select(F.col("r_regionkey").cast("bigint").alias("b"), F.col("r_name").alias("area")), ["b"], {"area": ""}), (v.supplier.select(F.col("s_suppkey").alias("c"), F.col("s_acctbal").alias("score")), ["c"], {"score": 0.0})]
    return annotate.star(rows, star).select("pos", "region", "area", "score")


@query("jn15_residue_positions", "SELECT p_partkey, CAST(p_size * 3 + i AS BIGINT) AS pos FROM part, (SELECT unnest([0, 1, 2]) AS i)")
def _(v: Views) -> DataFrame:
    start = F.col("p_size").cast("bigint") * 3
    codons = v.part.select("p_size", F.explode(F.sequence(start, start + 2)).alias("pos"))
    return annotate.residue_positions(v.part.select("p_partkey", "p_size"), codons, ["p_size"]).select("p_partkey", "pos")


@query("jn16_base_pairing", "WITH b AS (SELECT p_partkey AS pos, p_partkey % 4 AS gene, substring('ACGT', CAST(p_size % 4 + 1 AS BIGINT), 1) AS base, p_partkey + 4 * (p_size % 9 - 4) AS pair_pos FROM part) SELECT a.pos, CASE WHEN o.base IS NULL THEN 'loop' WHEN a.base || o.base IN ('AT', 'TA', 'AU', 'UA', 'CG', 'GC') THEN 'WC' ELSE 'non-WC' END AS pairing FROM b a LEFT JOIN b o ON o.gene = a.gene AND o.pos = a.pair_pos")
def _(v: Views) -> DataFrame:
    key = F.col("p_partkey")
    rows = v.part.select(key.alias("pos"), (key % 4).alias("gene"), F.substring(F.lit("ACGT"), F.col("p_size") % 4 + 1, F.lit(1)).alias("base"), (key + 4 * (F.col("p_size") % 9 - 4)).alias("pair_pos"))
    return annotate.base_pairing(rows).select("pos", "pairing")


@query("jn17_jn20_membership", "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 1 ELSE 0 END AS good FROM documents")
def _(v: Views) -> DataFrame:
    return annotate.membership(v.documents.select("doc_id"), v.labels.where("quality = 1"), ["doc_id"], "good")


@query("jn18_range_mark", "SELECT region_id, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_discount > 0.09 AND l_partkey BETWEEN s AND e) THEN 1 ELSE 0 END AS hit FROM regions")
def _(v: Views) -> DataFrame:
    flagged = v.lineitem.where("l_discount > 0.09").select(F.col("l_partkey").alias("at")).distinct()
    hit = intervals.binned_join(flagged, v.regions, "at", [], 64).select("region_id")
    return annotate.membership(v.regions.select("region_id"), hit, ["region_id"], "hit")


@query("jn19_metadata_outer", "SELECT p.p_partkey, n.n_name FROM nation n RIGHT JOIN part p ON p.p_size = n.n_nationkey")
def _(v: Views) -> DataFrame:
    nations = v.nation.select(F.col("n_nationkey").alias("p_size"), "n_name")
    return cohort.with_metadata(v.part.select("p_partkey", "p_size"), nations, ["p_size"]).select("p_partkey", "n_name")


ALIGNED = "SELECT doc_id, unnest(string_split(replace(seq, 'e', '-'), '')) AS a, unnest(string_split(replace(seq, 'a', '-'), '')) AS b, unnest(range(1, length(seq) + 1)) AS i FROM segments"


@query("jn21_alignment_columns", f"SELECT doc_id, CAST((576 + row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1) % 16569 + 1 AS BIGINT) AS pos, a, b FROM ({ALIGNED}) WHERE a <> '-'")
def _(v: Views) -> DataFrame:
    one, other = F.replace("seq", F.lit("e"), F.lit("-")), F.replace("seq", F.lit("a"), F.lit("-"))
    rows = annotate.alignment_columns(v.segments, one, other, 577, 16569, ["doc_id"])
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("one").alias("a"), F.col("other").alias("b"))


@query("jn22_duplicate_children", "SELECT child, CAST(count(*) AS BIGINT) AS n FROM (SELECT CAST(c_custkey % 400 AS STRING) AS child FROM customer) GROUP BY child HAVING count(*) > 1")
def _(v: Views) -> DataFrame:
    return pedigree.unique_children(v.customer.select((F.col("c_custkey") % 400).cast("string").alias("child")))


# ---- windows and order


@query("win01_avg_rank", f"SELECT l_orderkey, l_linenumber, {RANKS.format(p='', x='l_quantity', k='')} AS avg_rank FROM lineitem")
def _(v: Views) -> DataFrame:
    return drift.ranked(v.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity").select("l_orderkey", "l_linenumber", "avg_rank")


@query("win02_outliers", TERMS + "SELECT row_a, row_b, round(f, 4) AS f FROM terms ORDER BY terms.f DESC, row_a, row_b LIMIT 20")
def _(v: Views) -> DataFrame:
    return drift.outliers(term_rows(v), 20, ["row_a", "row_b"]).select("row_a", "row_b", F.round("f", 4).alias("f"))


@query("win03_profile", SURFACE + "SELECT ne, round(-2 * (ll - max(ll) OVER ()), 2) + 0.0 AS deviance FROM surface")
def _(v: Views) -> DataFrame:
    return likelihood.profile(grid_of(v)).select("ne", (F.round("deviance", 2) + F.lit(0.0)).alias("deviance"))


@query("win04_quantiles", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.025), 6) AS low, round(quantile_cont(l_extendedprice, 0.975), 6) AS high FROM lineitem GROUP BY 1")
def _(v: Views) -> DataFrame:
    found = summaries.quantiles(v.lineitem, ["l_returnflag"], "l_extendedprice", [0.025, 0.975])
    return found.select("l_returnflag", F.round("q0", 6).alias("low"), F.round("q1", 6).alias("high"))


@query("win05_profile_ci", SURFACE + ", b AS (SELECT *, max(ll) OVER () AS top, (SELECT arg_max(ne, ll) FROM surface) AS best FROM surface), w AS (SELECT best, max(CASE WHEN ll < top - 1.92 AND ne < best THEN ne END) AS l, min(CASE WHEN ll < top - 1.92 AND ne > best THEN ne END) AS r FROM b GROUP BY best) SELECT w.best, min(b.ne) AS low, max(b.ne) AS high, max(w.l) IS NULL AS low_clipped, max(w.r) IS NULL AS high_clipped FROM b, w WHERE (w.l IS NULL OR b.ne > w.l) AND (w.r IS NULL OR b.ne < w.r) GROUP BY w.best")
def _(v: Views) -> DataFrame:
    return likelihood.profile_interval(grid_of(v))


@query("win06_argmax", SURFACE + "SELECT arg_max(ne, ll) AS ne, round(max(ll), 2) AS ll FROM surface")
def _(v: Views) -> DataFrame:
    return likelihood.best_size(grid_of(v)).select("ne", F.round("ll", 2).alias("ll"))


@query("win08_circular_neighbours", "SELECT gene, pos, coalesce(lag(base) OVER (PARTITION BY gene ORDER BY pos), last_value(base) OVER (PARTITION BY gene ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) || base || coalesce(lead(base) OVER (PARTITION BY gene ORDER BY pos), first_value(base) OVER (PARTITION BY gene ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS context FROM (SELECT p_size AS gene, p_partkey AS pos, substring('ACGTN', CAST(p_partkey % 5 + 1 AS BIGINT), 1) AS base FROM part) WHERE base <> 'N'")
def _(v: Views) -> DataFrame:
    rows = v.part.select(F.col("p_size").alias("gene"), F.col("p_partkey").alias("pos"), F.substring(F.lit("ACGTN"), (F.col("p_partkey") % 5 + 1).cast("int"), F.lit(1)).alias("base"))
    return annotate.circular_neighbours(rows, ["gene"]).select("gene", "pos", F.concat("before", "base", "after").alias("context"))


@query("win09_systematic_sample", "SELECT pos, sample, allele FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY sample, allele) - 1 AS i FROM calls) WHERE i % 3 = 0")
def _(v: Views) -> DataFrame:
    return summaries.every_nth_of(v.calls, ["pos"], ["sample", "allele"], 3).select("pos", "sample", "allele")


@query("win10_win11_ordered", "SELECT chrom, s, e, region_id FROM regions ORDER BY chrom, s, region_id")
def _(v: Views) -> DataFrame:
    return v.regions.orderBy("chrom", "s", "region_id").select("chrom", "s", "e", "region_id")


@query("win12_win13_first_rows", "SELECT read_id, mapq FROM reads WHERE mapq < 5 ORDER BY read_id LIMIT 10")
def _(v: Views) -> DataFrame:
    return summaries.first_rows(v.reads.where("mapq < 5"), ["read_id"], 10).select("read_id", "mapq")


# ---- set operations


@query("set01_union_all", "SELECT pos, CAST(count(*) AS BIGINT) AS n FROM (SELECT pos FROM alts UNION ALL SELECT pos FROM calls UNION ALL SELECT pos FROM alts WHERE length(ref) = 1) GROUP BY pos")
def _(v: Views) -> DataFrame:
    parts = [v.alts.select("pos"), v.calls.select("pos"), v.alts.where("length(ref) = 1").select("pos")]
    return summaries.concatenated(parts).groupBy("pos").agg(F.count("*").alias("n"))


@query("set02_override_union", "SELECT pos, alt, 'second' AS side FROM (SELECT CASE WHEN pos <= 8569 THEN pos + 8000 ELSE pos - 8569 END AS pos, alt FROM alts WHERE length(alt) > 2) UNION ALL SELECT pos, alt, 'first' FROM alts WHERE length(alt) <= 2 AND pos NOT IN (SELECT CASE WHEN pos <= 8569 THEN pos + 8000 ELSE pos - 8569 END FROM alts WHERE length(alt) > 2)")
def _(v: Views) -> DataFrame:
    first = v.alts.where("length(alt) <= 2").select("pos", "alt", F.lit("first").alias("side"))
    second = v.alts.where("length(alt) > 2").select(annotate.unshifted(F.col("pos")).alias("pos"), "alt", F.lit("second").alias("side"))
    return annotate.merged_by_position(first, second, ["pos"])


@query("set03_alts_less_ref", "SELECT pos, array_to_string(list_sort(list_filter(list_distinct(list(allele)), lambda x: x <> 'A')), ',') AS alts FROM pileup GROUP BY pos")
def _(v: Views) -> DataFrame:
    return v.pileup.groupBy("pos").agg(F.array_join(F.array_sort(F.array_except(F.collect_set("allele"), F.array(F.lit("A")))), ",").alias("alts"))


@query("set04_covered_positions", "SELECT DISTINCT pos FROM pileup WHERE qual >= 20")
def _(v: Views) -> DataFrame:
    return v.pileup.where("qual >= 20").select("pos").distinct()


@query("scl23_expected_variance", USABLE + "SELECT row_a, row_b, round(p * (1 - p) / 12.0, 6) AS variance, round(1 / 12.0, 6) AS f FROM usable")
def _(v: Views) -> DataFrame:
    return filters.usable_pairs(v.pairs).select("row_a", "row_b", F.round(drift.expected(F.col("p"), F.lit(12.0)), 6).alias("variance"), F.round(F.lit(1 / 12.0), 6).alias("f"))


@query("scl24_kinship_retention", "SELECT nation, round(pow(1 - 1 / 12.0, nation), 6) AS kept FROM contigs")
def _(v: Views) -> DataFrame:
    return v.contigs.select("nation", F.round(drift.kept_share(F.lit(12.0), F.col("nation")), 6).alias("kept"))


@query("scl19_log_sum_exp", "SELECT vec_id, round(greatest(a, b) + ln(1 + exp(least(a, b) - greatest(a, b))), 6) AS x FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings)")
def _(v: Views) -> DataFrame:
    return v.embeddings.select("vec_id", F.round(st.log_sum_exp(F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")), 6).alias("x"))


@query("jn12_blacklist_sites", f"SELECT pos, CAST(count(*) AS BIGINT) AS n FROM pileup WHERE NOT {sql_ranges('pos', BLACKLIST)} GROUP BY pos")
def _(v: Views) -> DataFrame:
    return v.pileup.where(~filters.in_ranges(F.col("pos"), BLACKLIST)).groupBy("pos").agg(F.count("*").alias("n"))
