"""Aggregates of calls and values over nulls, ties, repeated rows, empty tables and columns of other names."""

import statistics

import pytest
from pyspark.sql import functions as F

from mitoloom.operators import annotate, cohort, filters, summaries

CALLS = "pos int, sample string, allele string, idx int, ad int, dp int, ploidy int, qual double, note string"
ROWS = [
    (1, "a", "A", 0, 5, 10, 2, 30.0, "x"), (1, "a", "G", 1, 5, 10, 2, 30.0, "x"), (1, "b", "GT", 2, 3, 3, 1, 10_000.0, "x"), (1, "b", "GT", 2, 3, 3, 1, 10_000.0, "x"),
    (2, "a", "N", 0, 0, 0, 1, None, "x"), (2, None, "A", 0, 4, 4, 1, 10_000.0, None), (3, "a", None, None, None, None, None, None, None),
]


def pairs(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_aggregates_of_calls(spark):
    calls = spark.createDataFrame(ROWS, CALLS).repartition(4)
    none = calls.limit(0)
    assert pairs(cohort.allele_universe(calls, ["pos"]), "pos", "alleles") == [(1, ["A", "C", "G", "T", "GT"]), (2, ["A", "C", "G", "T"]), (3, ["A", "C", "G", "T"])]
    assert pairs(cohort.major_alleles(calls.where("ad IS NOT NULL"), ["pos", "sample"]), "pos", "sample", "allele", "ad") == [(1, "a", "A", 5), (1, "b", "GT", 3), (2, "a", "N", 0), (2, None, "A", 4)]
    assert pairs(cohort.first_seen(calls.where("pos = 1"), ["sample"], "allele", ["ad", "allele"]), "sample", "allele") == [("a", "A"), ("b", "GT")]
    assert pairs(cohort.indel_shares(calls.where("pos < 3"), ["pos", "sample"], F.length("allele") > 1, 0.5), "pos", "sample", "indel", "n", "share") == [(1, "a", 0, 10, 1.0), (1, "b", 1, 6, 2.0), (2, None, 0, 4, 1.0)]
    assert pairs(cohort.site_quality(calls, ["pos"], 10_000), "pos", "quality") == [(1, 30.0), (2, None), (3, None)]
    assert pairs(cohort.used_alleles(calls, ["pos"]), "pos", "used") == [(1, ["G", "GT"]), (2, []), (3, [])]
    assert pairs(cohort.site_pass(calls, ["pos"], F.col("ad") > 4), "pos", "pass") == [(1, True), (2, False), (3, False)]
    assert pairs(cohort.sample_counts(calls, F.col("ad") > 3), "sample", "total", "good") == [("a", 1, 1), ("b", 2, 0)]
    assert pairs(cohort.varied_sites(calls, ["pos"]), "pos") == [(1,)]
    assert pairs(cohort.tidy_calls(calls), "pos", "allele") == [(1, "G"), (1, "GT"), (1, "GT"), (2, "A"), (2, "N")] and pairs(cohort.mixed_alternatives(calls), "allele") == [("G",)]
    assert cohort.tidy_calls(calls).columns == calls.columns
    results, sites = spark.createDataFrame([(1, "a", True)], "pos int, sample string, good boolean"), spark.createDataFrame([(2, True)], "pos int, pass boolean")
    assert pairs(cohort.with_results(calls.where("ad = 5 OR ad = 0"), results, sites), "allele", "good", "pass") == [("A", True, None), ("G", True, None), ("N", None, True)]
    meta = spark.createDataFrame([("a", 7), ("z", 8)], "sample string, age int")
    assert pairs(cohort.with_metadata(calls.select("sample", "allele").distinct(), meta, ["sample"]), "sample", "age") == [("a", 7)] * 4 + [("b", None), (None, None)]
    for df in (cohort.allele_universe(none, ["pos"]), cohort.major_alleles(none, ["pos"]), cohort.used_alleles(none, ["pos"]), cohort.sample_counts(none, F.lit(True)), cohort.varied_sites(none, ["pos"]), cohort.with_results(none, results, sites)):
        assert df.count() == 0
    alts = spark.createDataFrame([(1, "AC", "G"), (1, "AT", "TT"), (1, "A", "G"), (1, "A", None)], "pos int, ref string, alt string")
    assert pairs(cohort.site_alleles(alts, ["pos"]), "longest", "alts") == [("AT", ["G", "TT"])]
    assert pairs(calls.select(filters.call_state(["ad", "note"]).alias("s")).groupBy("s").count(), "s", "count") == [("missing", 2), ("ready", 5)]


def test_summaries_of_values(spark):
    values = [("a", 1, 4.0), ("a", 2, 1.0), ("a", 3, 4.0), ("a", 4, None), ("b", 5, 2.5), (None, 6, 1.0), (None, 7, 1.0), ("c", 8, None)]
    df = spark.createDataFrame(values, "k string, id int, x double").repartition(3)
    half = 1.96 * statistics.stdev([4, 1, 4]) / 3**0.5
    got = {r.k: r for r in summaries.mean_interval(df, ["k"], "x").collect()}
    assert (got["a"].n, got["a"].mean, got["a"].half) == (3, 3.0, pytest.approx(half)) and (got["b"].low, got["b"].high) == (2.5, 2.5) and tuple(got["c"])[1:] == (0, 0.0, 0.0, 0.0, 0.0)
    whole = {r.k: r for r in summaries.summary(df, ["k"], "x", "id").collect()}
    assert (whole["a"].median, whole["a"].at_min, whole["a"].at_max) == (4.0, 2, 1) and (whole[None].at_min, whole[None].at_max, whole[None].n) == (6, 6, 2) and "c" not in whole
    assert {r.k: r.q0 for r in summaries.quantiles(df, ["k"], "x", [0.5, 1.0]).collect()} == {"a": 4.0, "b": 2.5, None: 1.0, "c": None}
    assert pairs(summaries.duplicates(df, ["k"]), "k", "n") == [("a", 4), (None, 2)] and pairs(summaries.duplicates(df, ["id"]), "id") == []
    assert pairs(summaries.every_nth_of(df, ["k"], ["id"], 2), "k", "id") == [("a", 1), ("a", 3), ("b", 5), ("c", 8), (None, 6)]
    assert [r.id for r in summaries.first_rows(df, [F.col("x").desc_nulls_last(), "id"], 3).collect()] == [1, 3, 5]
    other = spark.createDataFrame([(9, "y")], "id int, more string")
    assert summaries.concatenated([df, other, df]).count() == 17 and summaries.concatenated([df.limit(0), other]).where("k IS NULL AND more = 'y'").count() == 1
    assert summaries.summary(df.limit(0), ["k"], "x", "id").count() == 0 and summaries.mean_interval(df.limit(0), [], "x").first().n == 0
    residues = spark.createDataFrame([("ND1", 7, "p"), ("X", 1, "q")], "locus string, residue int, label string")
    codons = spark.createDataFrame([("ND1", 7, 30), ("ND1", 7, 30), ("ND1", 7, 31), (None, 7, 32)], "locus string, residue int, pos int")
    assert pairs(annotate.residue_positions(residues, codons, ["locus", "residue"]), "label", "pos") == [("p", 30), ("p", 31)]


def test_groups_and_orientation_of_reads(spark):
    from mitoloom.operators import reads

    rows = [("lane:1:2", {"RG": "g", "NM": "3"}), ("lane:1:2", {"NM": "3"}), ("plain", {}), ("a:b", None), (None, None)]
    df = spark.createDataFrame(rows, "qname string, tags map<string,string>").coalesce(1)
    assert [tuple(r) for r in df.select(reads.read_group(F.col("tags"), F.col("qname")), reads.tag(F.col("tags"), "NM")).collect()] == [("g", "3"), ("lane", "3"), ("", ""), ("a", ""), ("", "")]
    pairs_ = [(32, "c", 5, "c", 9), (16, "c", 9, "c", 5), (0, "c", 5, "c", 9), (32, "c", 9, "c", 5), (32, "c", 5, "d", 9), (36, "c", 5, "c", 9), (40, "c", 5, "c", 9), (32, "*", 5, "*", 9), (None, "c", 5, "c", 9)]
    got = spark.createDataFrame(pairs_, "flag int, rname string, pos int, rnext string, pnext int").coalesce(1)
    assert [r[0] for r in got.select(reads.proper_orientation(*(F.col(c) for c in got.columns))).collect()] == [True, True, False, False, False, False, False, False, False]


def test_commented_json_and_metadata(spark, tmp_path):
    from mitoloom.sources import text

    (tmp_path / "a.json").write_text('# made by\n  # x\n{\n  "Ne": 5.5,\n  "note": "a # b"\n}\n')
    row = text.commented_json(spark, str(tmp_path / "a.json"), "Ne double, note string, more int").first()
    assert tuple(row) == (5.5, "a # b", None)
    (tmp_path / "b.json").write_text("{no")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        text.commented_json(spark, str(tmp_path / "b.json"), "Ne double").collect()
    (tmp_path / "t.tsv").write_text("#model=continuous\n#n = 3\n\na\tb\n1\t2\n")
    meta, body = text.with_metadata(spark, str(tmp_path / "t.tsv"))
    assert {(r.key, r.value.strip()) for r in meta.collect()} == {("model", "continuous"), ("n", "3")} and [r.value for r in body.orderBy("line").collect()] == ["a\tb", "1\t2"]
    (tmp_path / "d.tsv").write_text("# note\nk\tv\n1\tx\n1\tx\n2\ty\n")
    table = text.dimension(spark, str(tmp_path / "d.tsv"), {"key": "k", "value": 1}, ["key"], header=True)
    assert pairs(table, "key", "value") == [("1", "x"), ("2", "y")]


def test_tables_of_results(spark):
    from mitoloom.sources import sinks

    report = spark.createDataFrame([("chrM", 12, 16569, 0.443, 1.25, 800.5, None, 900.0, 16000, 1)], "contig string, fragments long, length long, gc double, ratio double, cn double, cn_low double, cn_high double, effective_length long, regions long")
    row = sinks.copynum_rows(report).first()
    assert list(row.asDict()) == sinks.COPYNUM_COLUMNS and tuple(row) == ("chrM", "12", "16569", "0.443", "1.25", "800.5", "NA", "900", "16000", "1")
    scored = spark.createDataFrame([("s", "chrM", 5, "A", "G", 2, 0.5, 9.0, 0.01, 0.99, m, i) for m, i in ((True, 1), (True, 0), (False, 1))], "sample string, chrom string, pos int, ref string, alt string, ploidy int, alpha double, beta double, error double, pp double, mutation boolean, idx int")
    assert sinks.qc_rows(scored).count() == 1 and sinks.qc_rows(scored).columns == sinks.QC_COLUMNS


def test_children_drawn_for_given_mothers(spark):
    from mitoloom.operators import drift, simulate

    pairs_ = spark.range(6000).select("id", (0.1 + 0.8 * (F.col("id") % 97) / 97).alias("p"), F.lit(1000).alias("m_dp"), F.lit(1000).alias("c_dp"))
    for generations in (1, 3):
        drawn = simulate.offspring(pairs_, 10, ["id"], generations=generations)
        b = drift.kimura(drift.terms(drawn.withColumn("m_dp", F.lit(10**9)))).first().b
        assert abs((1 - b) - simulate.expected_drift(10, generations)) < 0.02
    again = simulate.offspring(pairs_.repartition(7), 10, ["id"])
    assert sorted((r.id, r.c_alt) for r in again.collect()) == sorted((r.id, r.c_alt) for r in simulate.offspring(pairs_, 10, ["id"]).collect())
    edge = spark.createDataFrame([(1, 0.0, 50), (2, 1.0, 50), (3, None, 50), (4, 0.5, 0)], "id int, p double, c_dp int")
    assert [r.c_alt for r in simulate.offspring(edge, 10, ["id"]).orderBy("id").collect()] == [0, 50, None, 0]
