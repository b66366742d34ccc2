import struct

import pytest
from pyspark.sql import functions as F

from mitoloom.operators import annotate, cigar, drift, intervals, pedigree, pileup, simulate
from mitoloom.plans import bottleneck, caller
from mitoloom.sources import bam, sinks, text

READ = "sample string, qname string, flag int, rname string, pos int, mapq int, rnext string, cigar string, seq string, qual string"


def test_cigar_expansion_by_hand(spark):
    reads = spark.createDataFrame([("r", 10, "2S3M2I2M1D1M3H", "TTACGAAGTC")], "qname string, pos int, cigar string, seq string")
    rows = [(r.op, r.ref_pos, r.query_pos, r.base) for r in cigar.aligned_pairs(reads).collect()]
    assert rows == [("S", 10, 0, "TT"), ("M", 10, 2, "A"), ("M", 11, 3, "C"), ("M", 12, 4, "G"), ("I", 13, 5, "AA"), ("M", 13, 7, "G"), ("M", 14, 8, "T"), ("D", 15, 9, ""), ("M", 16, 9, "C")]
    row = cigar.summary(reads).first()
    assert (row.ref_end, row.query_start, row.query_end, row.longest_insertion, row.longest_deletion) == (17, 2, 10, 2, 1)


def test_degenerate_cigars_do_not_fail(spark):
    reads = spark.createDataFrame([("10H", ""), ("*", "ACG"), ("0I3M", "ACG"), ("5H0M5H", "")], "cigar string, seq string").withColumn("pos", F.lit(0))
    assert cigar.aligned_pairs(reads).count() == 3


def test_interval_merge_joins_neighbours_and_nested_ones(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 6, 7), ("a", 9, 20), ("a", 10, 12), ("b", 1, 1)], "chrom string, s long, e long")
    assert sorted((r.chrom, r.s, r.e) for r in intervals.merged(rows, ["chrom"]).collect()) == [("a", 1, 7), ("a", 9, 20), ("b", 1, 1)]


def test_binned_join_equals_nested_loops(spark):
    points = spark.range(0, 300, 7).select(F.col("id").alias("pos"))
    regions = spark.createDataFrame([(0, 3, 10), (1, 10, 90), (2, 63, 64), (3, 250, 400)], "rid long, s long, e long")
    got = sorted((r.pos, r.rid) for r in intervals.binned_join(points, regions, "pos", [], 16).select("pos", "rid").collect())
    assert got == sorted((p, i) for p in range(0, 300, 7) for i, s, e in [(0, 3, 10), (1, 10, 90), (2, 63, 64), (3, 250, 400)] if s <= p <= e)


def test_first_grandmother_wins(spark):
    rows = spark.createDataFrame([(0, "f", "c", "x", "m"), (1, "f", "m", "x", "0"), (2, "f", "m", "x", "g1"), (3, "f", "m", "x", "g2")], "line long, fam string, child string, father string, mother string")
    assert pedigree.with_grandmother(rows).where("child = 'c'").first().grandmother == "g1"


def test_average_ranks(spark):
    rows = spark.createDataFrame([(1,), (2,), (2,), (5,)], "v int")
    assert sorted(r.avg_rank for r in drift.ranked(rows, "v").collect()) == [1.0, 2.5, 2.5, 4.0]


def test_override_union(spark):
    a, b = spark.createDataFrame([(1, "a"), (2, "a")], "pos int, s string"), spark.createDataFrame([(2, "b"), (3, "b")], "pos int, s string")
    assert sorted((r.pos, r.s) for r in annotate.merged_by_position(a, b, ["pos"]).collect()) == [(1, "a"), (2, "b"), (3, "b")]


def test_simulated_drift_has_the_expected_moment(spark):
    from mitoloom.operators import filters

    row = drift.kimura(drift.terms(filters.usable_pairs(simulate.cohort(spark, 100, 20, 10)))).first()
    assert abs((1 - row.b) - simulate.expected_drift(10, 1)) < 0.02


def test_size_of_a_simulated_cohort_is_recovered(spark):
    from mitoloom.operators import filters

    pairs = filters.usable_pairs(simulate.cohort(spark, 60, 20, 10, model="continuous")).withColumn("g", F.lit(None).cast("double"))
    fit = bottleneck.estimate(pairs, 2, 60)
    assert fit["ci_low"] <= 10.5 and fit["ci_high"] >= 9.5 and fit["ci_low"] < fit["ne"] < fit["ci_high"] and not fit["high_clipped"]


def test_families_are_fitted_or_skipped(spark):
    rows = [("F1", "M1", 0.1 + 0.05 * i, 20 + 8 * i, 200) for i in range(15)] + [("", "M2", 0.5, 50, 100)]
    fits = {r.fam: r for r in bottleneck.families(spark.createDataFrame(rows, "fam string, mother string, p double, c_alt int, c_dp int")).collect()}
    assert fits["F1"].ne is not None and not fits["F1"].skipped and fits["ALL"].skipped


def test_caller_finds_a_heteroplasmy(spark):
    reads = [(f"s1", f"q{i}", 0, "chrM", 2, 60, "*", "6M", "GTACGA" if i % 3 else "GTTCGA", "IIIIII") for i in range(60)]
    df = spark.createDataFrame(reads, "sample string, qname string, flag int, rname string, pos int, mapq int, rnext string, cigar string, seq string, qual string")
    reference = spark.createDataFrame([("chrM", i + 1, b) for i, b in enumerate("ACGTACGATT")], "contig string, pos int, ref string")
    calls, sites = caller.call_variants(df, reference)
    got = {(r.pos, r.allele): r.ad for r in calls.collect()}
    assert got[(5, "A")] == 40 and got[(5, "T")] == 20
    site = sites.collect()
    assert [(s.pos, s.alts, s.het_n, s.pt) for s in site] == [(5, ["T"], 1, "Het")]


def test_pileup_from_reads_counts_strands(spark):
    rows = spark.createDataFrame([(1, "A", "+"), (1, "A", "-"), (1, "G", "+")], "pos int, allele string, strand string")
    got = {r.allele: (r.fwd, r.rev, r.is_major) for r in pileup.with_major(pileup.strand_counts(rows, ["pos"]), ["pos"]).collect()}
    assert got == {"A": (1, 1, True), "G": (1, 0, False)}


def test_bases_below_the_quality_do_not_count(spark):
    reads = spark.createDataFrame([("s", "q", 0, "c", 0, 60, "*", "4M", "ACGT", "IIII"), ("s", "r", 16, "c", 0, 60, "*", "4M", "ACGA", "III!")], READ)
    got = pileup.strand_counts(pileup.from_reads(reads), ["pos"]).collect()
    assert sorted((r.pos, r.allele, r.fwd, r.rev) for r in got) == [(1, "A", 1, 1), (2, "C", 1, 1), (3, "G", 1, 1), (4, "T", 1, 0)]


def test_an_insertion_and_two_deletions_at_one_site(spark):
    reference = spark.createDataFrame([("c", i + 1, b) for i, b in enumerate("ACGTACGTAC")], "contig string, pos int, ref string")
    shapes = {"plain": ("10M", "ACGTACGTAC", 30), "insertion": ("4M2I6M", "ACGTTTACGTAC", 20), "one": ("4M1D5M", "ACGTCGTAC", 20), "three": ("4M3D3M", "ACGTTAC", 30)}
    reads = [("s", f"{name}{i}", 16 * (i % 2), "c", 0, 60, "*", cigar, seq, "I" * len(seq)) for name, (cigar, seq, n) in shapes.items() for i in range(n)]
    reads += [("t", f"q{i}", 0, "c", 0, 60, "*", "10M", "ACGTACGTAC", "I" * 10) for i in range(20)]
    calls, sites = caller.call_variants(spark.createDataFrame(reads, READ), reference)
    got = {r["sample"]: r for r in calls.where("pos = 4").groupBy("sample").agg(F.sort_array(F.collect_list(F.struct("allele", "alt", "idx", "ad", "dp", "type"))).alias("a"), F.first("site_ref").alias("ref")).collect()}
    # the indels before position 5 stand at position 4 and displace its bases; depth there is that of the indels
    assert got["s"].ref == "TACG" and [tuple(a) for a in got["s"].a] == [("+TT", "TTTACG", 3, 20, 70, "INS"), ("-A", "TCG", 2, 20, 70, "DEL"), ("-ACG", "T", 1, 30, 70, "DEL")]
    assert [tuple(a) for a in got["t"].a] == [("T", "TACG", 0, 20, 20, "REF")]
    site = sites.where("pos = 4").first()
    assert (site.ref, site.alts, site.an, site.het_n, site.ref_n, site.pt) == ("TACG", ["T", "TCG", "TTTACG"], 2, 1, 1, "Het")
    assert [round(x, 6) for x in site.vaf_mean] == [round(30 / 70 / 2, 6), round(20 / 70 / 2, 6), round(20 / 70 / 2, 6)]
    filled = {(r.pos, r["sample"]): (r.gt, r.dp) for r in caller.genotypes(calls, sites, spark.createDataFrame([("s",), ("t",), ("u",)], "sample string")).collect()}
    assert filled[4, "s"] == ("1/2/3", 70) and filled[4, "t"] == ("0", 20) and filled[4, "u"] == (".", 0)


def test_rare_indels_do_not_displace_and_the_first_position_keeps_its_bases(spark):
    rows = [("s", "c", p, a, i, n) for p, a, i, n in ((1, "A", 0, 90), (1, "+T", 1, 10), (5, "G", 0, 999), (5, "-G", 1, 1), (4, "C", 0, 50), (7, "T", 0, 1), (7, "+A", 1, 999), (6, "C", 0, 80))]
    counted = spark.createDataFrame(rows, "sample string, contig string, pos int, allele string, indel int, n long")
    got = sorted((r.pos, r.allele, r.n) for r in pileup.displaced(counted, 0.01, ["sample", "contig"]).collect())
    assert got == [(1, "A", 90), (4, "C", 50), (5, "G", 999), (6, "+A", 999)]
    assert pileup.displaced(counted.limit(0), 0.01, ["sample", "contig"]).count() == 0


def test_text_sources(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">c1 note\nACGT\nNN\n>c2\nGG\n")
    got = {r.contig: (r.length, r.sequence) for r in text.fasta(spark, str(tmp_path / "x.fa")).collect()}
    assert got == {"c1": (6, "ACGTNN"), "c2": (2, "GG")}
    (tmp_path / "x.sam").write_text("@SQ\tSN:c1\tLN:6\n@RG\tID:a\tSM:me\nr1\t0\tc1\t3\t60\t4M\t=\t1\t0\tACGT\tIIII\tNM:i:2\n")
    reads, heads = text.sam(spark, str(tmp_path / "x.sam"))
    row = reads.first()
    assert (row["sample"], row.pos, row.rnext, row.tags["NM"]) == ("me", 2, "c1", "2") and text.contigs_of(heads).first().length == 6
    (tmp_path / "x.vcf").write_text("##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\nc1\t5\t.\tA\tG,T\t9.5\tPASS\t.\tGT:AD\t0/1:3,4\t.\n")
    records, _ = text.vcf(spark, str(tmp_path / "x.vcf"))
    got = {r["sample"]: (r.alts, r.fields) for r in records.collect()}
    assert got == {"a": (["G", "T"], {"GT": "0/1", "AD": "3,4"}), "b": (["G", "T"], {"GT": "."})}
    (tmp_path / "x.bed").write_text("# c\nc1 0 10\n")
    assert tuple(text.bed(spark, str(tmp_path / "x.bed")).first()) == ("c1", 1, 10)
    tokens = text.region_list(spark, "c1, c1:5, c1:0-7,c1:9-2")
    lengths = spark.createDataFrame([("c1", 100)], "contig string, length long")
    assert sorted((r.s or -1, r.e or -1) for r in text.regions(tokens, lengths).collect()) == [(-1, -1), (1, 7), (1, 100), (5, 100)]
    with pytest.raises(Exception, match="bad region"):
        text.regions(tokens, strict=True).collect()


def test_bam_round_trip(spark, tmp_path):
    head = b"@HD\tVN:1.6\n@RG\tID:1\tSM:smp\n"
    body = b"BAM\x01" + struct.pack("<i", len(head)) + head + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chrM\0" + struct.pack("<i", 16569)
    rec = struct.pack("<iiBBHHHiiii", 0, 99, 3, 60, 0, 1, 16, 4, -1, -1, 0) + b"q1\0" + struct.pack("<I", 4 << 4) + bytes([0x12, 0x48]) + bytes([30, 31, 32, 33])
    (tmp_path / "a.bam").write_bytes(bam.compress(body + struct.pack("<i", len(rec)) + rec))
    spark.dataSource.register(bam.BamDataSource)
    row = spark.read.format("bam").load(str(tmp_path)).first()
    assert (row["sample"], row.qname, row.rname, row.pos, row.cigar, row.seq, row.qual) == ("smp", "q1", "chrM", 99, "4M", "ACGT", "?@AB")


def bam_bytes(reads, sample=True):
    """A BAM file of reads (contig number, 0-based pos, name), each 4M and with tags, over two contigs."""
    head = b"@HD\tVN:1.6\tSO:coordinate\n" + (b"@RG\tID:1\tSM:smp\n" if sample else b"")
    body = b"BAM\x01" + struct.pack("<i", len(head)) + head + struct.pack("<i", 2)
    for name, length in ((b"c1\0", 100_000), (b"c2\0", 60_000)):
        body += struct.pack("<i", len(name)) + name + struct.pack("<i", length)
    for ref, pos, name in reads:
        rec = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 60, 0, 1, 16, 4, -1, -1, 0) + name.encode() + b"\0" + struct.pack("<I", 4 << 4) + bytes([0x12, 0x48, 30, 31, 32, 33]) + b"NMC\x02RGZone\0ZBBc\x02\0\0\0\x01\xff"
        body += struct.pack("<i", len(rec)) + rec
    return bam.compress(body, 5_000)


def test_bam_regions_and_splits(spark, tmp_path):
    import io
    import random

    rng = random.Random(1)
    reads = sorted((rng.randrange(2), rng.randrange(0, 59_000), f"q{i}") for i in range(900)) + [(-1, -1, "lost")]
    plain, indexed = tmp_path / "plain", tmp_path / "indexed"
    for folder in (plain, indexed):
        folder.mkdir()
        (folder / "a.bam").write_bytes(bam_bytes(reads))
    (indexed / "a.bam.bai").write_bytes(bam.index_of(io.BytesIO(bam_bytes(reads))))
    spark.dataSource.register(bam.BamDataSource)
    names = lambda df: sorted(r.qname for r in df.collect())
    for folder in (plain, indexed):
        read = spark.read.format("bam")
        assert names(read.option("split", "7000").load(str(folder))) == sorted(n for *_, n in reads)
        for contig, start, end in ((0, 1, 59_000), (0, 20_000, 20_400), (1, 16_385, 40_000), (1, 58_000, 60_000)):
            got = names(read.option("region", f"c{contig + 1}:{start}-{end}").load(str(folder)))
            assert got == sorted(n for r, p, n in reads if r == contig and p < end and p + 4 > start - 1)
    assert spark.read.format("bam").option("split", "7000").load(str(indexed)).rdd.getNumPartitions() > 10
    row = spark.read.format("bam").load(str(plain)).first()
    assert row.tags == {"NM": "2", "RG": "one", "ZB": "1,-1"}
    (tmp_path / "b.bam").write_bytes(bam_bytes(reads, sample=False))
    with pytest.raises(Exception, match="no @RG"):
        spark.read.format("bam").load(str(tmp_path / "b.bam")).collect()


def test_lines_of_split_files_keep_their_order(spark, tmp_path):
    contigs = {f"c{i}": "".join("ACGT"[(i * k) % 4] for k in range(1, 700 + i)) for i in range(1, 6)}
    (tmp_path / "x.fa").write_text("ignored\n" + "".join(f">{n} note\n" + "\n".join(s[a : a + 60] for a in range(0, len(s), 60)) + "\n" for n, s in contigs.items()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
        assert text.lines(spark, str(tmp_path / "x.fa")).rdd.getNumPartitions() > 3
        assert {r.contig: r.sequence for r in text.fasta(spark, str(tmp_path / "x.fa")).collect()} == contigs
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b"), (1, "a")], "pos int, x string")
    sinks.write_table(rows, str(tmp_path / "t"), ["made=here"], ["pos"])
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["#made=here", "pos\tx", "1\ta", "2\tb"]
    sinks.merge_parts(spark, str(tmp_path / "t"), str(tmp_path / "one.tsv"))
    assert (tmp_path / "one.tsv").read_text() == "#made=here\npos\tx\n1\ta\n2\tb\n"
    sinks.write_json(spark, {"a": float("inf"), "b": [1.5]}, str(tmp_path / "j"))
    assert (tmp_path / "j").read_text() == '{\n  "a": "inf",\n  "b": [\n    1.5\n  ]\n}'
