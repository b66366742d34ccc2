import pytest
from pyspark.sql import functions as F

from mitoloom.operators import records
from mitoloom.plans import commands
from mitoloom.sources.headers import VcfHeader

VCF = "##fileformat=VCFv4.2\n##contig=<ID=chrM,length=16569>\n##FORMAT=<ID=GT,Number=1,Type=String,Description=\"g\">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tmom\tkid\n" + "chrM\t100\t.\tA\tG\t50\tPASS\t.\tGT:DP:AD:AF:AQ\t0/1:1000:700,300:0.7,0.3:60,60\t1:900:900:1.0:60\nchrM\t200\t.\tC\tT,CA\t9\t.\t.\tGT:DP:AD:AF:AQ\t.:0\t0/2:600:500,100:0.83,0.17:60,50\n"


def test_commands_over_a_vcf(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(VCF)
    (tmp_path / "a.fam").write_text("# c\nF1 kid dad mom 1 -9\nF1 mom 0 0 2 -9\n")
    info = {r.pos.pos: r for r in commands.subsam(spark, str(tmp_path / "a.vcf"), ["kid"]).collect()}
    assert info[100].hom_n == 1 and info[200].het_n == 1 and info[200].dp_mean == 600
    with pytest.raises(ValueError, match="nobody"):
        commands.subsam(spark, str(tmp_path / "a.vcf"), ["nobody"])
    rows = commands.transmission_table(spark, str(tmp_path / "a.vcf"), str(tmp_path / "a.fam"), str(tmp_path / "out")).collect()
    assert [(r.POS, r.MOTHER_AD_ALT, r.CHILD_AD_ALT, r.MOTHER_VAF, r.GRANDMOTHER_ID, r.HAS_G, r.QC) for r in rows] == [(100, 300, 900, "0.3", "NA", 0, "PASS")]
    tidy = sorted((r.pos, r.alt, r["sample"], r.type) for r in commands.tidy_table(spark, str(tmp_path / "a.vcf")).collect())
    assert tidy == [(100, "G", "kid", "SNV"), (100, "G", "mom", "SNV"), (200, "CA", "kid", "INS")]


def test_headers():
    head = VcfHeader(VCF.split("\n")[:4])
    assert head.samples == ["mom", "kid"] and head.contigs == [("chrM", 16569)] and head.fields("FORMAT") == {"GT": ("1", "String")}
    assert head.with_samples(["kid"]).samples == ["kid"] and head.with_added("x").samples[-1] == "x" and len(head.with_line("##a=b").lines) == 5
    with pytest.raises(ValueError):
        head.with_samples(["kid", "kid"])


def test_record_changes(spark):
    df = spark.createDataFrame([(1, ["G", "T", "C"], "a", [0, 3], "PASS", {"DP": "5,."}), (1, ["G", "T", "C"], "b", [None, 1], "X", {"FLAG": ""})], "site int, alts array<string>, sample string, gt array<int>, filter string, info map<string,string>")
    got = {r["sample"]: (r.alts, r.gt) for r in records.used_alternatives(df).collect()}
    assert got == {"a": (["G", "C"], [0, 2]), "b": (["G", "C"], [None, 1])}
    row = df.select(records.with_filter(F.col("filter"), "LOW").alias("f"), records.genotype_text(F.col("gt")).alias("g"), records.typed(F.col("info"), "DP", ".", "Integer").alias("d"), records.typed(F.col("info"), "FLAG", "0", "Flag").alias("x"), records.with_field(F.col("info"), "N", F.lit(1)).alias("m")).collect()
    assert [(r.f, r.g, r.d, r.x) for r in row] == [("LOW", "0/3", [5, None], False), ("X;LOW", "./1", None, True)] and row[0].m == {"DP": "5,.", "N": "1"}
