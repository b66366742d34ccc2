"""Commands from files to files, and changes of records' alleles by declared Number, against plain Python."""

import json
import random
from itertools import combinations_with_replacement

import pytest
from pyspark.sql import functions as F

from mitoloom.operators import records
from mitoloom.plans import files
from mitoloom.sources import variant_sinks, variants
from mitoloom.sources.headers import VcfHeader
from tests.test_indexed_files import expected, fields, frame

HEAD = [
    "##fileformat=VCFv4.2", '##FILTER=<ID=PASS,Description="other">', '##INFO=<ID=AC,Number=A,Type=Integer,Description="x">', '##INFO=<ID=AFS,Number=R,Type=Float,Description="x">', '##INFO=<ID=N,Number=1,Type=Integer,Description="x">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="x">', '##FORMAT=<ID=RD,Number=R,Type=Integer,Description="x">', '##FORMAT=<ID=PL,Number=G,Type=Integer,Description="x">', '##FORMAT=<ID=GL,Number=G,Type=Float,Description="x">', "##contig=<ID=chrM,length=16569>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2",
]


def genotypes(alleles, ploidy):
    """In file order: the last allele grows slowest."""
    return sorted(combinations_with_replacement(range(alleles), ploidy), key=lambda g: g[::-1])


@pytest.mark.parametrize("ploidy", [1, 2, 3, 4])
def test_places_of_genotypes(ploidy):
    for alleles in (1, 2, 3, 5):
        order = genotypes(alleles, ploidy)
        assert [records.genotype_place(g) for g in order] == list(range(len(order))) and records.genotype_count(alleles, ploidy) == len(order)


@pytest.mark.parametrize("ploidy", [1, 2, 3, 4])
def test_fields_follow_their_alleles(spark, ploidy):
    rng = random.Random(ploidy)
    rows, wanted = [], []
    for pos in range(1, 40):
        n = rng.randint(1, 4)
        new = []
        for i in range(n):
            new.append(rng.choice([-1, 0, max([0, *new]) + 1, *[k for k in new if k > 0]]))
        kept = [0, *new]
        top = max(kept)
        alts = [f"{'ACGT'[i]}{'T' * pos}" for i in range(n)]
        order = genotypes(n + 1, ploidy)
        ac, share, depth = [rng.randrange(9) for _ in range(n)], [rng.random() for _ in range(n + 1)], [rng.randrange(99) for _ in range(n + 1)]
        pl, gl = [rng.randrange(99) for _ in order], [-rng.random() for _ in order]
        gt = [rng.randrange(n + 1) for _ in range(ploidy)]
        join = lambda v: ",".join(map(str, v))
        rows.append(("chrM", pos, ".", "A", ",".join(alts), ".", ".", f"AC={join(ac)};AFS={join(share)};N=3;X", "GT:RD:PL:GL", [f"{'|'.join(map(str, gt))}:{join(depth)}:{join(pl)}:{join(gl)}", "."], new))
        summed = lambda v, first: [sum(v[i - first] for i in range(first, n + 1) if kept[i] == k) if any(kept[i] == k for i in range(first, n + 1)) else "." for k in range(first, top + 1)]
        moved = lambda v, best: [best([x for x, g in zip(v, order, strict=True) if all(kept[i] >= 0 for i in g) and tuple(sorted(kept[i] for i in g)) == to]) for to in genotypes(top + 1, ploidy)]
        wanted.append((pos, ",".join(next(alts[i - 1] for i in range(1, n + 1) if kept[i] == k) for k in range(1, top + 1)) or ".", summed(ac, 1), summed(share, 0), "|".join("." if kept[g] < 0 else str(kept[g]) for g in gt), summed(depth, 0), moved(pl, min), moved(gl, max)))
    df = spark.createDataFrame([(*r, "kept") for r in rows], "chrom string, pos int, id string, ref string, alt string, qual string, filter string, info string, format string, samples array<string>, new array<int>, extra string").repartition(3)
    got = {r.pos: r for r in records.remapped(df, VcfHeader(HEAD)).collect()}
    assert got[1].extra == "kept" and "new" not in got[1]
    number = lambda text: [x if x == "." else float(x) for x in text.split(",")] if text else []
    for pos, alt, ac, share, gt, depth, pl, gl in wanted:
        info = dict(x.partition("=")[::2] for x in got[pos].info.split(";"))
        s = got[pos].samples[0].split(":")
        assert got[pos].alt == alt and number(info["AC"]) == (ac or ["."]) and info["N"] == "3" and info["X"] == "" and number(info["AFS"]) == pytest.approx(share)
        assert s[0] == gt and number(s[1]) == depth and number(s[2]) == pl and number(s[3]) == gl and got[pos].samples[1] == "."


def test_odd_fields_and_numbers(spark):
    schema = "alt string, info string, format string, samples array<string>, new array<int>"
    rows = [("G,T", "AC=1;AFS=.,.,.;DB", "GT:PL", ["0/2:.", "./.:1,2,3,4"], [-1, 1]), ("G", None, None, None, [-1]), (".", "AC=.", "GT", [".", "0"], None), ("G,T", "AC=1,2", "GT:RD", ["1/2", "2:5,6,7:extra"], [1, 1])]
    got = [tuple(r) for r in records.remapped(spark.createDataFrame(rows, schema).coalesce(1), VcfHeader(HEAD)).collect()]
    assert got[0] == ("T", "AC=1;AFS=.,.;DB", "GT:PL", ["0/1:.", "./.:1,2,3,4"]) and got[1] == (".", None, None, None) and got[2] == (".", "AC=.", "GT", [".", "0"])
    assert got[3] == ("G", "AC=3", "GT:RD", ["1/1", "1:5,13"])
    for new in ([2, 1, 1], [3, 1], [-2, 1]):
        with pytest.raises(Exception, match="not a numbering"):
            records.remapped(spark.createDataFrame([("G,T", ".", "GT", ["0"], new)], schema), VcfHeader(HEAD)).collect()
    used = records.unused_dropped(spark.createDataFrame([("A,C,G", "AC=1,2,3", "GT:RD", ["0/3:1,2,3,4", "3|.", "."]), ("A", "AC=1", "GT", ["0", "0"]), ("A", "AC=1", None, None)], "alt string, info string, format string, samples array<string>").coalesce(1), VcfHeader(HEAD))
    assert [tuple(r) for r in used.collect()] == [("G", "AC=3", "GT:RD", ["0/1:1,4", "1|.", "."]), (".", "AC=.", "GT", ["0", "0"]), ("A", "AC=1", None, None)]
    assert records.remapped(spark.createDataFrame([], schema), VcfHeader(HEAD)).count() == 0


def test_setting_fields_of_records(spark):
    df = spark.createDataFrame([(".", "PASS", "GT:DP", ["0/1:5", "."]), ("A=1;B", "low;bad", None, ["", ""]), (None, None, "GT", ["0", "1"])], "info string, filter string, format string, samples array<string>").coalesce(1)
    info = df.select(records.with_info(F.col("info"), "A", F.lit(7)).alias("a"), records.with_info(F.col("info"), "F", None).alias("f"), records.with_info(F.col("info"), "A", F.lit(None)).alias("n"), records.without_filter(F.col("filter"), "low").alias("w"))
    assert [tuple(r) for r in info.collect()] == [("A=7", "F", ".", "PASS"), ("A=7;B", "A=1;B;F", "B", "bad"), ("A=7", "F", ".", None)]
    values = F.array(F.lit("x"), F.lit(None))
    assert [(r.format, r.samples) for r in records.with_format(df, "PP", values).collect()] == [("GT:DP:PP", ["0/1:5:x", ".:.:."]), ("PP", ["x", "."]), ("GT:PP", ["0:x", "1:."])]
    assert [(r.format, r.samples) for r in records.with_format(df, "DP", values).collect()] == [("GT:DP", ["0/1:x", ".:."]), ("DP", ["x", "."]), ("GT:DP", ["0:x", "1:."])]


def qc_rows():
    rng = random.Random(7)
    rows = []
    for pos in [100, 305, 310, *range(2000, 2060)]:
        samples = []
        for s in range(14):
            dp = rng.randint(900, 1100)
            if s == 0:
                samples.append(".:0:0:.:.:.:.:.:.:keep me")
            elif s < 11 or pos % 5:
                error = rng.randint(0, 3)
                samples.append(f"0:50:{dp}:{dp - error}:{(dp - error) / dp:.6f}:60:{dp // 2},{dp - dp // 2}:0.5:1.0:x{s}")
            else:
                k = int(dp * rng.choice([0.2, 0.4, 0.6]))
                samples.append(f"0|1:50:{dp}:{dp - k},{k}:{1 - k / dp:.6f},{k / dp:.6f}:60,60:{dp // 2},{dp // 2};{k // 2},{k - k // 2}:0.5,0.7:1.0,1.1:y{s}")
        rows.append(("chrM", pos, "rs7", "AC" if pos == 310 else "A", "G,T,C" if pos == 2001 else "G", "33.5", ".", "Z=1", "GT:GQ:DP:AD:AF:AQ:SB:FS:SOR:TXT", samples))
    return rows


def test_quality_control_from_file_to_file(spark, tmp_path):
    rows = qc_rows()
    names = [f"s{i}" for i in range(14)]
    head = [*HEAD[:-2], '##FORMAT=<ID=TXT,Number=1,Type=String,Description="x">', HEAD[-2], "\t".join([*HEAD[-1].split("\t")[:9], *names])]
    variant_sinks.write_variants(frame(spark, rows), VcfHeader(head), str(tmp_path / "in"))
    files.qc_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "calls"), command="run", least_depth=100)
    out = variants.header(str(tmp_path / "out"))
    assert set(head) < set(out.lines) and len(out.lines) == len(head) + 5 and "##variant_qc_command=run" in out.lines  # PASS was declared
    got = {r.pos: r for r in variants.records(spark, str(tmp_path / "out")).collect()}
    assert sorted(got) == [r[1] for r in rows]
    for row in rows:
        r, pos = got[row[1]], row[1]
        assert (r.id, r.ref, r.alt, r.info, r.format) == ("rs7", row[3], row[4], "Z=1", row[8] + ":PP:GOOD_CALL")
        for before, after in zip(row[9], r.samples, strict=True):
            b, a = before.split(":"), after.split(":")
            assert a[1:-2] == b[1:] and len(a) == 12  # byte for byte
            mixed = b[0] == "0|1"
            if pos in (305, 310, 2001):
                assert a[0] == b[0].replace("|", "/") and a[-2:] == ["0", "False"]
            elif mixed:
                assert a[0] in ("0/1", "0/.") and (a[-1] == "True") == (float(a[-2]) > 0.9)
            else:
                assert a[0] == b[0]
        if pos in (305, 310):
            assert (r.filter, r.qual) == ("BLACKLISTED_SITE", "0")
        elif pos == 2001:
            assert (r.filter, r.qual) == ("LOW_QUALITY", "0")
        else:
            assert r.filter in ("PASS", "LOW_QUALITY") and (r.filter == "PASS") == any(s.endswith("True") for s in r.samples)
    assert sum(s.endswith("True") for p, r in got.items() if p % 5 == 0 and p >= 2000 for s in r.samples[11:]) > 20
    table = [line.split("\t") for line in open(next((tmp_path / "calls").glob("part-*.csv"))).read().splitlines()]
    assert table[0] == "sample chrom pos ref alt ploidy q_alpha q_beta p_error posterior is_mutation".split()
    called = {(names[i], p) for p, r in got.items() for i, s in enumerate(r.samples) if s.endswith("True") and rows[[x[1] for x in rows].index(p)][9][i].startswith("0|1")}
    parts = [line.split("\t") for f in (tmp_path / "calls").glob("part-*.csv") for line in open(f).read().splitlines() if not line.startswith("sample")]
    assert {(t[0], int(t[2])) for t in parts} == called and all(t[4] == "A,G" and t[-1] == "True" for t in parts)
    again = files.qc_records(variants.records(spark, str(tmp_path / "out")))[0].where("pos = 2000").first()
    assert again.format == rows[0][8] + ":PP:GOOD_CALL" and len(again.samples[0].split(":")) == 12


def test_quality_control_of_no_rows(spark, tmp_path):
    variant_sinks.write_variants(frame(spark, []), VcfHeader(HEAD), str(tmp_path / "in"))
    files.qc_files(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert variants.records(spark, str(tmp_path / "out")).count() == 0
    plain = frame(spark, [("chrM", 5, ".", "A", "G", ".", ".", ".", None, None)])
    variant_sinks.write_variants(plain, VcfHeader(HEAD), str(tmp_path / "p"))
    row = files.qc_records(variants.records(spark, str(tmp_path / "p")))[0].first()
    assert (row.filter, row.qual, row.samples, row.format) == ("LOW_QUALITY", "0", None, None)


def test_calls_from_bam_to_vcf(spark, tmp_path):
    from tests.test_operators import bam_bytes

    reads = sorted((0, p, f"q{i}") for i, p in enumerate([10] * 30 + [12] * 20 + [50] * 5))
    (tmp_path / "a.bam").write_bytes(bam_bytes(reads))
    (tmp_path / "r.fa").write_text(">c1\n" + "".join("ACGT"[i % 4] for i in range(200)) + "\n>c2\n" + "A" * 90 + "\n")
    files.call_files(spark, str(tmp_path / "a.bam"), str(tmp_path / "r.fa"), str(tmp_path / "out"), single=str(tmp_path / "calls.vcf.gz"), min_quality=0)
    head = variants.header(str(tmp_path / "calls.vcf.gz"))
    assert head.samples == ["smp"] and head.contigs == [("c1", 200), ("c2", 90)] and set(head.fields("INFO")) == {i for i, *_ in files.CALL_INFOS}
    got = variants.records(spark, str(tmp_path / "calls.vcf.gz")).collect()
    assert got and all(r.format == ":".join(f for f, *_ in files.CALL_FORMATS) for r in got)
    for r in got:
        value = dict(zip(r.format.split(":"), r.samples[0].split(":"), strict=True))
        n = len(value["GT"].split("/"))
        assert all(len(value[k].split(",")) == n for k in ("AD", "AF", "AQ", "LAF", "FS", "SOR", "VT")) and all(len(value[k].split(";")) == n for k in ("CI", "SB"))
        assert sum(map(int, value["AD"].split(","))) <= int(value["DP"]) and r.ref == "ACGT"[(r.pos - 1) % 4] and r.info.startswith("AN=1;")
        assert all(float(f) == pytest.approx(int(k) / int(value["DP"]), rel=1e-5) for k, f in zip(value["AD"].split(","), value["AF"].split(","), strict=True))
    region = variants.records(spark, str(tmp_path / "calls.vcf.gz"), "c1:40-60").count()
    assert region == sum(40 <= r.pos <= 60 for r in got)


def test_estimates_from_file_to_files(spark, tmp_path):
    rng = random.Random(5)
    names = "CHROM POS REF ALT FAM_ID MOTHER_ID CHILD_ID MOTHER_DP MOTHER_AD_REF MOTHER_AD_ALT MOTHER_VAF CHILD_DP CHILD_AD_REF CHILD_AD_ALT CHILD_VAF QC".split()
    rows = []
    for i in range(150):
        p, k = rng.uniform(0.15, 0.85), rng.randint(400, 900)
        m = sum(rng.random() < p for _ in range(k))
        passed = sum(rng.random() < p for _ in range(12)) / 12
        c = sum(rng.random() < passed for _ in range(k))
        fam = "F1" if i < 70 else "F2" if i < 148 else ""
        rows.append(["chrM", i + 1, "A", "G", fam, "M" + fam, f"C{i % 4}", k, k - m, m, f"{m / k:.6f}", k, k - c, c, f"{c / k:.6f}", "PASS"])
    (tmp_path / "pairs.tsv").write_text("# note\n" + "\t".join(names) + "\n" + "".join("\t".join(map(str, r)) + "\n" for r in rows))
    paths = {k: str(tmp_path / k) for k in ("families", "bins", "profile")}
    result = files.estimate_files(spark, str(tmp_path / "pairs.tsv"), str(tmp_path / "fit.json"), **paths, high=40, step=0.5, resamples=50)
    stored = json.loads((tmp_path / "fit.json").read_text())
    assert stored["fit"]["n"] == result["fit"]["n"] and 5 < stored["fit"]["ne"] < 25 and stored["families"] == 3
    read = {k: [line for f in sorted((tmp_path / k).glob("part-*.txt")) for line in f.read_text().splitlines()] for k in paths}
    table = {k: [x.split("\t") for x in v if not x.startswith("#")] for k, v in read.items()}
    assert table["families"][0] == [*files.FAMILY_COLUMNS[:-2], "KIMURA_b", "KIMURA_NE", "KIMURA_N_INFORMATIVE", "SKIPPED", "WARNING"] and [r[0] for r in table["families"][1:]] == ["ALL", "F1", "F2"]
    assert table["families"][1][5:11] == ["NA"] * 6 and table["families"][1][-2] == "TRUE" and table["families"][2][2] == "4"
    assert table["bins"][0] == files.BIN_COLUMNS and len(table["bins"]) == 11 and sum(int(r[4]) for r in table["bins"][1:]) == stored["fit"]["n"]
    first = table["bins"][1]
    assert float(first[11]) == pytest.approx(0.14 * 0.86 / stored["fit"]["ne"], rel=1e-6) and float(first[14]) == pytest.approx(1 / stored["fit"]["ne"], rel=1e-6)
    grid = [[float(x) for x in r] for r in table["profile"][1:]]
    assert table["profile"][0] == files.PROFILE_COLUMNS and [r[0] for r in grid] == [2 + 0.5 * i for i in range(77)] and min(r[2] for r in grid) == 0 and min(r[4] for r in grid) == 1
    assert abs(min(grid, key=lambda r: r[2])[0] - stored["fit"]["ne"]) <= 0.5
    assert any(x.startswith("#best_ne_mmle_on_grid=") for x in read["profile"]) and "#n_families_skipped=1" in read["families"]
    assert expected([]) == [] and fields(frame(spark, [])) == []
