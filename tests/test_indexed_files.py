"""Packed, indexed and binary files: rows as a full scan's, each once at every split, and only the blocks of a region read."""

import io
import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mitoloom.sources import bam, bcf, bgzf, genome_index, variant_sinks, variants
from mitoloom.sources.headers import VcfHeader
from tests.test_operators import bam_bytes

HEAD = [
    "##fileformat=VCFv4.2", '##FILTER=<ID=PASS,Description="ok">', '##FILTER=<ID=low,Description="a, b=c">',
    '##INFO=<ID=AC,Number=A,Type=Integer,Description="x">', '##INFO=<ID=AF,Number=A,Type=Float,Description="x">', '##INFO=<ID=DB,Number=0,Type=Flag,Description="x">', '##INFO=<ID=PT,Number=1,Type=String,Description="x">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="x">', '##FORMAT=<ID=AD,Number=.,Type=Integer,Description="x">', '##FORMAT=<ID=AF,Number=.,Type=Float,Description="x">', '##FORMAT=<ID=VT,Number=.,Type=String,Description="x">',
    "##contig=<ID=c1,length=200000>", "##contig=<ID=c:2,length=90000>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2",
]


def vcf_rows(n=700, seed=1):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        chrom = rng.choice(["c1", "c:2"])
        ref = rng.choice(["A", "AC", "A" * rng.choice([1, 300, 20_000])])
        gts = [rng.choice(["0/1:3,4:0.25,0.75:REF,SNV", ".:.:.:.", "1:7:1:SNV", "0|1|2:1,2,300:0.1,.,0.5:.", "0/.:70000:1e-05:x"]) for _ in range(2)]
        out.append((chrom, rng.randrange(1, 60_000), rng.choice([".", "rs1;x"]), ref, rng.choice([".", "G", "G,TT"]), rng.choice([".", "9.5", "10000"]), rng.choice([".", "PASS", "low"]), rng.choice([".", "AC=1,2;DB", "AF=0.125,.;PT=Het", "AC=-100000;PT=a"]), "GT:AD:AF:VT", gts))
    return sorted(out, key=lambda r: (r[0] != "c1", r[1]))


def vcf_bytes(rows):
    return ("\n".join(HEAD) + "\n" + "".join("\t".join([*map(str, r[:9]), *r[9]]) + "\n" for r in rows)).encode()


def frame(spark, rows):
    return spark.createDataFrame(rows, "chrom string, pos int, id string, ref string, alt string, qual string, filter string, info string, format string, samples array<string>")


def fields(df):
    return sorted((*[r[c] for c in variants.COLUMNS], tuple(r.samples)) for r in df.select(*variants.COLUMNS, "samples").collect())


def expected(rows):
    return sorted((*r[:9], tuple(r[9])) for r in rows)


def meets(r, contig, start, end):
    return r[0] == contig and r[1] <= end and r[1] + len(r[3]) - 1 >= start


class Counting(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        out = super().read(n)
        self.taken += len(out)
        return out


def test_bins_hold_and_find_every_interval():
    rng = random.Random(1)
    for shift, depth in ((14, 5), (12, 7)):
        for _ in range(400):
            size = rng.choice([1, 100, 20_000, 3_000_000])
            a, c = rng.randrange(1 << 28), rng.randrange(1 << 28)
            c = a + rng.randrange(-size, size) if rng.random() < 0.7 else c
            b, d = a + rng.randint(1, size), max(0, c) + rng.randint(1, size)
            found = any(genome_index.bin_of(a, b, shift, depth) in r for r in genome_index.bins_of(max(0, c), d, shift, depth))
            assert found or not (a < d and max(0, c) < b)


@pytest.mark.parametrize("fill", [37, 300, 5000])
def test_each_line_is_in_one_split_wherever_it_is_cut(fill):
    rows = [f"line{i}" + "x" * random.Random(i).choice([0, 3, 40, 900]) for i in range(120)]
    for text in ("\n".join(rows) + "\n", "\n".join(rows)):
        data = bgzf.compress(text.encode(), fill)
        for split in (1, 29, 100, 1000, 1 << 20):
            got = [(piece, s, o) for a in range(0, len(data), split) for piece, s, o in bgzf.lines_of_split(io.BytesIO(data), len(data), a, min(a + split, len(data)))]
            assert b"".join(p for p, *_ in got).decode() == text
            plain = [p for a in range(0, len(text), split) for p, *_ in variants._plain_lines(io.BytesIO(text.encode()), len(text), a, min(a + split, len(text)))]
            assert b"".join(plain).decode() == text


def test_places_lead_back_to_their_lines():
    text = "".join(f"c1\t{i + 1}\t.\tA\tG\t.\t.\t{'x' * (i % 50)}\n" for i in range(2000)).encode()
    data = bgzf.compress(text, 700)
    unpack = dict(bgzf.Blocks(io.BytesIO(data), len(data)))
    for a in range(0, len(data), 3000):
        for piece, starts, offsets in bgzf.lines_of_split(io.BytesIO(data), len(data), a, a + 3000):
            batch = variants.table_of(piece, *(variants.np.array(x, variants.np.int64) for x in (starts, offsets)), "f")
            for place, pos in zip(batch["place"].to_pylist(), batch["pos"].to_pylist(), strict=True):
                assert (unpack[place >> 16][place & 0xFFFF :] + unpack.get(max((p for p in unpack if p > place >> 16), default=0), b"")).startswith(f"c1\t{pos}"[: 700 - (place & 0xFFFF)].encode())


def test_header_like_bytes_inside_a_block_are_no_block():
    inner = bgzf.packed(b"abc") * 2 + bgzf.MAGIC * 5
    stored = bgzf.packed(inner)  # too little to pack: a copy of headers in the middle of a block
    data = stored + bgzf.packed(b"x") + bgzf.packed(b"y") + bgzf.packed(b"z") + bgzf.packed(b"w") + bgzf.END
    assert bgzf.first_block(io.BytesIO(data), len(data), 1) == len(stored)
    assert bgzf.first_block(io.BytesIO(data), len(data), len(data) - 1) == len(data)
    with pytest.raises(ValueError, match="not a BGZF block"):
        list(bgzf.Blocks(io.BytesIO(data), len(data), 3))
    with pytest.raises(ValueError, match="cut short"):
        list(bgzf.Blocks(io.BytesIO(data[:40]), 40))


def test_vcf_in_every_form_and_split(spark, tmp_path):
    import gzip

    rows = vcf_rows()
    data = vcf_bytes(rows)
    (tmp_path / "a.vcf").write_bytes(data)
    (tmp_path / "b.vcf.gz").write_bytes(bgzf.compress(data, 9000))
    (tmp_path / "c.vcf.gz").write_bytes(gzip.compress(data[:5000]) + gzip.compress(data[5000:]))
    for name, tasks in (("a.vcf", 20), ("b.vcf.gz", 10), ("c.vcf.gz", 1)):
        df = variants.records(spark, str(tmp_path / name), split_bytes=(tmp_path / name).stat().st_size // 20)
        assert fields(df) == expected(rows) and df.rdd.getNumPartitions() >= tasks and df.select("place").distinct().count() == len(rows)
        assert variants.header(str(tmp_path / name)).lines == HEAD
        some = variants.records(spark, str(tmp_path / name), "c:2:1000-9000,c1:500-600,c1:580-20000")
        assert fields(some) == expected(r for r in rows if meets(r, "c:2", 1000, 9000) or meets(r, "c1", 500, 20_000))
    assert variants.records(spark, str(tmp_path)).count() == 3 * len(rows)
    long, heads = variants.calls(spark, str(tmp_path / "b.vcf.gz"))
    assert long.count() == 2 * len(rows) and heads.count() == len(HEAD) - 1
    first = long.orderBy("record.place", "sample").first()
    assert first["sample"] == "s1" and first.fields["GT"] == rows[0][9][0].split(":")[0] and first.alts == ([] if rows[0][4] == "." else rows[0][4].split(","))
    (tmp_path / "odd.vcf").write_bytes(b"##x\n\nc1\t5\t.\tA\tG\t1\tPASS\tDB\r\nc1\tno\nc1")
    odd = {(r.chrom, r.pos, r.info, r.samples is None) for r in variants.records(spark, str(tmp_path / "odd.vcf")).collect()}
    assert odd == {("c1", 5, "DB", True), ("c1", None, None, True)}


@pytest.mark.parametrize(("binary", "single"), [(False, False), (False, True), (True, False), (True, True)])
def test_written_files_are_read_back_by_region(spark, tmp_path, binary, single):
    rows = vcf_rows(900, 2)
    folder, ending = tmp_path / "out", ".bcf" if binary else ".vcf.gz"
    target = str(tmp_path / f"one{ending}") if single else str(folder)
    written = variant_sinks.write_variants(frame(spark, rows).repartition(5), VcfHeader(HEAD), str(folder), binary=binary, single=target if single else None)
    assert written.agg(F.sum("rows")).first()[0] == len(rows) and not list(folder.glob("_parts*"))
    assert fields(variants.records(spark, target)) == expected(rows)
    if single:  # the order of the file is that of places
        got = [(r.chrom, r.pos) for r in variants.records(spark, target).orderBy("place").collect()]
        assert got == [(r[0], r[1]) for r in rows]
    for region in (("c1", 1, 100), ("c1", 16_384, 16_385), ("c1", 40_000, 60_000), ("c:2", 59_999, 90_000), ("c:2", 1, 90_000)):
        df = variants.records(spark, target, f"{region[0]}:{region[1]}-{region[2]}", split_bytes=4000)
        assert fields(df) == expected(r for r in rows if meets(r, *region))
    pushed = variants.records(spark, target).where("chrom = 'c1' AND pos BETWEEN 30000 AND 31000 AND ref <> 'A'")
    assert fields(pushed) == expected(r for r in rows if r[0] == "c1" and 30_000 <= r[1] <= 31_000 and r[3] != "A")
    plan = pushed._jdf.queryExecution().toString()
    assert "isnotnull" not in plan.split("== Physical Plan ==")[1] or "chrom#" in plan
    assert variants.records(spark, target).where("chrom IN ('c1', 'c9') AND pos > 59000").count() == sum(r[0] == "c1" and r[1] > 59_000 for r in rows)
    assert variants.records(spark, target).where("chrom = 'c9'").count() == variants.records(spark, target).where("chrom = 'c1' AND pos < 5 AND pos > 9").count() == 0


def test_a_region_reads_its_blocks_alone(tmp_path, spark):
    rows = vcf_rows(30_000, 3)
    rows = [(*r[:3], "A", *r[4:]) for r in rows]
    variant_sinks.write_variants(frame(spark, rows), VcfHeader(HEAD), str(tmp_path / "w"), single=str(tmp_path / "one.vcf.gz"))
    path = str(tmp_path / "one.vcf.gz")
    data = open(path, "rb").read()
    reader = variants.VariantReader({"path": path, "region": "c1:33000-33500"})
    raw = Counting(data)
    got = [r for part in reader.partitions() for b in reader.batches(raw, part) for r in reader._kept(b).to_pylist()]
    assert len(got) == sum(meets(r, "c1", 33_000, 33_500) for r in rows) > 5 and raw.taken < len(data) // 2
    assert variants.VariantReader({"path": path, "region": "c1:190000-190010"}).partitions() == []


def test_writing_no_rows_and_unknown_contigs(spark, tmp_path):
    none = frame(spark, [])
    for binary in (False, True):
        variant_sinks.write_variants(none, VcfHeader(HEAD), str(tmp_path / f"n{binary}"), binary=binary)
        got = variants.records(spark, str(tmp_path / f"n{binary}"), "c1:1-5")
        assert got.count() == 0 and variants.header(str(tmp_path / f"n{binary}")).lines == HEAD
        with pytest.raises(Exception, match="contig not in the header: zz"):
            variant_sinks.write_variants(frame(spark, [("zz", *vcf_rows(1)[0][1:])]), VcfHeader(HEAD), str(tmp_path / f"x{binary}"), binary=binary)
    with pytest.raises(Exception, match="does not declare 'XX'"):
        variant_sinks.write_variants(frame(spark, [("c1", 1, ".", "A", "G", ".", ".", "XX=1", None, None)]), VcfHeader(HEAD), str(tmp_path / "y"), binary=True)
    repeats = [vcf_rows(1)[0]] * 3 + [("c1", 7, None, "A", "G", None, None, None, None, None)]
    variant_sinks.write_variants(frame(spark, repeats), VcfHeader(HEAD), str(tmp_path / "r"))
    assert fields(variants.records(spark, str(tmp_path / "r")).where("samples IS NOT NULL")) == expected(repeats[:3])
    assert variants.records(spark, str(tmp_path / "r")).where("samples IS NULL AND format IS NULL AND id = '.'").count() == 1


def test_bcf_keeps_every_field_and_end_values():
    names = bcf.Dictionary(HEAD)
    for row in vcf_rows(300, 4):
        record, contig, start, end = bcf.encoded(row, names)
        assert (names.contigs[contig][0], start + 1, end - start) == (row[0], row[1], len(row[3]))
        sizes = struct.unpack_from("<II", record)
        back = bcf.decoded(record[8 : 8 + sizes[0]], record[8 + sizes[0] :], names)
        assert len(record) == 8 + sum(sizes) and back[:9] == row[:9] and back[9] == row[9]
        assert bcf.encoded(back, names)[0] == record
    # three samples' vectors of different lengths: 1; 2 and a missing one; nothing
    matrix = bcf._matrix([[1], [2, None], [None]])
    assert matrix == bytes([2 << 4 | bcf.INT8, 1, 0x81, 2, 0x80, 0x80, 0x81])
    assert bcf._genotypes(["0|1", ".", "2"]) == bytes([2 << 4 | bcf.INT8, 2, 5, 0, 0x81, 6, 0x81])
    assert bcf._integers([127]) == bytes([0x11, 127]) and bcf._integers([128])[0] == 0x12 and bcf._integers([-121])[0] == 0x12 and bcf._integers([1 << 15])[0] == 0x13
    assert bcf._kind(bcf.CHAR, 20) == bytes([15 << 4 | bcf.CHAR, 0x11, 20])
    numbered = bcf.Dictionary(['##INFO=<ID=X,Number=1,Type=Integer,Description="d",IDX=7>', '##FORMAT=<ID=Y,Number=1,Type=String,Description="d">', "##contig=<ID=k,IDX=3>"])
    assert numbered.number == {"PASS": 0, "X": 7, "Y": 8} and numbered.contig_number["k"] == 3


def long_reads(n, seed=5):
    rng = random.Random(seed)
    return sorted((rng.randrange(2), rng.randrange(0, 59_000), f"q{i}" + "z" * rng.choice([0, 10, 200])) for i in range(n)) + [(-1, -1, f"lost{i}") for i in range(20)] + [(-1, 77, "odd")]


def test_bam_without_an_index_is_split_and_each_read_comes_once(spark, tmp_path):
    reads = long_reads(3000)
    data = bam_bytes(reads)
    (tmp_path / "a.bam").write_bytes(data)
    spark.dataSource.register(bam.BamDataSource)
    for split in (997, 5000, 40_000, 1 << 26):
        reader = bam.BamReader({"path": str(tmp_path / "a.bam"), "splitBytes": str(split)})
        got = [row[1] for part in reader.partitions() for row in reader.rows(io.BytesIO(data), part)]
        assert got == [n for *_, n in reads]
    df = bam.reads(spark, str(tmp_path), splitBytes="5000")
    assert df.rdd.getNumPartitions() > 5 and df.count() == len(reads)


def test_bam_filters_become_regions(spark, tmp_path):
    reads = long_reads(40_000)
    data = bam_bytes(reads)
    path = tmp_path / "a.bam"
    path.write_bytes(data)
    (tmp_path / "a.bam.bai").write_bytes(bam.index_of(io.BytesIO(data)))
    df = bam.reads(spark, str(path))
    asked = df.where("rname = 'c2' AND pos BETWEEN 20000 AND 21000")
    assert sorted(r.qname for r in asked.collect()) == sorted(n for c, p, n in reads if c == 1 and 20_000 <= p <= 21_000)
    plan = asked._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "(rname#" not in plan and "20000" not in plan.split("BatchScan")[0]  # Spark does not filter them again
    assert df.where("rname = '*'").count() == 21 and df.where("pos = 77 AND rname = '*'").count() == 1
    raw, reader = Counting(data), bam.FilteredBamReader({"path": str(path)})
    assert not list(reader.pushFilters([bam_filter("EqualTo", "rname", "c2"), bam_filter("GreaterThanOrEqual", "pos", 20_000), bam_filter("LessThan", "pos", 20_400)]))
    got = [row[1] for part in reader.partitions() for row in reader.rows(raw, part)]
    assert sorted(got) == sorted(n for c, p, n in reads if c == 1 and 20_000 <= p < 20_400) and raw.taken < len(data) // 2
    several = bam.reads(spark, str(path), "c1:100-200,c1:150-9000,c2:1-50")
    assert sorted(r.qname for r in several.collect()) == sorted(n for c, p, n in reads if (c == 0 and p < 9000 and p + 4 > 99) or (c == 1 and p < 50))
    tail = [p for p in bam.BamReader({"path": str(path), "split": "20000"}).partitions() if p.starting[0] == -1]
    raw = Counting(data)
    assert len(tail) == 1 and len(list(reader_of(path).rows(raw, tail[0]))) == 21 and raw.taken < len(data) // 2


def reader_of(path):
    return bam.BamReader({"path": str(path)})


def bam_filter(kind, column, value):
    from pyspark.sql import datasource

    return getattr(datasource, kind)((column,), value)


def test_index_formats_agree():
    rng = random.Random(9)
    built, at, places = genome_index.Builder(), 100 << 16, []
    for contig in range(2):
        for start in sorted(rng.randrange(300_000) for _ in range(300)):
            size = rng.choice([1, 100, 40_000])
            built.add(contig, start, start + size, at, at + 7)
            places.append((contig, start, start + size, at))
            at += 7 if rng.random() < 0.8 else 1 << 16
    index = genome_index.put_together([(5, built.tables())], 2, ["a", "b"])
    forms = [index, *(genome_index.parse(genome_index.serialised(index, k)) for k in ("bai", "tbi", "csi"))]
    assert forms[2].names == forms[3].names == ["a", "b"]
    for _ in range(300):
        contig, start = rng.randrange(2), rng.randrange(310_000)
        end = start + rng.choice([1, 500, 50_000])
        for form in forms:
            chunks = form.chunks(contig, start, end)
            assert all(any(x <= o + (5 << 16) < y for x, y in chunks) for c, a, b, o in places if c == contig and a < end and b > start)
            assert all(y <= x for (_, y), (x, _) in zip(chunks, chunks[1:]))
    assert index.last() == max(o for *_, o in places) + 7 + (5 << 16) and index.chunks(7, 0, 5) == []
    with pytest.raises(ValueError, match="not an index"):
        genome_index.parse(b"BAM\x01")
    assert pa.BufferReader(b"x").read() == b"x"
