"""Each annotation loader on a small file of its own form, and the annotated table and records they make together."""

import gzip

import pytest

from mitoloom.sources import annotations as an
from mitoloom.sources import text


def write(folder, name, body):
    path = folder / an.FILES[name]
    path.parent.mkdir(parents=True, exist_ok=True)
    body = body.strip("\n").replace(" ~ ", "\t") + "\n"
    path.write_bytes(gzip.compress(body.encode()) if path.suffix == ".gz" else body.encode())


VEP_HEAD = "POS ~ REF ~ ALT ~ Allele ~ " + " ~ ".join(an.VEP.values())


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    f = tmp_path_factory.mktemp("databases")
    bases = {1: "G", 2: "A", 3: "T", 4: "N", 5: "C", 6: "C", 577: "G", 578: "T", 579: "A", 16569: "T"}
    write(f, "bases", "POS ~ REF ~ ALT\n" + "\n".join(f"{p} ~ {b} ~ {a}" for p, b in bases.items() for a in "XY"))
    vep = lambda pos, ref, alt, gene, residue: f"{pos} ~ {ref} ~ {alt} ~ CSQ={alt} ~ {gene} ~ ENSG ~ ENST ~ protein_coding ~ missense ~ MODERATE ~ c.{pos} ~ p.{residue} ~ A/B ~ {residue} ~ aCg/aTg"
    write(f, "vep", "\n".join([VEP_HEAD, vep(5, "C", "T", "ND1", 7), vep(5, "C", "T", "ND2", 8), vep(6, "C", "A", "ND1", 7), vep(2, "A", "G", "CO1", 1)]))
    write(f, "dbsnp", "##x\n#CHROM ~ POS\nchrM ~ 2 ~ rs1 ~ A ~ G,T ~ . ~ .\nchrM ~ 5 ~ rs2 ~ CC ~ TC,. ~ . ~ .\nchrM ~ 2 ~ rs9 ~ A ~ T ~ . ~ .")
    write(f, "gnomad", "position ~ ref ~ alt ~ filters ~ max_observed_heteroplasmy ~ AF_hom ~ AF_het ~ AC_hom ~ AC_het\n2 ~ A ~ G ~ PASS ~ 0.5 ~ 0.1 ~ 0.2 ~ 3 ~ 4\n5 ~ C ~ T ~ npg ~ 1 ~ 1 ~ 1 ~ 1 ~ 1")
    write(f, "phylop", "fixedStep chrom=chrM\n-1.5\n0.25\n3\n4\n5.125\n6\n")
    write(f, "trna", "tRNA_position ~ m.pos\n7 ~ 2\n68 ~ 2\n1 ~ 5")
    write(f, "rna_domains", "POS ~ GENE ~ MODIFICATION ~ DOMAIN\n2 ~ MT-TI, MT-TQ ~ #N/A ~ Acceptor stem\n5 ~ MT-TF ~ m1G ~ \n6 ~ A,B ~ D ~ loop")
    write(f, "rna_bases", "Type ~ Genomic_coordinate ~ file ~ RNA.base ~ Pair_coordinate\nb ~ 2 ~ g1 ~ A ~ 5\nb ~ 5 ~ g1 ~ T ~ 2\nb ~ 2 ~ g2 ~ G ~ 6\nb ~ 6 ~ g2 ~ T ~ 2\nb ~ 3 ~ g1 ~ C ~ \nx ~ 4 ~ g1 ~ N ~ ")
    bed = lambda name, s, e, n, sizes, starts, what: " ~ ".join(["chrM", str(s), str(e), *"......", str(n), sizes, starts, ".", what, f"UP000005640_9606_{name}.bed"])
    write(f, "uniprot", "\n".join([bed("binding", 1, 6, 2, "2,1,", "0,4,", "Heme a; axial"), bed("metal", 1, 3, 1, "1", "0", "Mg"), bed("binding", 1, 3, 1, "2", "0", "Heme a; axial"), bed("topo_dom", 1, 6, 1, "5", "0", "no")]))
    write(f, "proton", "locus ~ residue\nND1 ~ 7")
    write(f, "apogee", "Ref ~ Start ~ Alt ~ APOGEE2\nC ~ 5 ~ T ~ Likely pathogenic\nC ~ 5 ~ T ~ VUS\nA ~ 2 ~ G ~ Benign")
    write(f, "mitotip", "rCRS ~ Position ~ Alt ~ Quartile ~ Mitomap_Status\nA ~ 2 ~ G ~ Q1 ~ Confirmed\nA ~ 2 ~ T ~ Q1 ~ x\nC ~ 5 ~ T ~ Q4 ~ \nC ~ 6 ~ A ~ ? ~ ")
    write(f, "hmtvar", 'REF ~ POS ~ ALT ~ HmtVar\nA ~ 2 ~ G ~ "{""pathogenicity"": ""polymorphic"", ""x"": 1}"\nC ~ 5 ~ T ~ {}')
    write(f, "helix", 'locus ~ alleles ~ AF_hom ~ AF_het ~ max_ARF\nchrM:2 ~ ["A","G"] ~ 0 ~ 0.001 ~ 0.25\nchrM:5 ~ ["C","T"] ~ 0.01 ~ 0.002 ~ 0.9\nchrM:6 ~ ["C","A","T"] ~ 0 ~ 0 ~ 1')
    write(f, "loci", '"Map Locus","Starting","Ending","Shorthand"\n"MT-B","2","6","b"\n"MT-A","1","3","a"\n"MT-X","9","2","x"')
    write(f, "disease", "pos ~ ref ~ alt ~ status ~ homoplasmy ~ heteroplasmy ~ disease\n2 ~ A ~ G ~ Cfrm;x ~ + ~ - ~ LHON / MELAS; deaf\n5 ~ C ~ T ~ Unclear ~ + ~ + ~ no\n6 ~ C ~ : ~ Reported ~ + ~ + ~ no")
    write(f, "polymorphisms", "pos ~ ref ~ alt ~ gbcnt\n2 ~ A ~ G ~ 12\n5 ~ C ~ d ~ 4\n6 ~ CC ~ C ~ 4")
    write(f, "clinvar", "GRCh38Location ~ Canonical SPDI ~ Clinical significance (Last reviewed) ~ Condition(s)\n2 ~ NC:1:A:G ~ Likely benign(Last reviewed: x) ~ Leigh\n5 ~ NC:4:C:T ~ Benign(x) ~ Neoplasm of ovary\n6 ~ NC:5:C:A ~ Conflicting interpretations of pathogenicity(x) ~ y")
    human, chimp = "GT-A" + "C" * (an.LENGTH - 577 - 2) + "GATNCC", "GTCG" + "C" * (an.LENGTH - 577 - 2) + "GACNTT"
    write(f, "chimp", "".join(f"[1] {human[i : i + 60]} x\n[2] {chimp[i : i + 60]} y\n\n" for i in range(0, len(human), 60)))
    write(f, "phylotree", "A2G\nC7T")
    write(f, "bridges", "rRNA_bridge_bases\n5")
    return str(f)


def rows(df):
    return {tuple(r)[:-1] if len(r) > 2 else r[0]: r[-1] for r in df.collect()}


def by(df, key, column):
    return {tuple(r[k] for k in key) if len(key) > 1 else r[key[0]]: r[column] for r in df.collect() if r[column] is not None}


def test_loaders(spark, folder):
    v = an.VARIANT
    load = lambda f, key, column: by(f(spark, folder), key, column)
    assert load(an.trinucleotides, ["pos"], "trinucleotide") == {1: "TGA", 2: "GAT", 3: "ATC", 5: "TCC", 6: "CCG", 577: "CGT", 578: "GTA", 579: "TAT", 16569: "ATG"}
    assert load(an.dbsnp, ["chrom", *v], "ID") == {("chrM", "A", 2, "G"): "rs1", ("chrM", "A", 2, "T"): "rs9", ("chrM", "C", 5, "T"): "rs2"}
    assert load(an.gnomad, v, "gnomad_ac_het") == {("A", 2, "G"): "4"}
    assert load(an.phylop, ["pos"], "phyloP_score") == {1: "-1.5", 2: "0.25", 3: "3", 4: "4", 5: "5.125", 6: "6"}
    assert load(an.vep, v, "symbol") == {("C", 5, "T"): "ND2", ("C", 6, "A"): "ND1", ("A", 2, "G"): "CO1"}
    assert load(an.trna, ["pos"], "tRNA_position") == {2: "7,68", 5: "1"}
    assert load(an.rna_domains, ["pos"], "tRNA_domain") == {2: "Acceptorstem,Acceptorstem", 6: "loop,loop"} and load(an.rna_domains, ["pos"], "RNA_modified") == {5: "m1G", 6: "D,D"}
    assert load(an.rna_bases, ["pos"], "RNA_base_type") == {2: "WC,non-WC", 5: "WC", 6: "non-WC", 3: "loop-or-other"}
    assert load(an.uniprot, ["pos"], "uniprot_annotation") == {2: "site:binding-Hemea|axial,site:metal-Mg", 3: "site:binding-Hemea|axial", 6: "site:binding-Hemea|axial"}
    assert load(an.proton, ["pos"], "other_prot_annotation") == {5: an.PROTON, 6: an.PROTON}
    assert load(an.apogee, v, "apogee_class") == {("C", 5, "T"): "Likelypathogenic,VUS", ("A", 2, "G"): "Benign"}
    assert load(an.mitotip, v, "mitotip_class") == {("A", 2, "G"): "confirmed_pathogenic", ("A", 2, "T"): "likely_pathogenic", ("C", 5, "T"): "likely_benign", ("C", 6, "A"): ""}
    assert load(an.hmtvar, v, "hmtvar_class") == {("A", 2, "G"): "polymorphic", ("C", 5, "T"): ""}
    assert load(an.helix, v, "helix_max_hl") == {("A", 2, "G"): "0.25", ("C", 5, "T"): "1"}
    assert sorted((r.s, r.e, r.mitomap_locus) for r in an.loci(spark, folder).collect()) == [(1, 3, "MT-A"), (2, 6, "MT-B")]
    assert [tuple(r) for r in an.disease(spark, folder).collect()] == [("A", 2, "G", "Cfrm|x", "+/-", "LHON/MELAS|_deaf")]
    assert [tuple(r) for r in an.polymorphisms(spark, folder).collect()] == [("A", 2, "G", "12", repr(12 / 61883)), ("C", 5, "d", "4", repr(4 / 61883))]
    assert load(an.clinvar, v, "clinvar_interp") == {("A", 2, "G"): "Likely_benign"}
    found = by(an.chimp(spark, folder), ["pos", "base"], "chimp_ref")
    assert len(found) == an.LENGTH - 577 + 1 + 6 and [found[p, b] for p, b in ((577, "G"), (578, "T"), (579, "A"), (1, "G"), (3, "T"), (5, "C"), (6, "C"))] == ["G", "T", "G", "G", "C", "T", "T"]


def test_annotated_table_and_records(spark, folder):
    info = "AN=9;REF_N=1;HET_N=2;HOM_N=6;VAF_MEAN=0.1,0.2;VAF_MEAN_HET=0.3,0.4;PT=Mixed"
    schema = "file string, place long, chrom string, pos int, id string, ref string, alt string, qual string, filter string, info string, format string, samples array<string>"
    data = [("f", 1, "chrM", 2, ".", "A", "G,T", "9", "PASS", info, "GT", ["0"]), ("f", 2, "chrM", 5, ".", "CC", "TC", "9", "PASS", info, "GT", ["0"]), ("f", 3, "chrM", 4, ".", "N", "A", "9", "PASS", info, "GT", ["0"]), ("f", 4, "chrM", 6, ".", "C", ".", "9", "PASS", "X", "GT", ["0"]), ("f", 5, "chrM", 577, "old", "GTA", "G", "9", ".", "X", "GT", ["0"])]
    records = spark.createDataFrame(data, schema)
    table = an.annotated(records, spark, folder)
    assert table.columns[:53] == an.COLUMNS and len(an.COLUMNS) == 53
    got = {(r.POS, r.REF, r.ALT): r for r in table.collect()}
    assert set(got) == {("2", "A", "G"), ("2", "A", "T"), ("5", "C", "T"), ("577", "GTA", "G")}
    one = got["2", "A", "G"]
    assert (one.ID, one.trinucleotide, one.VAF_MEAN, one.VAF_MEAN_HET, one.AN, one.PT, one.mitomap_locus, one.symbol, one.gnomad_max_hl, one.in_phylotree, one.rRNA_bridge_base, one.mitomap_plasmy, one.chimp_ref) == ("rs1", "GAT", "0.1", "0.3", "9", "Mixed", "MT-A", "CO1", "0.5", "1", "No", "+/-", "A")
    other = got["2", "A", "T"]
    assert (other.ID, other.VAF_MEAN, other.symbol, other.gnomad_max_hl, other.gnomad_af_hom, other.helix_max_hl, other.mitomap_gbcnt, other.mitomap_status, other.in_phylotree, other.tRNA_position) == ("rs9", "0.2", "", "0", "0", "0", "0", "", "0", "7,68")
    third = got["5", "C", "T"]
    assert (third.symbol, third.apogee_class, third.rRNA_bridge_base, third.other_prot_annotation, third.mitomap_locus, third.phyloP_score, third.chimp_ref) == ("ND2", "Likelypathogenic,VUS", "Yes", an.PROTON, "MT-B", "5.125", "T")
    assert got["577", "GTA", "G"].chimp_ref == "GTG" and got["577", "GTA", "G"].AN == ""
    out = {r.place: r for r in an.with_annotations(records, table).collect()}
    assert set(out) == {1, 2, 5} and out[1].id == "rs1;rs9" and out[5].id == "." and out[1].samples == ["0"]
    fields = dict(x.split("=", 1) for x in out[1].info.removeprefix(info + ";").split(";"))
    assert list(fields) == an.INFO and fields["trinucleotide"] == "GAT" and fields["symbol"] == "CO1" and fields["gnomad_max_hl"] == "0.5,0" and fields["apogee_class"] == "Benign," and fields["tRNA_position"] == "7,68"
    assert an.annotated(records.limit(0), spark, folder).count() == 0


def test_merged_dimensions_and_broken_blocks(spark, folder, tmp_path):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "pos int, p string"), spark.createDataFrame([(2, "z")], "pos int, q string")
    assert sorted(map(tuple, an.merged([a, b], ["pos"]).collect())) == [(1, "x", None), (2, "y", "z")]
    with pytest.raises(ValueError, match="several dimensions"):
        an.merged([a, a], ["pos"])
    write(tmp_path, "uniprot", " ~ ".join(["chrM", "1", "3", *"......", "1", "9", "0", ".", "x", "UP000005640_9606_binding.bed"]))
    with pytest.raises(Exception, match="behind its interval"):
        an.uniprot(spark, str(tmp_path)).collect()
    (tmp_path / "list").write_text("# c\nfirst second\n\n third\tx\n")
    assert sorted(r.value for r in text.first_column(spark, str(tmp_path / "list")).collect()) == ["first", "third"]
