"""Annotation databases as keyed dimensions, and what they say of a file's variants: each loader derives its keys and values from one
file, loaders of one key are merged, and variants join each merged dimension once."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from mitoloom.functions import alleles as al
from mitoloom.operators import annotate, intervals
from mitoloom.operators.ordered import durable, numbered
from mitoloom.sources import text

# Where the databases lie in their folder.
FILES = {
    "bases": "synthetic_vcf/NC_012920.1_synthetic_vep_noheader.vcf.gz", "vep": "synthetic_vcf/NC_012920.1_synthetic_vep_splitvarstwogenes.vcf.gz", "dbsnp": "databases/dbSNP.chrM.vcf.gz",
    "gnomad": "databases/gnomad.genomes.v3.1.sites.chrM.reduced_annotations.tsv.gz", "phylop": "insilicos/chrM.phyloP100way.wigFix.gz", "trna": "other_annotations/tRNA_positions.txt",
    "rna_domains": "other_annotations/mito_RNA_modifications_and_domains.txt.gz", "rna_bases": "other_annotations/all_RNA_bases.tsv.gz", "uniprot": "other_annotations/uniprot_beds_chrMT_combined.20250403.txt.gz",
    "proton": "other_annotations/CI_proton_residues_PMID32972993.txt", "apogee": "insilicos/MitImpact_db_3.1.3.txt.gz", "mitotip": "insilicos/mitotip_scores.txt.gz", "hmtvar": "insilicos/hmtvar_annotations.txt.gz",
    "helix": "databases/HelixMTdb_20200327.tsv.gz", "loci": "databases/mitomap_genome_loci.csv", "disease": "databases/MITOMAP_disease_20250403.txt.gz", "polymorphisms": "databases/MITOMAP_polymorphisms_20250403.txt.gz",
    "clinvar": "databases/clinvar_result_chrMT_SNVonly_05252022.txt.gz", "chimp": "other_annotations/human-shifted_chimp_mt_aln.txt", "phylotree": "databases/phylotree_variants.txt", "bridges": "other_annotations/rRNA_bridge_bases.txt",
}
# Sequences that polymorphism counts are out of; the contig's length and where the aligned sequence begins; conditions
# that do not count; what a proton site is called.
SEQUENCES, LENGTH, ALIGNED_FROM = 61_883, 16_569, 577
NOT_COUNTED = ("Familial colorectal cancer", "Familial cancer of breast", "Acute megakaryoblastic leukemia|Mediastinal germ cell tumor", "Neoplasm of ovary")
PROTON = "proton-transfer-PMID32972993"
VEP = {"symbol": "SYMBOL", "transcript": "Gene", "feature": "Feature", "biotype": "BIOTYPE", "consequence": "Consequence", "impact": "IMPACT", "HGVSc": "HGVSc", "HGVSp": "HGVSp", "amino_acids": "Amino_acids", "protein_position": "Protein_position", "codon_change": "Codons"}
VARIANT = ["ref", "pos", "alt"]
# Columns of the annotated table.
COLUMNS = "CHROM POS ID REF ALT FILTER trinucleotide VAF_MEAN VAF_MEAN_HET AN REF_N HET_N HOM_N PT mitomap_locus symbol transcript feature biotype consequence impact HGVSc HGVSp amino_acids protein_position codon_change gnomad_max_hl gnomad_af_hom gnomad_af_het gnomad_ac_hom gnomad_ac_het in_phylotree phyloP_score tRNA_position tRNA_domain RNA_base_type RNA_modified rRNA_bridge_base uniprot_annotation other_prot_annotation apogee_class mitotip_class hmtvar_class helix_max_hl helix_af_hom helix_af_het mitomap_gbcnt mitomap_af mitomap_status mitomap_plasmy mitomap_disease clinvar_interp chimp_ref".split()
ZERO = {c for c in COLUMNS if c.startswith(("gnomad_", "helix_", "mitomap_gb", "mitomap_af"))}
#: Annotated INFO fields, in order, behind the ones that a record has.
INFO = [c for c in COLUMNS if c in ("trinucleotide", "symbol", "mitomap_locus") or c in COLUMNS[26:]]


@F.pandas_udf(StringType())
def plain_number(x: pd.Series) -> pd.Series:
    """The shortest text of a double that gives it again."""
    return x.map(repr, na_action="ignore")


def tsv(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A file's columns as texts under the names of its first line, and ``line``, which orders them. Missing fields are empty."""
    rows = text.lines(spark, f"{folder}/{FILES[name]}")
    head = rows.orderBy("line").first()
    clean = lambda c: F.regexp_replace(c, '^"|"$', "")
    names = [x.strip('"') for x in head["value"].split("\t")]
    fields = F.split("value", "\t")
    return rows.where(F.col("value") != head["value"]).select("line", *[F.coalesce(clean(F.get(fields, F.lit(i))), F.lit("")).alias(n) for i, n in enumerate(names)])


def last(rows: DataFrame, key: list[str], *values: str) -> DataFrame:
    """The file's last row of each key."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*values), "line").alias("v")).select(*key, "v.*")


def listed(rows: DataFrame, key: list[str], value: str, once: bool = False) -> DataFrame:
    """Each key's values in the file's order, with commas between them and without spaces."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("line", value))), lambda x: x[value])
    text_ = F.array_join(F.array_distinct(values) if once else values, ",")
    return rows.groupBy(*key).agg(F.replace(text_, F.lit(" "), F.lit("")).alias(value))


def _variant(rows: DataFrame, ref: str, pos: str, alt: str, **values: Column) -> DataFrame:
    return rows.select("line", F.col(ref).alias("ref"), F.col(pos).try_cast("int").alias("pos"), F.col(alt).alias("alt"), *[v.alias(n) for n, v in values.items()])


def _single(rows: DataFrame) -> DataFrame:
    """Changes of one base into another."""
    return rows.where((F.length("ref") == 1) & (F.length("alt") == 1) & F.col("alt").rlike(r"^\p{L}$") & (F.col("ref") != F.col("alt")))


def bases(spark: SparkSession, folder: str) -> DataFrame:
    """(pos, base) of the reference."""
    rows = tsv(spark, folder, "bases")
    return last(rows.select("line", F.col("POS").cast("int").alias("pos"), F.col("REF").alias("base")), ["pos"], "base")


def trinucleotides(spark: SparkSession, folder: str) -> DataFrame:
    """Each base between its neighbours, round the end; the spacer N has none and counts as no neighbour."""
    around = annotate.circular_neighbours(bases(spark, folder).withColumn("k", F.lit(0)), ["k"])  # one contig of 16,569 bases
    return around.select("pos", F.concat("before", "base", "after").alias("trinucleotide"))


def dbsnp(spark: SparkSession, folder: str) -> DataFrame:
    """(chrom, ref, pos, alt, ID): a row for each alternative, without what it and its reference end with alike."""
    rows = text.lines(spark, f"{folder}/{FILES['dbsnp']}").where("NOT startswith(value, '#')").select("line", F.split("value", "\t").alias("f"))
    refs, alts = F.split(F.get("f", F.lit(3)), ","), F.split(F.get("f", F.lit(4)), ",")
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size(refs), F.size(alts)) - 1), lambda i: F.struct(F.coalesce(F.get(refs, i), F.get(refs, F.lit(0))).alias("ref"), F.coalesce(F.get(alts, i), F.get(refs, F.lit(0))).alias("alt"))))
    each = rows.select("line", F.get("f", F.lit(0)).alias("chrom"), F.get("f", F.lit(1)).cast("int").alias("pos"), F.get("f", F.lit(2)).alias("ID"), pairs.alias("x")).select("line", "chrom", "pos", "ID", "x.ref", "x.alt")
    return last(al.suffix_trimmed(each).where("alt <> '.'"), ["chrom", *VARIANT], "ID")


def gnomad(spark: SparkSession, folder: str) -> DataFrame:
    names = {"gnomad_max_hl": "max_observed_heteroplasmy", "gnomad_af_hom": "AF_hom", "gnomad_af_het": "AF_het", "gnomad_ac_hom": "AC_hom", "gnomad_ac_het": "AC_het"}
    return last(_variant(tsv(spark, folder, "gnomad").where("filters = 'PASS'"), "ref", "position", "alt", **{n: F.col(c) for n, c in names.items()}), VARIANT, *names)


def phylop(spark: SparkSession, folder: str) -> DataFrame:
    """A file's n-th line, from 0, is position n's score; the line 0 is its head."""
    rows = numbered(text.lines(spark, f"{folder}/{FILES['phylop']}"), [F.col("line")], "n")
    return rows.where("n > 0").select(F.col("n").cast("int").alias("pos"), F.col("value").alias("phyloP_score"))


def vep(spark: SparkSession, folder: str) -> DataFrame:
    """Consequences; of a variant in two genes, the file's last."""
    return last(_variant(tsv(spark, folder, "vep"), "REF", "POS", "ALT", **{n: F.col(c) for n, c in VEP.items()}), VARIANT, *VEP)


def trna(spark: SparkSession, folder: str) -> DataFrame:
    rows = tsv(spark, folder, "trna").select("line", F.col("`m.pos`").cast("int").alias("pos"), F.col("tRNA_position"))
    return listed(rows, ["pos"], "tRNA_position")


def rna_domains(spark: SparkSession, folder: str) -> DataFrame:
    """Modifications and domains; a base in two genes has its own twice."""
    rows = tsv(spark, folder, "rna_domains").withColumn("pos", F.col("POS").cast("int"))
    twice = lambda c: F.replace(F.when(F.contains("GENE", F.lit(",")), F.concat(c, F.lit(","), c)).otherwise(F.col(c)), F.lit(" "), F.lit(""))
    modified = last(rows.where("MODIFICATION <> '#N/A'").withColumn("RNA_modified", twice("MODIFICATION")), ["pos"], "RNA_modified")
    return modified.join(last(rows.where("DOMAIN <> ''").withColumn("tRNA_domain", twice("DOMAIN")), ["pos"], "tRNA_domain"), "pos", "full")


def rna_bases(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a base's partner in its gene makes a pair of Watson and Crick; bases without one are loops."""
    rows = tsv(spark, folder, "rna_bases").where("Type = 'b'")
    own = rows.select("line", F.col("file").alias("gene"), F.col("Genomic_coordinate").cast("int").alias("pos"), F.col("`RNA.base`").alias("base"), F.col("Pair_coordinate").try_cast("int").alias("pair_pos"))
    # partners are sought among bases that are themselves in pairs; of repeated ones the last counts
    partners = last(own.where("pair_pos IS NOT NULL"), ["gene", "pos"], "base").select("gene", F.col("pos").alias("pair_pos"), F.col("base").alias("other"))
    typed = own.join(partners, ["gene", "pair_pos"], "left")
    pairing = F.when(F.col("pair_pos").isNull(), "loop-or-other").when(F.concat("base", F.coalesce("other", F.lit(""))).isin("AT", "TA", "CG", "GC"), "WC").otherwise("non-WC")
    return listed(typed.withColumn("RNA_base_type", pairing), ["pos"], "RNA_base_type")


def uniprot(spark: SparkSession, folder: str) -> DataFrame:
    """Binding sites by position, from the blocks of each interval; a block beyond its interval's end raises."""
    rows = text.lines(spark, f"{folder}/{FILES['uniprot']}").select("line", F.split(F.trim("value"), "\t").alias("f"))
    source = F.get("f", F.lit(14))
    rows = rows.where(source.rlike("binding|metal"))
    name = F.concat(F.lit("site:"), F.split_part(F.split_part(source, F.lit("UP000005640_9606_"), F.lit(2)), F.lit(".bed"), F.lit(1)), F.lit("-"), F.replace(F.get("f", F.lit(13)), F.lit(";"), F.lit("|")))
    whole = lambda i: F.transform(F.split(F.get("f", F.lit(i)), ","), lambda x: x.try_cast("int"))
    blocks = rows.select("line", name.alias("uniprot_annotation"), F.get("f", F.lit(1)).cast("int").alias("s"), F.get("f", F.lit(2)).cast("int").alias("last"), F.slice(whole(11), F.lit(1), F.get("f", F.lit(9)).cast("int")).alias("offsets"), F.slice(whole(10), F.lit(1), F.get("f", F.lit(9)).cast("int")).alias("sizes"))
    beyond = F.exists(F.zip_with("offsets", "sizes", lambda o, n: o + n), lambda e: F.col("s") + e > F.col("last"))
    sound = blocks.withColumn("s", F.when(beyond, F.raise_error(F.lit("a block ends behind its interval")).cast("int")).otherwise(F.col("s") + 1))
    placed = intervals.block_positions(sound).where(F.col("pos").between(1, LENGTH))
    return listed(placed, ["pos"], "uniprot_annotation", once=True)


def proton(spark: SparkSession, folder: str) -> DataFrame:
    """Positions of the codons of listed residues."""
    codons = tsv(spark, folder, "vep").select(F.col("SYMBOL").alias("locus"), F.col("Protein_position").alias("residue"), F.col("POS").cast("int").alias("pos"))
    found = tsv(spark, folder, "proton").select("locus", "residue").join(codons, ["locus", "residue"])
    return found.select("pos").distinct().withColumn("other_prot_annotation", F.lit(PROTON))


def apogee(spark: SparkSession, folder: str) -> DataFrame:
    return listed(_variant(tsv(spark, folder, "apogee"), "Ref", "Start", "Alt", apogee_class=F.col("APOGEE2")), VARIANT, "apogee_class")


def mitotip(spark: SparkSession, folder: str) -> DataFrame:
    first = F.when(F.col("Mitomap_Status") == "Confirmed", "confirmed_pathogenic").otherwise("likely_pathogenic")
    quarter = F.when(F.col("Quartile") == "Q1", first).when(F.col("Quartile") == "Q2", "possibly_pathogenic").when(F.col("Quartile") == "Q3", "possibly_benign").when(F.col("Quartile") == "Q4", "likely_benign")
    return last(_variant(tsv(spark, folder, "mitotip"), "rCRS", "Position", "Alt", mitotip_class=F.coalesce(quarter, F.lit(""))), VARIANT, "mitotip_class")


def hmtvar(spark: SparkSession, folder: str) -> DataFrame:
    rows = tsv(spark, folder, "hmtvar").withColumn("j", F.replace(F.col("HmtVar"), F.lit('""'), F.lit('"')))
    return last(_variant(rows, "REF", "POS", "ALT", hmtvar_class=F.when(F.length("HmtVar") > 3, F.get_json_object("j", "$.pathogenicity")).otherwise("")), VARIANT, "hmtvar_class")


def helix(spark: SparkSession, folder: str) -> DataFrame:
    """Variants of two alleles; the greatest share is 1 where the variant has been seen in all copies."""
    rows = tsv(spark, folder, "helix").withColumn("a", F.regexp_extract_all("alleles", F.lit(r"([\p{L}]+)"))).where(F.length("alleles") - F.length(F.replace("alleles", F.lit(","), F.lit(""))) == 1)
    share = F.when(F.col("AF_hom").cast("double") == 0, plain_number(F.col("max_ARF").cast("double"))).otherwise("1")
    keyed = rows.withColumns({"ref": F.get("a", F.lit(0)), "alt": F.get("a", F.lit(1)), "pos": F.split_part("locus", F.lit("chrM:"), F.lit(2))})
    names = {"helix_max_hl": share, "helix_af_hom": F.col("AF_hom"), "helix_af_het": F.col("AF_het")}
    return last(_variant(keyed, "ref", "pos", "alt", **names), VARIANT, *names)


def loci(spark: SparkSession, folder: str) -> DataFrame:
    """(s, e, mitomap_locus); intervals that end before they start are left out."""
    rows = spark.read.csv(f"{folder}/{FILES['loci']}", header=True).select(F.col("Starting").cast("int").alias("s"), F.col("Ending").cast("int").alias("e"), F.col("Map Locus").alias("mitomap_locus"))
    return rows.where("e >= s")


def disease(spark: SparkSession, folder: str) -> DataFrame:
    """Confirmed and reported changes of one base; semicolons, which end fields, become bars."""
    bar = lambda c: F.replace(F.col(c), F.lit(";"), F.lit("|"))
    name = F.replace(F.replace(F.replace(F.trim(bar("disease")), F.lit("/ "), F.lit("/")), F.lit(" /"), F.lit("/")), F.lit(" "), F.lit("_"))
    rows = tsv(spark, folder, "disease").where(F.col("status").rlike("Cfrm|Reported"))
    names = {"mitomap_status": bar("status"), "mitomap_plasmy": F.concat(bar("homoplasmy"), F.lit("/"), bar("heteroplasmy")), "mitomap_disease": name}
    return last(_single(_variant(rows, "ref", "pos", "alt", **names)), VARIANT, *names)


def polymorphisms(spark: SparkSession, folder: str) -> DataFrame:
    names = {"mitomap_gbcnt": F.col("gbcnt").try_cast("int").cast("string"), "mitomap_af": plain_number(F.col("gbcnt").try_cast("int") / F.lit(float(SEQUENCES)))}
    return last(_single(_variant(tsv(spark, folder, "polymorphisms"), "ref", "pos", "alt", **names)), VARIANT, *names)


def clinvar(spark: SparkSession, folder: str) -> DataFrame:
    spdi, meaning = F.split("Canonical SPDI", ":"), F.split_part(F.col("`Clinical significance (Last reviewed)`"), F.lit("("), F.lit(1))
    rows = tsv(spark, folder, "clinvar").withColumns({"ref": F.get(spdi, F.lit(2)), "alt": F.element_at(spdi, -1), "meaning": meaning})
    kept = rows.where((F.col("meaning") != "Conflicting interpretations of pathogenicity") & ~F.col("`Condition(s)`").isin(*NOT_COUNTED))
    found = _variant(kept, "ref", "GRCh38Location", "alt", clinvar_interp=F.replace(F.trim("meaning"), F.lit(" "), F.lit("_")))
    return last(found.where((F.length("ref") == 1) & (F.length("alt") == 1) & (F.col("ref") != F.col("alt"))), VARIANT, "clinvar_interp")


def chimp(spark: SparkSession, folder: str) -> DataFrame:
    """(pos, base, chimp_ref): the other species' base, from blocks of aligned lines that begin with [1] and [2]."""
    rows = text.lines(spark, f"{folder}/{FILES['chimp']}").select("line", F.split(F.trim("value"), " ").alias("f"))
    joined = lambda mark: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.startswith(F.get("f", F.lit(0)), F.lit(mark)), F.struct("line", F.get("f", F.lit(1)).alias("s"))))), lambda x: x["s"]), "")
    both = rows.agg(joined("[1]").alias("one"), joined("[2]").alias("other"))  # a genome of 16,569 bases
    columns = annotate.alignment_columns(both, F.col("one"), F.col("other"), ALIGNED_FROM, LENGTH)
    return columns.select("pos", F.col("one").alias("base"), F.col("other").alias("chimp_ref"))


#: Loaders by what their key is.
BY_VARIANT: tuple[Callable[[SparkSession, str], DataFrame], ...] = (gnomad, vep, apogee, mitotip, hmtvar, helix, disease, polymorphisms, clinvar)
BY_POSITION: tuple[Callable[[SparkSession, str], DataFrame], ...] = (trinucleotides, phylop, trna, rna_domains, rna_bases, uniprot, proton)


def merged(tables: list[DataFrame], key: list[str]) -> DataFrame:
    """Tables of one key as one: a row a key, with null where a table does not have it."""
    columns = [c for t in tables for c in t.columns if c not in key]
    if repeated := {c for c in columns if columns.count(c) > 1}:
        raise ValueError(f"columns of several dimensions: {sorted(repeated)}")
    kinds = {c: d for t in tables for c, d in t.dtypes}
    wide = [t.select(*key, *[F.col(c) if c in t.columns else F.lit(None).cast(kinds[c]).alias(c) for c in columns]) for t in tables]
    every = wide[0]
    for t in wide[1:]:
        every = every.unionByName(t)
    return every.groupBy(*key).agg(*[F.max(c).alias(c) for c in columns])


def annotated(records: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record and alternative, under COLUMNS, with ``place`` and ``at`` (the alternative's number) behind them.

    records: file, place, chrom, pos, ref, alt, filter, info, as variants.SCHEMA has them. An alternative's reference and text go without
    what they end with alike, and are so looked up. Numbers that a database does not have are 0, texts empty. Records at the
    reference's spacer, or without an alternative, give none.
    """
    alts = records.where("alt <> '.'").select("file", "place", "chrom", "pos", "filter", al.info_map(F.col("info")).alias("i"), "ref", F.posexplode(F.split("alt", ",")).alias("at", "alt"))
    rows = al.suffix_trimmed(alts)
    by_variant = durable(merged([f(spark, folder) for f in BY_VARIANT], VARIANT))
    by_position = durable(merged([f(spark, folder) for f in BY_POSITION], ["pos"]))
    joined = rows.join(by_position.where("trinucleotide IS NOT NULL"), "pos").join(by_variant, VARIANT, "left").join(dbsnp(spark, folder), ["chrom", *VARIANT], "left")
    words = lambda name, column: text.first_column(spark, f"{folder}/{FILES[name]}").select(F.col("value").alias(column)).distinct()
    joined = joined.withColumn("v", F.concat("ref", "pos", "alt")).join(words("phylotree", "v").withColumn("p", F.lit(1)), "v", "left")
    bridges = words("bridges", "b").select(F.col("b").try_cast("int").alias("pos"), F.lit("Yes").alias("bridge")).where("pos IS NOT NULL")
    joined = joined.join(bridges, "pos", "left")
    places = joined.select("pos").distinct()
    ranked = loci(spark, folder).withColumn("k", F.lit(0))
    located = intervals.first_containing(places.withColumn("k", F.lit(0)), ranked, "pos", ["k"], "mitomap_locus").select("pos", "mitomap_locus")
    joined = joined.join(located, "pos", "left")
    # the other species' bases along the reference, base by base
    spelled = joined.select("file", "place", "at", "pos", "ref").withColumn("x", F.explode(F.transform(F.split("ref", ""), lambda b, i: F.struct(i.alias("i"), b.alias("base"))))).where("x.base <> ''")
    looked = spelled.select("file", "place", "at", "x.i", "x.base", (F.col("pos") + F.col("x.i")).cast("int").alias("pos")).join(chimp(spark, folder), ["pos", "base"], "left")
    ancestral = looked.groupBy("file", "place", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("chimp_ref", F.lit("")).alias("c")))), lambda x: x["c"]), "").alias("chimp_ref"))
    joined = joined.join(ancestral, ["file", "place", "at"], "left")
    of = lambda k: F.coalesce(F.get(F.split(F.element_at("i", F.lit(k)), ","), F.col("at")), F.lit(""))
    fixed = {"CHROM": F.col("chrom"), "POS": F.col("pos").cast("string"), "ID": F.coalesce("ID", F.lit(".")), "REF": F.col("ref"), "ALT": F.col("alt"), "FILTER": F.col("filter"), "VAF_MEAN": of("VAF_MEAN"), "VAF_MEAN_HET": of("VAF_MEAN_HET"), **{k: F.coalesce(F.element_at("i", F.lit(k)), F.lit("")) for k in ("AN", "REF_N", "HET_N", "HOM_N", "PT")}, "in_phylotree": F.coalesce(F.col("p").cast("string"), F.lit("0")), "rRNA_bridge_base": F.coalesce("bridge", F.lit("No"))}
    values = [fixed[c] if c in fixed else F.coalesce(c, F.lit("0" if c in ZERO else "")) for c in COLUMNS]
    return joined.select(*[v.alias(c) for v, c in zip(values, COLUMNS, strict=True)], "file", "place", "at")


def with_annotations(records: DataFrame, table: DataFrame) -> DataFrame:
    """records with the identifiers and INFO fields of their alternatives (of annotated): lists where the alternatives have values of
    their own. Records that the table lacks stay out, as those at the spacer do."""
    one = {"trinucleotide", "mitomap_locus", "phyloP_score", "tRNA_position", "tRNA_domain", "RNA_base_type", "RNA_modified", "rRNA_bridge_base", "uniprot_annotation", "other_prot_annotation", "chimp_ref"}
    own = table.groupBy("file", "place").agg(F.array_sort(F.collect_list(F.struct("at", "ID", *INFO))).alias("a"))

    def listed_values(c: str) -> Column:
        values = F.transform("a", lambda x: x[c])
        return F.array_join(F.filter(values, lambda v: v != "") if c == "symbol" else values, ",")

    texts = [F.concat(F.lit(f"{c}="), F.get("a", F.lit(0))[c] if c in one else listed_values(c)) for c in INFO]
    ids = F.array_join(F.filter(F.transform("a", lambda x: x["ID"]), lambda v: v != "."), ";")
    joined = records.join(own, ["file", "place"])
    return joined.withColumns({"id": F.when(ids == "", ".").otherwise(ids), "info": F.concat_ws(";", "info", *texts)}).select(*records.columns)
