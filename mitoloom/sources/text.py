"""Readers of the domain's text formats, by Spark's own text and CSV readers, which split large files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VCF_COLUMNS = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format")
SAM_COLUMNS = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the files' lines, read by splits; gzip and BGZF are read as well, a file a task.

    ``line`` orders a file's lines and tells them apart: the split's place in the file, and the line's number in the task.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), place.alias("line"), "value")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(contig, length, sequence): names end at the first white space; lines of a contig are joined in order.

    A line belongs to the last name before it: in its split or, where there is none, in the splits before, of which one row each is
    put in order. Lines before any name are left out.
    """
    rows = lines(spark, path).where("value <> ''")
    heads = F.startswith("value", F.lit(">"))
    name = F.when(heads, F.struct("line", F.regexp_extract("value", r"^>(\S*)", 1).alias("contig")))
    here = Window.partitionBy("file", "line.split").orderBy("line.row")
    marked = rows.withColumns({"split": F.col("line.split"), "own": F.last(name, ignorenulls=True).over(here)})
    ends = rows.groupBy("file", F.col("line.split").alias("split")).agg(F.max(name).alias("end"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("file", "split", F.last("end", ignorenulls=True).over(before).alias("carried"))
    named = marked.where(~heads).join(carried, ["file", "split"]).withColumn("name", F.coalesce("own", "carried")).where("name IS NOT NULL")
    sequence = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.trim("value").alias("value")))), lambda x: x["value"]), "")
    return named.groupBy("file", "name").agg(sequence.alias("sequence")).select("name.contig", F.length("sequence").alias("length"), "sequence")


def reference_bases(contigs: DataFrame) -> DataFrame:
    """(contig, pos 1-based, ref) from fasta()."""
    bases = F.posexplode(F.split(F.upper("sequence"), "")).alias("__i", "ref")
    return contigs.select("contig", bases).where("ref <> ''").select("contig", (F.col("__i") + 1).alias("pos"), "ref")


def region_of(contigs: DataFrame, contig: str, start: int, end: int) -> DataFrame:
    """(sequence) of a closed 1-based region."""
    return contigs.where(F.col("contig") == contig).select(F.substring("sequence", start, end - start + 1).alias("sequence"))


def sample_of_path(path: Column) -> Column:
    """A file's name up to its first point."""
    return F.regexp_extract(path, r"([^/.]*)[^/]*$", 1)


def sam(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(reads, headers) of text SAM files. Reads carry sample (SM of the first @RG line; without one
    they raise), 0-based pos and a map of tags."""
    rows = lines(spark, path).where("value <> ''")
    headers = rows.where(F.startswith("value", F.lit("@")))
    groups = headers.where(F.startswith("value", F.lit("@RG"))).groupBy("file").agg(F.min_by(F.regexp_extract("value", r"\tSM:([^\t]+)", 1), "line").alias("sm"))
    body = rows.where(~F.startswith("value", F.lit("@"))).withColumn("f", F.split("value", "\t"))
    fields = [F.get("f", F.lit(i)).alias(n) for i, n in enumerate(SAM_COLUMNS)]
    tags = F.slice("f", 12, F.greatest(F.size("f") - 11, F.lit(0)))
    split = body.select("file", *fields, F.map_from_arrays(F.transform(tags, lambda t: F.substring(t, F.lit(1), F.lit(2))), F.transform(tags, lambda t: F.substring(t, F.lit(6), F.length(t)))).alias("tags"))
    numbers = {c: F.col(c).try_cast("int") for c in ("flag", "pos", "mapq", "pnext", "tlen")}
    reads = split.withColumns(numbers).withColumn("pos", F.col("pos") - 1).join(groups, "file", "left")
    named = reads.withColumn("sample", F.coalesce(F.nullif("sm", F.lit("")), F.raise_error(F.concat(F.lit("no @RG line with a sample (SM) in "), "file"))))
    rnext = F.when(F.col("rnext") == "=", F.col("rname")).otherwise(F.col("rnext"))
    return named.withColumn("rnext", rnext).select("sample", *SAM_COLUMNS, "tags"), headers.select("file", "line", "value")


def in_region(records: DataFrame, contig: str, start: int, end: int) -> DataFrame:
    """Records (chrom, pos, ref) that meet a closed 1-based region with any of their reference's bases.

    The reader splits the file and the filter is applied in each split; without an index nothing is skipped.
    """
    return records.where((F.col("chrom") == contig) & (F.col("pos") <= end) & (F.col("pos") + F.greatest(F.length("ref"), F.lit(1)) - 1 >= start))


def contigs_of(headers: DataFrame) -> DataFrame:
    """(contig, length) of @SQ lines."""
    rows = headers.where(F.startswith("value", F.lit("@SQ")))
    return rows.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("contig"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("long").alias("length")).distinct()


def vcf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, headers): a row for each record and sample with the FORMAT fields as a map; record is file and line."""
    rows = lines(spark, path).where("value <> ''")
    headers = rows.where(F.startswith("value", F.lit("##")))
    names = rows.where(F.startswith("value", F.lit("#CHROM"))).select("file", F.slice(F.split("value", "\t"), 10, 1 << 30).alias("samples"))
    body = rows.where(~F.startswith("value", F.lit("#"))).withColumn("f", F.split("value", "\t")).join(names, "file")
    fixed = [F.get("f", F.lit(i)).alias(n) for i, n in enumerate(VCF_COLUMNS)]
    wide = body.select("file", "line", *fixed, F.arrays_zip(F.col("samples").alias("sample"), F.slice("f", 10, F.greatest(F.size("f") - 9, F.lit(0))).alias("value")).alias("s"))
    long = wide.withColumn("s", F.explode_outer("s"))
    keys, values = F.split("format", ":"), F.split("s.value", ":")
    fields = F.map_from_arrays(F.slice(keys, F.lit(1), F.least(F.size(keys), F.size(values))), F.slice(values, F.lit(1), F.least(F.size(keys), F.size(values))))
    records = long.select(F.struct("file", "line").alias("record"), "chrom", F.col("pos").try_cast("int").alias("pos"), "id", "ref", F.when(F.col("alt") == ".", F.array().cast("array<string>")).otherwise(F.split("alt", ",")).alias("alts"), F.col("qual").try_cast("double").alias("qual"), "filter", "info", F.col("s.sample").alias("sample"), F.when(F.col("s.value").isNotNull() & F.col("format").isNotNull(), fields).alias("fields"))
    return records, headers.select("file", "line", "value")


def numbers(field: Column, kind: str = "int", by: str = ",") -> Column:
    """A list-valued FORMAT field; missing entries are null."""
    return F.transform(F.split(field, by), lambda x: x.try_cast(kind))


def fam(spark: SparkSession, path: str) -> DataFrame:
    from mitoloom.operators.pedigree import parse_fam

    return parse_fam(lines(spark, path))


def pair_table(spark: SparkSession, path: str) -> DataFrame:
    """A transmission-pair TSV with a header; `#` lines are skipped, all columns stay text."""
    return spark.read.csv(path, sep="\t", header=True, comment="#")


def first_column(spark: SparkSession, path: str) -> DataFrame:
    """(value) of list files: the first word of each line that is neither empty nor a comment."""
    text = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(value, '#')")
    return text.select(F.get(F.split(F.trim("value"), r"\s+"), F.lit(0)).alias("value"))


def regions(tokens: DataFrame, contigs: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Region tokens (value: ``chr``, ``chr:start`` or ``chr:start-end``) as chrom, s, e, 1-based and closed.

    Open ends are the contig's length where ``contigs`` knows it. A start of 0 counts as 1. Broken tokens and starts beyond
    ends raise in the strict form; else they give rows with null s and e.
    """
    text = F.trim("value")
    chrom, span = F.trim(F.split_part(text, F.lit(":"), F.lit(1))), F.trim(F.split_part(text, F.lit(":"), F.lit(2)))
    start, end = F.trim(F.split_part(span, F.lit("-"), F.lit(1))), F.trim(F.split_part(span, F.lit("-"), F.lit(2)))
    rows = tokens.where(text != "").select(chrom.alias("chrom"), F.when(start == "", F.lit(1).cast("bigint")).otherwise(start.try_cast("bigint")).alias("s"), F.when(end == "", F.lit((1 << 32) - 1).cast("bigint")).otherwise(end.try_cast("bigint")).alias("e"))
    if contigs is not None:
        rows = rows.join(contigs.select(F.col("contig").alias("chrom"), "length"), "chrom", "left").withColumn("e", F.least("e", F.coalesce("length", F.col("e")))).drop("length")
    rows = rows.withColumn("s", F.greatest("s", F.lit(1).cast("bigint")))
    bad = F.col("s").isNull() | F.col("e").isNull() | (F.col("s") > F.col("e")) | (F.col("chrom") == "")
    if strict:
        return rows.withColumn("s", F.when(bad, F.raise_error(F.concat(F.lit("bad region on "), "chrom"))).otherwise(F.col("s")))
    return rows.withColumns({c: F.when(~bad, F.col(c)) for c in ("s", "e")})


def region_list(spark: SparkSession, text: str) -> DataFrame:
    """Tokens of a comma-separated argument."""
    return spark.createDataFrame([(text,)], "value string").select(F.explode(F.split("value", ",")).alias("value"))


def bed(spark: SparkSession, path: str) -> DataFrame:
    """BED lines (0-based, half-open) as closed 1-based regions."""
    rows = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(value, '#') AND NOT startswith(value, 'track') AND NOT startswith(value, 'browser')").select(F.split(F.trim("value"), r"\s+").alias("f"))
    return rows.select(F.get("f", F.lit(0)).alias("chrom"), (F.get("f", F.lit(1)).cast("bigint") + 1).alias("s"), F.get("f", F.lit(2)).cast("bigint").alias("e"))


def with_metadata(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(metadata key and value, body lines with numbers) of files whose head is ``#key=value`` lines."""
    rows = lines(spark, path).where("value <> ''")
    meta = rows.where(F.startswith("value", F.lit("#")))
    pairs = meta.select(F.trim(F.regexp_extract("value", r"^#+([^=:]+)[=:](.*)$", 1)).alias("key"), F.trim(F.regexp_extract("value", r"^#+([^=:]+)[=:](.*)$", 2)).alias("value")).where("key <> ''")
    return pairs, rows.where(~F.startswith("value", F.lit("#"))).select("file", "line", "value")


def commented_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file, as a row of ``schema`` (null fields where it lacks them), without the lines that begin with ``#``.

    A document is read whole, as one value; a file that is no JSON raises.
    """
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"(?m)^\s*#.*$", "").alias("value"))
    return whole.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def dimension(spark: SparkSession, path: str, columns: dict[str, int | str], key: list[str], sep: str = "\t", header: bool = False) -> DataFrame:
    """An annotation file as a table with a unique key: columns by place or header name; of repeated keys the first stays."""
    raw = spark.read.csv(path, sep=sep, header=header, comment="#")
    rows = raw.select(*[F.col(raw.columns[c] if isinstance(c, int) else c).alias(n) for n, c in columns.items()])
    return rows.dropDuplicates(key)
