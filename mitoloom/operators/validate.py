"""Format checks as rule columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def broken_rules(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rows, once for each rule whose condition holds, with its name in ``rule``."""
    names = F.array(*[F.when(condition, F.lit(name)) for name, condition in rules.items()])
    return rows.withColumn("rule", F.explode(F.filter(names, lambda x: x.isNotNull())))


def record_rules() -> dict[str, Column]:
    """Rules of a VCF body line, over string columns chrom, pos, ref, alt, qual, filter, format, sample."""
    return {
        "CHROM": F.col("chrom").isNull() | (F.col("chrom") == ""),
        "POS": F.col("pos").try_cast("int").isNull() | (F.col("pos").try_cast("int") < 0),
        "REF": ~F.coalesce(F.col("ref").rlike("^[ACGTNacgtn]+$"), F.lit(False)),
        "ALT": ~F.coalesce(F.col("alt").rlike(r"^(\.|[ACGTNacgtn*]+|<[^<>]+>)(,([ACGTNacgtn*]+|<[^<>]+>))*$"), F.lit(False)),
        "QUAL": (F.col("qual") != ".") & (F.col("qual").try_cast("double").isNull() | (F.col("qual").try_cast("double") < 0)),
        "FORMAT": ~F.coalesce(F.col("format").rlike("^GT(:[A-Za-z0-9_]+)*$"), F.lit(False)),
        "FIELDS": F.size(F.split("sample", ":")) > F.size(F.split("format", ":")),
    }


def header_fields(line: Column) -> Column:
    """Keys and values of ``##KIND=<k=v,k="quoted, value">``."""
    body = F.regexp_extract(line, r"^##\w+=<(.*)>$", 1)
    pattern = F.lit(r'(\w+)=("[^"]*"|[^,]*)')
    return F.map_from_arrays(F.regexp_extract_all(body, pattern, F.lit(1)), F.transform(F.regexp_extract_all(body, pattern, F.lit(2)), lambda x: F.btrim(x, F.lit('"'))))
