"""Mixing sources to target weights: sizes by source, water-filled targets, repeated and hash-sampled copies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mitoloom.llm.shared import unused

#: Columns that the mix adds.
OWN = ("size", "source_size", "target", "copies", "taken")
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sized: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """source, source_size, target from rows (source, size).

    Sources take the weights in turn, by code point, null last. A target is weight * level, or cap * source_size where that is
    less; level is the one at which the targets sum to the whole size. That is what resharing the excess by weight, again and
    again until none is above its cap, comes to; here it is a running sum over sources in order of cap / weight.
    """
    sums = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pattern = F.array(*[F.lit(int(w)) for w in weights])
    ranked = sums.withColumn("weight", F.element_at(pattern, (rank % len(weights)).cast("int") + 1)).withColumn("most", F.lit(cap) * F.col("source_size"))
    upto = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(upto), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0)))
    stepped = ranked.withColumn("level", level)
    # levels fall from the first source whose cap lies at or above its level; that highest one is the common level
    found = stepped.withColumn("final", F.max(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))).over(everything))
    target = F.when(F.col("final").isNull() | (F.col("final") * F.col("weight") > F.col("most")), F.col("most").cast("double")).otherwise(F.col("final") * F.col("weight"))
    return found.select("source", "source_size", target.cast("double").alias("target"))


def draw(key, seed: str):
    """A number in [0, 1) with 52 bits, from the md5 of the seed and the key; a null key counts as empty."""
    digest = F.md5(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), "UTF-8"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix_sources(df: DataFrame, *, weights: Sequence[int] = (5, 2, 1), cap: int = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """df's rows with size, source_size, target, copies (how often the mix takes the row) and taken (size * copies).

    Rate = target / source_size, at most ``cap``; a document is taken floor(rate) times, and once more if its hash-seeded draw
    lies below the fraction. Draws depend on the seed and the id alone: reruns agree and rows that repeat an id go together.
    A null text has size 0; a source without words has target 0 and none of its documents are taken. No rows give no rows.
    Existing columns of those five names are replaced. The join is on the source, null-safe; the table of sources is one row a
    source, so Spark broadcasts it when it is small and splits hot sources when it is not.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    base = df.drop(*[c for c in OWN if c not in (id_col, text_col, source_col)])
    targets = source_targets(base.select(F.col(source_col).cast("string").alias("source"), size.alias("size")), weights, cap)
    targets = targets.select(F.col("source").alias("__source"), "source_size", "target")
    joined = base.withColumn("size", size).join(targets, F.col(source_col).cast("string").eqNullSafe(F.col("__source")), "left").drop("__source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = (F.floor(rate) + F.when(draw(F.col(id_col), seed) < rate - F.floor(rate), 1).otherwise(0)).cast("long")
    return joined.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))


def repeated(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The mix itself: each row as often as ``copies`` says."""
    copy = unused(mixed, "__copy")
    return mixed.where("copies > 0").select(*columns, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(copy)).drop(copy)


def taken_mix(df: DataFrame, **options) -> DataFrame:
    """df's rows as often as the mix takes them, with df's own columns, also those that mix_sources would replace."""
    held = {c: unused(df, f"__{c}") for c in df.columns if c in OWN}
    taken = repeated(mix_sources(df.withColumnsRenamed(held), **options), [held.get(c, c) for c in df.columns])
    return taken.withColumnsRenamed({name: c for c, name in held.items()})


ORACLE = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size AS most, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(most) OVER w, 0) AS DOUBLE) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS level
  FROM r WINDOW w AS (ORDER BY most / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, max(CASE WHEN level * weight <= most THEN level END) OVER () AS final FROM l),
t AS (SELECT source, source_size, CASE WHEN final IS NULL OR final * weight > most THEN CAST(most AS DOUBLE) ELSE final * weight END AS target FROM f),
j AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
  CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM j
"""
