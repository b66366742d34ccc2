"""Intervals: merging, clamping, chunks, overlap joins by exploded positions, joined sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mitoloom.operators.ordered import in_ranges, scanned


def merged(regions: DataFrame, by: list[str]) -> DataFrame:
    """Overlapping or adjacent closed intervals (s, e) as islands: by, s, e, n. Rows whose s or e is null are left out.

    Intervals lie in ranges of (by, s, e), so that one key of very many intervals is many tasks. The largest end so far is a maximum
    that is carried from range to range; as it is taken together with the key, it starts anew with each key. Islands that go over
    ranges have one number, as the count of their starts is carried on too.
    """
    order = [*(F.col(c) for c in by), F.col("s"), F.col("e")]
    rows = in_ranges(regions.where("s IS NOT NULL AND e IS NOT NULL").select(*by, "s", "e"), order)
    furthest = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)], "e")
    marked = scanned(rows, furthest, order, "__before", F.max, inclusive=False)
    same = F.col("__before").isNotNull()
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__before.k{i}"))
    flagged = marked.withColumn("__new", F.when(same & (F.col("s") <= F.col("__before.e") + 1), 0).otherwise(1))
    islands = scanned(flagged, F.col("__new"), order, "__island")
    return islands.groupBy(*by, "__island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("n")).drop("__island")


def chunks(regions: DataFrame, size: int) -> DataFrame:
    """Closed intervals in pieces of at most ``size`` positions."""
    at = F.explode(F.sequence(F.col("s"), F.col("e"), F.lit(size).cast("bigint")))
    return regions.withColumn("__at", at).withColumns({"s": F.col("__at"), "e": F.least(F.col("e"), F.col("__at") + size - 1)}).drop("__at")


def clamped(regions: DataFrame, contigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(regions cut to their contig, regions on unknown contigs)."""
    known = regions.join(contigs.select(F.col("contig").alias("chrom"), "length"), "chrom")
    cut = known.withColumns({"s": F.greatest("s", F.lit(1).cast("bigint")), "e": F.least("e", "length")}).where("s <= e")
    return cut, regions.join(contigs, regions["chrom"] == contigs["contig"], "left_anti")


def bins(low: Column, high: Column, width: int) -> Column:
    return F.sequence(F.floor(low / width), F.floor(high / width))


def binned_join(points: DataFrame, regions: DataFrame, point: str, by: list[str], width: int = 1024, how: str = "inner") -> DataFrame:
    """Points within closed intervals (s, e), as an equi join on bins of positions rather than a nested loop.

    Regions are listed under each bin they touch; a point has one bin, so no pair comes twice. ``how`` may be inner,
    left_semi or left_anti.
    """
    keyed = regions.withColumn("__bin", F.explode(bins(F.col("s"), F.col("e"), width)))
    placed = points.withColumn("__bin", F.floor(F.col(point) / width))
    p, r = placed.alias("p"), keyed.alias("r")
    same = F.col("p.__bin") == F.col("r.__bin")
    for name in by:
        same = same & (F.col(f"p.{name}") == F.col(f"r.{name}"))
    joined = p.join(r, same & F.col(f"p.{point}").between(F.col("r.s"), F.col("r.e")), how)
    return joined.drop("__bin")


def first_containing(points: DataFrame, regions: DataFrame, point: str, by: list[str], ident: str) -> DataFrame:
    """Each point with the containing interval of smallest start (then end, then id); null where there is none."""
    plain = points.select(*by, point).distinct()
    found = binned_join(plain, regions.drop(*[c for c in regions.columns if c in points.columns and c not in by]), point, by)
    best = found.groupBy(*[F.col(f"p.{c}").alias(c) for c in [*by, point]]).agg(F.min(F.struct("s", "e", F.col(f"r.{ident}"))).alias("__best"))
    return points.join(best, [*by, point], "left").withColumn(ident, F.col(f"__best.{ident}")).drop("__best")


def block_positions(beds: DataFrame) -> DataFrame:
    """Positions of BED12 blocks: s plus each offset, for each size."""
    blocks = beds.withColumn("__b", F.explode(F.arrays_zip("offsets", "sizes")))
    start = F.col("s") + F.col("__b.offsets")
    return blocks.withColumn("pos", F.explode(F.sequence(start, start + F.col("__b.sizes") - 1))).drop("__b")


def joined_sequence(segments: DataFrame, by: str, order: str, piece: str, spacer: int) -> DataFrame:
    """Segments in order, with a run of N between them."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, piece))), lambda x: x[piece])
    return segments.groupBy(by).agg(F.array_join(parts, "N" * spacer).alias("joined"))


def effective_lengths(contigs: DataFrame, regions: DataFrame) -> DataFrame:
    """contigs plus effective_length: positions covered by merged regions, the whole length where there are none at all."""
    covered = merged(regions, ["chrom"]).groupBy(F.col("chrom").alias("contig")).agg(F.sum(F.col("e") - F.col("s") + 1).alias("covered"))
    return contigs.join(covered, "contig", "left").withColumn("effective_length", F.coalesce("covered", F.lit(0))).drop("covered")
