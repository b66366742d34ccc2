"""Order over whole tables without a single task: rows numbered and sums carried from range to range."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def durable(df: DataFrame) -> DataFrame:
    """df written to ``spark.checkpoint.dir``, so that what follows neither repeats it nor loses it with an executor.

    Where that is unset and all tasks run on this machine, to a temporary folder; on a cluster it must be set.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="mitoloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def dealt(df: DataFrame, *keys: Column | str) -> DataFrame:
    """df by keys in as many tasks as shuffles have partitions, however few its bytes: for rows that take Python long.

    Where df's rows lie by these very keys already, Spark leaves them, and then may put them in fewer tasks: give a hash of the keys.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def in_ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """df plus __range: rows lie in ranges of ``order``, numbered in that order, each sorted within.

    __range and the names that begin with it belong to this module: a column of such a name raises.
    """
    if taken := [c for c in df.columns if c.lower().startswith("__range")]:
        raise ValueError(f"columns of a reserved name: {taken}")
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return durable(ranged.withColumn("__range", F.spark_partition_id()))


def scanned(rows: DataFrame, value: Column, order: list[Column], name: str, fold: Callable[[str], Column] = F.sum, inclusive: bool = True) -> DataFrame:
    """rows of in_ranges plus ``name``: the sum (or ``fold``: max, min) of ``value`` over all rows before each, by ``order``, and
    its own with ``inclusive``; null where there is none.

    Ranges are folded first, in a row each; a range's rows then carry on from what those before come to.
    """
    marked = rows.withColumn("__range_v", value)
    ends = marked.groupBy("__range").agg(fold("__range_v").alias("__range_s"))
    before = fold("__range_s").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select("__range", before.alias("__range_b"))  # as many rows as ranges
    here = fold("__range_v").over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1))
    joined = marked.join(F.broadcast(ends), "__range").withColumn("__range_h", here)
    h, b = F.col("__range_h"), F.col("__range_b")
    both = h + b if fold is F.sum else F.when(h > b if fold is F.max else h < b, h).otherwise(b)
    out = F.when(h.isNull(), b).when(b.isNull(), h).otherwise(both)
    return joined.withColumn(name, out).drop("__range_v", "__range_b", "__range_h")


def running(df: DataFrame, value: Column, order: list[Column], name: str) -> DataFrame:
    """df plus ``name``: the sum of ``value`` over all rows up to each, by ``order``; rows that tie there follow one another."""
    return scanned(in_ranges(df, order), value, order, name).drop("__range")


def numbered(df: DataFrame, order: list[Column], name: str = "row") -> DataFrame:
    """df plus ``name``: 0, 1, ... by ``order``."""
    return running(df, F.lit(1), order, name).withColumn(name, F.col(name) - 1)


def every_nth(df: DataFrame, step: int, most: int, order: list[Column]) -> DataFrame:
    """The first of every ``step`` rows by ``order``, ``most`` at most."""
    place = F.col("__range_n")
    rows = scanned(in_ranges(df, order), F.lit(1), order, "__range_n").where(((place - 1) % step == 0) & (place <= step * most))
    return rows.drop("__range", "__range_n")
