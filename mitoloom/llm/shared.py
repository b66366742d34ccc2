"""Session helpers: the folder all executors share, durable cuts of lineage, safe column picks."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where that is unset and all tasks run on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="mitoloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """Any store that pyarrow knows (file, hdfs, s3, gs); the folder must be one that all executors see."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and forgets its lineage; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a compressed table in the shared folder: for what is large and read several times, a column or two each."""
    folder = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.parquet(folder)


def discard(df: DataFrame) -> None:
    """Deletes the files of a stored table that no later step reads."""
    spark = df.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_finished(spark: SparkSession, turns: int = 1) -> None:
    """Lets Spark's cleaner find the shuffle files and checkpoints of finished steps now, not when the driver's heap fills up.

    The pauses are for the threads that hear of it: the one that lets go of what Python has dropped, and the cleaner. Shuffles
    under a plan of several joins are found by the second turn only.
    """
    for _ in range(turns):
        gc.collect()
        time.sleep(0.3)
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that extra columns cannot clash."""
    return df.select([df[source].alias(name) for name, source in columns.items()])


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one where df has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bucket(column, modulus: int):
    """crc32 of an id's decimal text, modulo ``modulus``; null ids count as 1, so they are never held out."""
    return F.coalesce(F.crc32(F.encode(column.cast("string"), "UTF-8")) % modulus, F.lit(1))
