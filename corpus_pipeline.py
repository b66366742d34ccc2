"""A corpus pipeline of five stages: toxicity, near duplicates, benchmark decontamination, source mix, token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mitoloom.llm import decontaminate, jaccard_join, mixing, token_files, toxicity
from mitoloom.llm.registry import vocabulary
from mitoloom.llm.shared import free_finished, new_folder, table

#: The last stage's files and the mix's draws are not SQL; tests hold each stage, on its own input, against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by a Jaccard similarity of 0.8 over five-word shingles."""
    return jaccard_join.keep_one(docs, width=5, num=80, den=100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item, also an edited one, go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is repeated as often as its source's target asks."""
    return mixing.taken_mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token files; returned is what the files hold of each document."""
    return token_files.token_output(docs, vocabulary())


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("mix", mix), ("token files", write_tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        free_finished(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
