"""Queries and their SQL side by side, over views that bring the driver's tables into the shapes of the domain.

Views are lists of expressions that Spark and DuckDB both read; a query names the views it uses in its SQL, and the SQL
that is handed out carries those views as common table expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Four features of an embedding: sums of its quarters.
_FOUR_SUMS = ", ".join(" + ".join(f"CAST(element_at(embedding, {16 * i + j}) AS DOUBLE)" for j in range(1, 17)) for i in range(4))
#: view: (source, expressions, condition)
VIEWS: dict[str, tuple[str, list[str], str]] = {
    "vectors": ("embeddings", ["vec_id", "label % 3 = 0 AS truth", f"array({_FOUR_SUMS}) AS features"], "true"),
    "pileup": ("lineitem", ["'1' AS contig", "CAST(l_partkey AS INT) AS pos", "concat('s', CAST(l_suppkey % 10 AS STRING)) AS sample", "l_returnflag AS allele", "CASE l_linestatus WHEN 'F' THEN '+' ELSE '-' END AS strand", "CAST(floor(l_quantity) AS INT) AS qual", "CAST(floor(l_discount * 600 + 0.5) AS INT) AS mapq", "l_orderkey AS read_id", "l_linenumber AS rank_in_read"], "true"),
    "reads": ("orders", ["concat('s', CAST(o_custkey % 5 AS STRING)) AS sample", "concat('q', CAST(floor(o_orderkey / 2) AS STRING)) AS qname", "CAST((o_orderkey * 37) % 4096 AS INT) AS flag", "concat('chr', CAST(o_custkey % 7 AS STRING)) AS rname", "CAST(o_orderkey % 16000 AS INT) AS pos", "CAST(o_custkey % 61 AS INT) AS mapq", "concat('chr', CAST((o_custkey + (o_orderkey % 3)) % 7 AS STRING)) AS rnext", "CASE o_orderkey % 6 WHEN 0 THEN '10M' WHEN 1 THEN '5M2I5M' WHEN 2 THEN '4S8M' WHEN 3 THEN '6M3D6M' WHEN 4 THEN '3M1I2M1D4M' ELSE '2H6M2S' END AS cigar", "substring('ACGTTGCAACGTNACGTAGC', 1 + CAST(o_orderkey % 6 AS INT), CASE o_orderkey % 6 WHEN 0 THEN 10 WHEN 1 THEN 12 WHEN 2 THEN 12 WHEN 3 THEN 12 WHEN 4 THEN 10 ELSE 8 END) AS seq", "substring('ABCDEFGHIJKLMNOPQRST', 1 + CAST(o_orderkey % 6 AS INT), CASE o_orderkey % 6 WHEN 0 THEN 10 WHEN 1 THEN 12 WHEN 2 THEN 12 WHEN 3 THEN 12 WHEN 4 THEN 10 ELSE 8 END) AS qual", "o_orderkey AS read_id"], "true"),
    "pedigree": ("customer", ["concat('F', CAST(c_nationkey AS STRING)) AS fam", "CAST(c_custkey AS STRING) AS child", "CAST(CAST(floor(c_custkey / 3) AS BIGINT) AS STRING) AS father", "CAST(CAST(floor(c_custkey / 2) AS BIGINT) AS STRING) AS mother", "c_custkey AS line"], "true"),
    "pairs": ("lineitem", ["CAST(l_partkey % 16569 + 1 AS INT) AS pos", "concat('F', CAST(l_suppkey % 7 AS STRING)) AS fam", "concat('M', CAST(l_suppkey % 50 AS STRING)) AS mother", "concat('C', CAST(l_orderkey % 97 AS STRING)) AS child", "CAST(floor(l_quantity) * 20 AS INT) AS m_dp", "CAST(floor(floor(l_quantity) * 20 * (0.02 + l_discount * 9)) AS INT) AS m_alt", "CAST(100 + floor(l_tax * 1000 + 0.5) AS INT) AS c_dp", "CAST(floor((100 + floor(l_tax * 1000 + 0.5)) * greatest(0.0, least(1.0, 0.02 + l_discount * 9 + (l_partkey % 41 - 20) / 100.0))) AS INT) AS c_alt", "CASE WHEN l_linenumber = 7 THEN 'LOW_DEPTH' ELSE 'PASS' END AS qc", "l_orderkey AS row_a", "CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) * 10 + l_linenumber AS row_b"], "true"),
    "regions": ("part", ["concat('chr', CAST(p_partkey % 5 AS STRING)) AS chrom", "CAST(p_partkey * 7 AS BIGINT) AS s", "CAST(p_partkey * 7 + p_size AS BIGINT) AS e", "p_partkey AS region_id"], "true"),
    "contigs": ("nation", ["concat('chr', CASE n_nationkey WHEN 24 THEN 'M' ELSE CAST(n_nationkey + 1 AS STRING) END) AS contig", "CAST(n_nationkey AS BIGINT) AS nation", "CAST(1000000 + 1000 * n_nationkey AS BIGINT) AS length"], "true"),
    "alts": ("part", ["CAST(p_partkey AS INT) AS pos", "substring('ACGTACGTTGCA', 1 + CAST(p_partkey % 5 AS INT), 1 + CAST(p_size % 4 AS INT)) AS ref", "substring('ACGTACGTTGCA', 1 + CAST(p_partkey % 5 AS INT) + CAST(p_partkey % 2 AS INT), 1 + CAST(floor(p_size / 4) % 4 AS INT)) AS alt", "p_size AS size", "p_retailprice AS score"], "true"),
    "segments": ("documents", ["doc_id", "text AS seq", "source", "lang"], "text IS NOT NULL AND length(text) > 0"),
    "strands": ("lineitem", ["CAST(l_partkey AS INT) AS pos", "l_returnflag AS allele", "CAST(count(CASE WHEN l_linestatus = 'F' THEN 1 END) AS INT) AS fwd", "CAST(count(CASE WHEN l_linestatus = 'O' THEN 1 END) AS INT) AS rev", "CAST(count(*) AS INT) AS depth"], "true GROUP BY l_partkey, l_returnflag"),
    "calls": ("pileup", ["pos", "sample", "allele", "CASE allele WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS idx", "CAST(count(*) AS INT) AS ad", "CAST(sum(count(*)) OVER (PARTITION BY pos, sample) AS INT) AS dp", "CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER (PARTITION BY pos, sample) AS DOUBLE) AS af", "CAST(avg(qual) AS DOUBLE) AS aq"], "true GROUP BY pos, sample, allele"),
    "genotyped": ("calls", ["pos", "sample", "allele", "idx", "ad", "dp", "af", "aq", "count(*) OVER (PARTITION BY pos, sample) AS ploidy", "min(idx) OVER (PARTITION BY pos, sample) AS low", "max(idx) OVER (PARTITION BY pos, sample) AS high"], "af >= 0.2"),
}
TABLES = ("lineitem", "orders", "customer", "supplier", "part", "nation", "region", "events", "documents", "embeddings", "labels", "benchmark")


class Views:
    """Tables and views of one scale, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in VIEWS:
            raise AttributeError(name)
        source, expressions, condition = VIEWS[name]
        self_view = f"mitoloom_{source}"
        getattr(self, source).createOrReplaceTempView(self_view)
        return self.spark.sql(f"SELECT {', '.join(expressions)} FROM {self_view} WHERE {condition}")

    def placed(self, name: str) -> DataFrame:
        """A view of one table, without groups, plus file and row: where each row lies in the table."""
        source, expressions, condition = VIEWS[name]
        rows = getattr(self, source).selectExpr("*", "_metadata.file_path AS file", "_metadata.row_index AS row")
        return rows.where(condition).selectExpr(*expressions, "file", "row")


def _with(sql: str) -> str:
    """The SQL with the views that it names, and theirs, put before it."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text):
                need(f"FROM {VIEWS[name][0]} ")
                needed.append(name)

    need(sql)
    views = ", ".join(f"{n} AS (SELECT {', '.join(VIEWS[n][1])} FROM {VIEWS[n][0]} WHERE {VIEWS[n][2]})" for n in needed)
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH"):
        body = re.sub(r"^WITH(\s+RECURSIVE)?\s+", ", " if views else "", body, flags=re.IGNORECASE)
        return f"WITH {'RECURSIVE ' * recursive}{views}{body}"
    return f"WITH {views} {body}" if views else body


def query(name: str, sql: str | None = None):
    """Registers a function of Views under a name, with its SQL where SQL can express it."""

    def register(function: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: function(Views(spark, sf_dir))
        if sql:
            ORACLES[name] = _with(sql)
        return function

    return register
