"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mitoloom.llm import decontaminate, divergence, filter_audit, jaccard_join, language, line_dedup, mixing, quality, secrets, token_files, topk, toxicity, warc
from mitoloom.llm.shared import table


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The place of a public tokenizer's file; pass another path to the operators to use another."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document with the occurrence that is kept for its group of near lines."""
    return line_dedup.line_groups(table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of three-word shingles and its component at a similarity of 0.9."""
    return jaccard_join.jaccard_groups(table(spark, sf_dir, "documents"), width=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the token files hold of each document, read back from them."""
    return token_files.token_output(table(spark, sf_dir, "documents"), vocabulary())


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives hold of each page, read back from them."""
    return warc.warc_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of documents and benchmark items of which the one holds a copy of the other."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's target and the words that the mix takes."""
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its spans of secrets."""
    return secrets.scan_secrets(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7_secrets that SQL can express: those of the base patterns."""
    return op7_secrets(spark, sf_dir).drop("spans")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its toxicity."""
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all vectors for each vector whose id is divisible by 20."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its language."""
    return language.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its quality."""
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source's distance from the others of its language, and the terms that it uses more than the language."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each step of each order of the five filters removes, by language."""
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_jaccard_join, op3_token_output, op4_warc, op5_decontamination, op6_source_mix, op7_secrets, secrets_base, op8_toxicity, op9_topk, op10_language, op11_quality, op12_source_divergence, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard_join": jaccard_join.ORACLE, "op4_warc": warc.ORACLE, "op6_source_mix": mixing.ORACLE, "secrets_base": secrets.BASE_ORACLE, "op9_topk": topk.ORACLE, "op12_source_divergence": divergence.ORACLE, "op13_filter_audit": filter_audit.ORACLE}
