"""The opN_ queries: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import conversations, decontamination, fingerprints, lines, lm, neardup, packing, pages, quality, substrings, toxicity, urls, whitening
from tessera.llm import textkit as K


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(spark, K.documents(spark, sf_dir), K.documents(spark, sf_dir, "labels"), folds=3, held=1, cut=0.7)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(spark, K.documents(spark, sf_dir), shortest=1)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_dedup(spark, K.documents(spark, sf_dir), length=50)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filtered(spark, K.documents(spark, sf_dir, "pages")).drop("score")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(spark, K.documents(spark, sf_dir), K.documents(spark, sf_dir, "benchmark")).drop("spans")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(spark, K.documents(spark, sf_dir), K.documents(spark, sf_dir, "labels"), folds=5, held=0, cut=0.3, metadata=("n_chars",))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark, K.documents(spark, sf_dir), width=5, percent=75)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.document_fingerprints(spark, K.documents(spark, sf_dir))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.backoff_scores(spark, K.documents(spark, sf_dir), order=3)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, K.documents(spark, sf_dir), tokenizer_path(), capacity=2048, end_id=0)


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extracted(K.documents(spark, sf_dir, "pages").select("page_id", "url", "html"), "html")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(conversations.damaged(K.documents(spark, sf_dir, "conversations"))).drop("roles")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(spark, K.documents(spark, sf_dir, "embeddings"), components=16)


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_line_dedup": op2_line_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_decontamination": op5_decontamination,
    "op6_quality": op6_quality,
    "op7_minhash": op7_minhash,
    "op8_fingerprints": op8_fingerprints,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_packing": op10_packing,
    "op11_html_extraction": op11_html_extraction,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_whitening": op13_whitening,
}
ORACLE_SQL: dict[str, str] = {
    "op4_url_filter": urls.sql(),
    "op9_lm_scoring": lm.sql(order=3),
    "op12_conversation_repair": conversations.sql(),
}
