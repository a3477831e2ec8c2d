"""The corpus pipeline: quality classifier, line dedup, near dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the
last return the columns of documents. A stage's result is written as Parquet in the folder that
driver and executors share and read again, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, lines, neardup, packing, quality
from tessera.llm import textkit as K
from tessera.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the classifier learns from the labels of the documents that there are."""
    return quality.accepted(spark, docs, K.documents(spark, sf_dir, "labels"), folds=5, held=0, cut=0.3)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines within one edit of an earlier line go, short ones if they equal an earlier line.

    A document goes with them only if no word is left. Nulls, repeated rows and ties: as in
    lines.deduplicated. n_chars follows the text; it must be there.
    """
    count = K.unused("lines_removed_", docs.columns)
    out = lines.deduplicated(spark, docs, shortest=1, removed=count)
    touched = F.col(count) > 0
    stays = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.filter(~touched | stays).withColumn("n_chars", F.when(touched, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least doc_id.

    Rows of one doc_id stay or go together; rows without doc_id, and texts without words, stay.
    """
    gone = K.settled(spark, lambda: neardup.near_duplicates(spark, docs, width=5, percent=75).filter("not kept").select("doc_id").distinct(), "near_gone")
    maybe = F.coalesce(K.sieve(gone, "doc_id")(F.col("doc_id").cast("long")), F.lit(False))
    return docs.filter(~maybe).union(docs.filter(maybe).join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontamination.clean(spark, docs, K.documents(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of 2048 ids."""
    return packing.pack(spark, docs, tokenizer_path(), capacity=2048, end_id=0)


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("best_fit_packing", packing_stage),
]

#: The stages are beyond SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = K.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = K.settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
