"""The corpus pipeline: five stages over `documents`, each written as Parquet and read as the next one's docs.

quality rules -> near duplicates -> benchmark decontamination -> personal data -> packing. Every stage
takes (spark, docs, sf_dir); all but the last return the columns of documents, n_chars being that of the
text as it then is. Rows are never sampled or capped. What stays is decided for each row, not by its id, so
rows with a null or a repeated id are treated like all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import decontamination, near_duplicates, packing, pii, quality
from barline.llm.common import ROW, numbered, spool, table, without


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    rows = numbered(docs)
    scored = quality.score(rows, table(spark, sf_dir, "labels"), row_col=ROW)
    return without(rows, scored.where("NOT kept").select(F.col("row").alias(ROW)))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) one document stays."""
    return near_duplicates.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of words with a benchmark item go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is masked."""
    return pii.mask(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts as pieces in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("personal_data", pii_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can't express the classifier, tokenizer and model stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order; each one's rows are stored in the shared folder before the next begins."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
