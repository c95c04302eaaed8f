"""The corpus pipeline: documents are filtered and deduplicated in stages, then encoded.

Each stage takes (spark, docs, sf_dir), with docs as it was read from Parquet files, and works on
all that the stage before kept; `run` writes every stage's result as Parquet in the shared
folder and reads it again, so a lost executor costs tasks of one stage and no more. When a stage's result is there, the result that
it was made from goes, and all that it left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftwell.llm import decontamination, exact_dedup, jaccard_join, piece_bpe, quality
from driftwell.llm.workspace import forget, located, scratch, stored


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality: documents that the Kneser-Ney model rejects go."""
    return quality.keep_good(located(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts one stays."""
    return exact_dedup.deduplicate(located(docs))


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each component of near copies the smallest id stays."""
    return jaccard_join.keep_one(located(docs))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decontamination: documents that hold a benchmark window go."""
    return decontamination.drop_contaminated(located(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece: what is left, as digests of its ids and of their decoded text."""
    return piece_bpe.round_trip_digests(docs)


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("jaccard_join", keep_one_of_near),
    ("decontamination", drop_leaks),
    ("sentencepiece", encode),
]

#: The quality model and SentencePiece are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark):
            kept = stored(stage(spark, docs, sf_dir), f"stage-{name}", {"compression": "zstd"}, keep=True)
        forget(docs)
        docs = kept
    return docs
