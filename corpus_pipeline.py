"""Curation of ``documents`` in stages, each by one operator of tableworks.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tableworks.llm import minhash, mixing, passages, pieces, quality
from tableworks.session import scratch_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit the quality classifier on the labelled documents and keep those that it accepts."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.classify(docs, model).where("predicted = 1").select("row.*")


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    return minhash.deduplicated(docs)


def distinct_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages out that another document has too."""
    return passages.deduplicated(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Hold back a source or language with far more than its even share of tokens; all other documents stay."""
    targets, kept = mixing.held_back(docs)
    return mixing.mix(docs, *targets, kept=kept).where("sampled").select("row.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left."""
    return pieces.encode(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", distinct_documents),
    ("substring dedup", distinct_passages),
    ("mixing to target weights", mixed),
    ("SentencePiece encoding", encoded),
]
#: Learned models and approximate candidate search are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; every stage's result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return result
        path = scratch_path(spark, f"stage-{name.replace(' ', '-')}")
        result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
    return docs
