"""A cleaning pipeline over ``documents``; each stage is written as Parquet and reread by the next.

Every stage takes further columns and leaves their values alone, whatever their names; the secret scan changes ``text`` and
``n_chars`` alone. Null and empty texts pass all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import decontam, minhash, queries, secrets, sentencepiece, toxicity
from loomwork.llm._store import drop, later, written


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that the classifier rejects; the others keep all their columns."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    weights = toxicity.fit_toxicity(docs.select("doc_id", "text"), labels)
    return toxicity.reject_toxic(docs, weights)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group at similarity 0.8 of five-word shingles."""
    return minhash.deduplicate(docs, shingle=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that hold ten consecutive words of a benchmark item."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the secrets in the texts; ``n_chars`` follows."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else clean


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts."""
    return sentencepiece.encode_pieces(docs, queries.PIECES)


STAGES = [
    ("toxicity", toxic),
    ("minhash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("secret scans", secret_scan),
    ("sentencepiece", pieces),
]

#: No SQL expresses the classifier, nor the merges of the pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, path = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if before:
            drop(spark, before)
        before = path
    later(before)
    return docs
