"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the columns of
`documents`; the last returns packed pieces. Between stages rows are written as Parquet to the folder that the
cluster shares, so a lost executor costs only its own tasks.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.llm import decontamination, langid, packing, pii, simhash
from fieldglass.llm.common import remove, scratch


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents that the classifier rejects go, null texts and texts without a letter among them; with no
    labelled document all go. Repeated rows get the same decision."""
    rows = langid.sample(docs)
    return langid.keep_identified(docs, langid.train(rows) if rows else None)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: the smallest doc_id of each group stays (five-word shingles, similarity 0.8). Texts without a
    word are one group; rows with a null doc_id all stay, rows that share a doc_id stay or go together."""
    return simhash.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with a benchmark window go. Null and empty texts have none, neither have
    null or empty items; rows that share a doc_id go together."""
    return decontamination.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: surrogates in the texts, n_chars brought up to date (null for a null text). All rows stay."""
    return pii.redact(docs, cards="valid").withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: sum-of-squares windows of 2048 ids. A null or empty text is one end id; repeated rows are packed each."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), added=True)


STAGES = [
    ("language ID", identify),
    ("SimHash near-dedup", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("PII surrogates", pseudonymise),
    ("packing", pack),
]

#: The first stage's classifier and the second's fingerprints have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; a stage's rows are removed once the next one's are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
