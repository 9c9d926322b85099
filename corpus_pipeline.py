"""Training-data pipeline: each stage works on all that the one before it kept.

Every stage but the last returns the columns of documents; what it decides has taken effect in its rows. Nulls, empty
texts, repeated rows and empty tables are treated as the operators' modules say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from proofsheet.llm import mixing, ngram_join, packing, quality_rules, secret_scan
from proofsheet.llm.common import written

#: One pass over each source, so no document is repeated; four fifths of all tokens, by weight.
MIX = mixing.Mix(budget_permille=800, max_epochs=1)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: rejected documents go, failing lines are removed."""
    return quality_rules.stage(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one document of each group of near copies stays."""
    return ngram_join.stage(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: each secret is replaced by a mark."""
    return secret_scan.stage(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: each source keeps a token-prefix of its seeded order."""
    return mixing.stage(docs, MIX, written)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: one row for each piece of a training sequence."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [("quality_rules", clean), ("ngram_join", deduplicate), ("secret_scan", redact), ("mixing", mix), ("packing", pack)]
#: The tokenizer and the candidate search by MinHash can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; between stages their rows are written as Parquet to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
