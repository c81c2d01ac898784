"""The corpus pipeline: quality, near-duplicates, secrets, mixture, tokens.

Each stage works on all that the one before it kept and returns the columns of ``documents``; the last one
returns the tokens. The mixture repeats a document's row once a copy taken and leaves out what is not taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalbench.llm import bpe, mixing, neardup, quality, secrets
from evalbench.llm._spark import stash, table

#: The quality model and the secret network are trained by the run, and tokens depend on a vocabulary file.
ORACLE_SQL = None


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10; documents with a score below 0.5 go."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8; the document with the smallest id of each class stays."""
    return neardup.keep_one(docs)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2; secrets are replaced, ``n_chars`` follows, all documents stay."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4; a row for each copy that the mixture takes, shard by shard in its shuffled order."""
    return mixing.mixed(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5; ids of each whole text, and digests of the ids and of the text they decode to."""
    return bpe.tokenised(docs)


STAGES = [
    ("quality", classify_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", remove_secrets),
    ("mixture", mix_sources),
    ("tokens", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
