"""A corpus pipeline: toxicity filter, line deduplication, near-duplicates, decontamination, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes each result as Parquet and reads it
again as the next stage's documents.  All but the last stage return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecrew.llm import bpe, linededup, neighbours, simhash, wumanber
from tidecrew.llm.queries import TOXIC_FROM, VOCABULARY
from tidecrew.llm.tables import row_key, stored, table, without


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples call toxic go."""
    index = neighbours.build(docs, table(spark, sf_dir, "labels"), neighbours.allowed_labels())
    return neighbours.below(docs, index, TOXIC_FROM)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repetitions of runs of lines are taken out of the texts; every document stays."""
    return linededup.deduplicated(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    keyed = docs.select(row_key("doc_id").alias("key"), "text")
    found = wumanber.contaminated_words(keyed, table(spark, sf_dir, "benchmark"), id_col="key")
    return without(docs, stored(found.filter("n_hit > 0").select("key").distinct(), "contaminated"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids): the texts as token ids."""
    return bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs


# Trained scores, fingerprints and byte-pair merges cannot be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None
