"""A corpus pipeline: quality rules, line dedup, near-duplicate documents, personal data, packing.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept, and returns a DataFrame; all but the
last return the columns of the documents. ``run`` writes each stage's result to the shared folder and reads it again for the next; what a stage
wrote for itself goes when its result is written.

Defined results of all stages: extra columns pass through, whatever their names (packing returns pieces alone); an empty table gives an empty one; a null text
has no words, so the quality rules reject it, and stages that get one keep it as it is; a null doc_id, lang or source is a value like any other; repeated rows are
judged and edited alike, and the join stage leaves one of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from dossier.llm import linededup, neardup, packing, packing_query, privacy, quality, shared
from dossier.session import shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that match a line before them."""
    return linededup.without_later_matches(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.one_of_each(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and terms that disclose it generalised or removed."""
    return privacy.sanitised(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences."""
    return packing.pack(docs, packing_query.vocabulary(spark))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("pii", pii),
    ("packing", pack),
]
#: Sketch thresholds, similarity joins and tokenizers have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    where = f"{shared_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        with shared.scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{where}/{i}-{name}")
        docs = spark.read.parquet(f"{where}/{i}-{name}")
    return docs
