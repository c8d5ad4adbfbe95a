"""Query of the near-duplicate join: the component of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dossier.llm.neardup import classes
from dossier.llm.shared import documents


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op9_ngram_jaccard_join": op9_ngram_jaccard_join}
