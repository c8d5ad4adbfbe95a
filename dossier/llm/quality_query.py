"""Query of the adaptive quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dossier.llm.quality import assess
from dossier.llm.shared import documents


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(documents(spark, sf_dir))


QUERIES = {"op1_quality_rules": op1_quality_rules}
