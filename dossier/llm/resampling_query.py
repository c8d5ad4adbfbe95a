"""Query of the importance resampling: every document's weight, score and rank towards the benchmark texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dossier.llm.resampling import assessed
from dossier.llm.shared import documents


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return assessed(documents(spark, sf_dir).select("doc_id", "text"), target).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op13_importance_resampling": op13_importance_resampling}
