"""Query of the language identification: learned on three quarters of the documents, applied to all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.language import learn, predict
from dossier.llm.shared import documents


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))
    model = learn(docs.filter(~F.col("held_out")).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "held_out", "text"), model, ["doc_id", "held_out"])


QUERIES = {"op8_language_id": op8_language_id}
