"""Query of the packing: every piece of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dossier.llm.bytepair import Vocabulary
from dossier.llm.packing import pack
from dossier.llm.shared import documents

VOCABULARY = "byte_bpe_50k.json"


def vocabulary(spark: SparkSession, path: str | None = None) -> Vocabulary:
    import public_tokenizers

    return Vocabulary(spark, path or public_tokenizers.path(VOCABULARY), "json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), vocabulary(spark))


QUERIES = {"op10_packing": op10_packing}
