"""Query of the line dedup: every document without its repeated lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.linededup import without_later_matches
from dossier.llm.shared import documents


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_later_matches(documents(spark, sf_dir).select("doc_id", "text"), "removed")
    gone = F.coalesce("removed", F.array().cast("array<int>"))
    return out.select("doc_id", F.size(gone).cast("long").alias("n_removed"), F.array_join(gone, ",").alias("removed_lines"), "text")


QUERIES = {"op7_line_dedup": op7_line_dedup}
