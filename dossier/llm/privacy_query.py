"""Query of the sanitisation: every document's spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.privacy import KINDS, spans
from dossier.llm.shared import documents


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(documents(spark, sf_dir).select("doc_id", "text"))
    order = F.create_map(*[x for i, k in enumerate((*KINDS, "term")) for x in (F.lit(k), F.lit(i))])
    joined = lambda s: F.array_join(F.transform(F.array_sort(F.transform(s, lambda x: F.struct(order[x["kind"]].alias("k"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "extra")).alias("spans"),
        F.size("extra").cast("long").alias("n_term"), (F.size("base") + F.size("extra")).cast("long").alias("n_spans"),
    )


QUERIES = {"op4_pii": op4_pii}
