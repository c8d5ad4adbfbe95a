"""Query of the secret scan: counts and spans of every document."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.secrets import RULES, Ledger, blob_id, scan
from dossier.llm.shared import documents, shared_dir, small


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans in two rounds over one ledger: a first half of the blobs by all rules but one, then all documents by all rules."""
    docs = documents(spark, sf_dir)
    ledger = Ledger(spark, f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}")
    scan(docs.filter(F.crc32(F.coalesce("text", F.lit(""))) % 2 == 0), ledger, RULES[1:])
    scan(docs, ledger, RULES)
    found = ledger.findings()
    span = F.struct("start", "kind_order", F.concat_ws(":", "rule", "start", "end").alias("span"))
    per_blob = found.groupBy("blob").agg(
        *[F.count_if(F.col("rule") == r.name).alias(f"n_{r.name}") for r in RULES],
        F.array_join(F.transform(F.array_sort(F.collect_list(span)), lambda s: s["span"]), ",").alias("spans"),
    )
    joined = docs.select("doc_id", blob_id().alias("blob")).join(small(per_blob), "blob", "left")
    spans = F.coalesce("spans", F.lit(""))
    return joined.select("doc_id", *[F.coalesce(f"n_{r.name}", F.lit(0)).cast("long").alias(f"n_{r.name}") for r in RULES], F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"), "blob")


QUERIES = {"op5_secret_scans": op5_secret_scans}
