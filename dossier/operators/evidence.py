"""Sources, citations, conflicts and confidence of items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_verification(items: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Items with their sidecar's columns (null where there is none); sidecars without an item are dropped."""
    return items.join(sidecars, "item_id", "left")


def numbered_sources(sources: DataFrame) -> DataFrame:
    """1-based number of each item's sources."""
    return sources.withColumn("n", F.row_number().over(Window.partitionBy("item_id").orderBy("ord", "url")))


def cited_indices(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """Citations with the number of their source (its first place); an unknown one has one more than there are."""
    n = numbered_sources(sources)
    first = n.groupBy("item_id", F.col("url").alias("ref")).agg(F.min("n").alias("idx"))
    total = n.groupBy("item_id").agg(F.count(F.lit(1)).alias("total"))
    return citations.join(first, ["item_id", "ref"], "left").join(total, "item_id", "left").withColumn("idx", F.coalesce("idx", F.coalesce("total", F.lit(0)) + 1)).drop("total")


def needs_review(sidecars: DataFrame) -> DataFrame:
    """Low confidence or any conflict."""
    return sidecars.filter((F.col("confidence") == "low") | (F.col("n_conflicts") > 0))


def conflicting(values: DataFrame) -> DataFrame:
    """Item fields with more than one value over their sources: ``item_id, field, n_values``."""
    per = values.groupBy("item_id", "field").agg(F.count_distinct("value").alias("n_values"))
    return per.filter("n_values > 1")


def rate_confidence(items: DataFrame) -> DataFrame:
    """Our rule over ``conflicts, sources, uncertain`` counts: any conflict is low; two sources and nothing uncertain high; else medium."""
    rule = F.when(F.col("conflicts") > 0, "low").when((F.col("sources") >= 2) & (F.col("uncertain") == 0), "high").otherwise("medium")
    return items.withColumn("confidence", rule)


def uncertainty(fields: DataFrame, listed: DataFrame) -> DataFrame:
    """Per item: listed uncertain names first, then fields whose value bears the mark, each once, in order."""
    own = listed.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "field"))), lambda s: s["field"]).alias("a"))
    marked = fields.filter(F.col("value").contains("[uncertain]")).groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "field"))), lambda s: s["field"]).alias("b"))
    none = F.array().cast("array<string>")
    return own.join(marked, "item_id", "full").select("item_id", F.array_union(F.coalesce("a", none), F.coalesce("b", none)).alias("uncertain"))
