"""Mergeable quantile sketches as plain aggregations.

A non-negative integer falls in a bucket by its highest bits: values under ``1 << BITS`` have a bucket each, larger ones
share one with values of the same leading bits, so a quantile read from the buckets is at most 1/256 too
low. A sketch is its buckets' counts: sketches merge by adding counts, in any order and with the same result, and
Spark combines them before the shuffle. Each group holds some 256 buckets per doubling of a metric at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Leading bits by which values share a bucket, and the share of a value that a bucket spans at most.
BITS = 9
ERROR = 2.0 ** (1 - BITS)


def bucket_low(value: Column) -> Column:
    """The least value of ``value``'s bucket."""
    shift = F.greatest(F.length(F.bin(value)) - F.lit(BITS), F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketch(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row per group, metric and bucket: ``keys, metric, low, n``."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), bucket_low(F.col(m)).alias("low")) for m in metrics])
    return df.select(*keys, F.explode(pairs).alias("p")).groupBy(*keys, "p.metric", "p.low").agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of several inputs, or of finer groups, as those of ``keys``."""
    return sketches.groupBy(*keys, "metric", "low").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], per_mille: list[int]) -> DataFrame:
    """One row per group and metric: ``n`` and ``q<p>``, the least bucket that holds at least p thousandths of the values."""
    w = Window.partitionBy(*keys, "metric").orderBy("low")
    all_ = Window.partitionBy(*keys, "metric")
    ranked = sketches.withColumn("__upto", F.sum("n").over(w)).withColumn("__all", F.sum("n").over(all_))
    return ranked.groupBy(*keys, "metric").agg(
        F.sum("n").alias("n"),
        *[F.min(F.when(F.col("__upto") * 1000 >= F.col("__all") * p, F.col("low"))).alias(f"q{p}") for p in per_mille],
    )
