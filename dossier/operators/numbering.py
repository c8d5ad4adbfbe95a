"""Numbers in a global order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.operators.names import apart
from dossier.session import written

_IN_PARTITION = (1 << 33) - 1  # the part of Spark's row id that counts rows within a partition


def numbered(df: DataFrame, *order: str, name: str = "no") -> DataFrame:
    """``df`` with 1-based numbers ``name`` in the order of the columns ``order`` (nulls first; equal rows in any order).

    Two phases: ranges of the order are sorted, each by a task, and written with the places of their rows; the ranges' counts, one row a range, give
    by their prefix sums the number at which each starts, which is joined back.
    """
    part, place, before = (apart(df.columns, c) for c in ("__part", "__place", "__before"))
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(rows.withColumns({part: F.spark_partition_id(), place: F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION))}), "numbered")
    counts = rows.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias(before))  # one row a range
    return rows.join(F.broadcast(starts), part).withColumn(name, F.col(before) + F.col(place) + 1).drop(part, place, before)
