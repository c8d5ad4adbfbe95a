"""Exact ranks of a whole table by parallel sorting with regular sampling.

Every partition is sorted by itself and written: a run. Every ``step``-th row of each run is a regular sample; ``step`` grows with the table, so that
about ``PER_SEGMENT`` rows for each segment come to the driver, whatever the table's size. The samples' regular quantiles are the splitters: segment k of all runs lies between splitter k - 1 and k. The rows of each
segment are counted where they stand, and the counts' prefix sums are the ranks at which the segments start. Segments that start within
the wanted ranks are exchanged, one partition for each, merged there by a local sort, and numbered. Samples decide how even the segments are, never a rank.

Ties go by ``doc_id``, then by the place in the runs, so no two rows are equal and a hot key is split like any other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.llm.shared import partitions, written

#: Samples for each segment, but for a factor of two.
PER_SEGMENT = 64
_IN_RUN = (1 << 33) - 1  # the part of Spark's row id that counts rows within a partition


def _keys(score: np.ndarray, doc: np.ndarray, known: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sort keys, the last one first: highest score, null doc_id, least doc_id, place."""
    return at, doc, known, -score


def splitters(samples: pa.Table, segments: int) -> tuple[np.ndarray, ...]:
    """At most ``segments - 1`` rows at regular places of the sorted samples, as keys."""
    doc = samples.column("doc_id").combine_chunks()
    keys = _keys(samples.column("score").to_numpy(), doc.fill_null(0).to_numpy(zero_copy_only=False), doc.is_valid().to_numpy(zero_copy_only=False), samples.column("at").to_numpy())
    order = np.lexsort(keys)
    places = np.unique(np.arange(1, segments) * len(order) // segments) if len(order) else np.zeros(0, np.int64)
    return tuple(k[order[places]] for k in keys)


def segment_of(keys: tuple[np.ndarray, ...], cuts: tuple[np.ndarray, ...]) -> np.ndarray:
    """For each row the number of splitters that don't come after it."""
    n, m = len(keys[0]), len(cuts[0])
    order = np.lexsort((np.repeat([1, 0], [n, m]), *[np.concatenate([k, c]) for k, c in zip(keys, cuts, strict=True)]))
    out = np.empty(n + m, np.int64)
    out[order] = np.cumsum(order >= n)
    return out[:n]


def ranked(rows: DataFrame, most: int, segments: int | None = None) -> DataFrame:
    """``rows`` (``doc_id``, ``score`` and more) with ``rank`` 1 to ``most`` by descending score, null beyond it; ties go to smaller doc_ids, null ones first.

    Equal rows get ranks of their own. ``segments``: by default the session's shuffle partitions.
    """
    spark = rows.sparkSession
    segments = segments or partitions(spark)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    runs = written(rows.sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranking-runs", keep=True)
    total = runs.count()
    step = max(1, total // (PER_SEGMENT * segments))
    place = F.col("at").bitwiseAND(F.lit(_IN_RUN))
    cuts = splitters(runs.filter((place + 1) % step == 0).select("score", "doc_id", "at").toArrow(), segments)
    sent = spark.sparkContext.broadcast(cuts)
    schema = T.StructType([*runs.schema.fields, T.StructField("segment", T.IntegerType())])

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc = b.column("doc_id")
            keys = _keys(b.column("score").to_numpy(), doc.fill_null(0).to_numpy(zero_copy_only=False), doc.is_valid().to_numpy(zero_copy_only=False), b.column("at").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(segment_of(keys, sent.value), pa.int32())], names=[f.name for f in schema])

    placed = runs.mapInArrow(assign, schema)
    counts = np.zeros(segments, np.int64)
    for r in placed.groupBy("segment").count().collect():
        counts[r["segment"]] = r["count"]
    before = np.cumsum(counts) - counts
    last = int(np.searchsorted(before, most, side="left")) - 1  # the last segment that starts within the wanted ranks
    starts = spark.createDataFrame([(k, int(before[k])) for k in range(last + 1)], "segment int, before long")
    drawn = placed.filter(F.col("segment") <= last).repartitionById(max(1, last + 1), F.col("segment")).sortWithinPartitions(*order, "at")
    drawn = drawn.withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_RUN)) + 1).join(F.broadcast(starts), "segment")
    rank = F.col("before") + F.col("place")
    drawn = drawn.select(*rows.columns, F.when(rank <= most, rank).alias("rank"))
    rest = placed.filter(F.col("segment") > last).select(*rows.columns, F.lit(None).cast("long").alias("rank"))
    return drawn.unionByName(rest)
