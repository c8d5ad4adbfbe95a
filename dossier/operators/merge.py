"""Merging of research passes: resume, append, deep merge, rounds with their gaps and sources."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.functions.records import compact, parsed
from dossier.functions.text import MARK


def remaining(outline: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Outline rows without a completed result."""
    return outline.join(done.select(key).distinct(), key, "left_anti")


def append_new(items: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """``items`` and those of ``more`` whose key they lack (the first of repeated ones, by all columns)."""
    fresh = more.join(items.select(key), key, "left_anti").withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*[c for c in more.columns if c != key]))).filter("__n = 1").drop("__n")
    return items.unionByName(fresh.select(*items.columns))


def overlay(base: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """Framework rows of both; a key in both has the row of ``more``."""
    return base.join(more.select(key), key, "left_anti").unionByName(more.select(*base.columns))


def merge_leaves(left: DataFrame, right: DataFrame, key: str = "item_id") -> DataFrame:
    """Deep merge of documents given as leaves ``key, path (dotted), value``; the right side wins.

    A right leaf replaces the left leaf or subtree at its path, a right subtree replaces a left scalar; ``{}`` is
    an empty object, which merges with an object instead of replacing it. An explicit null on the right wins. Path prefixes are matched by
    equality, each path exploded into its proper prefixes.
    """
    def prefixes(df: DataFrame) -> DataFrame:
        parts = F.split("path", r"\.")
        return df.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "."))))

    nested = lambda df: prefixes(df.filter(F.col("path").contains(".")))
    same = left.join(right.select(key, "path"), [key, "path"], "left_anti")
    scalars = right.filter("value IS DISTINCT FROM '{}'").select(key, F.col("path").alias("prefix"))
    under = nested(same).join(scalars, [key, "prefix"], "left_semi").select(key, "path")
    over = nested(right).select(key, F.col("prefix").alias("path")).distinct()
    kept = same.join(under, [key, "path"], "left_anti").join(over, [key, "path"], "left_anti")
    # A right {} over a left object, or over a left subtree, leaves the left as it is.
    empty = right.filter("value = '{}'")
    objects = nested(left).select(key, F.col("prefix").alias("path")).distinct()
    empty = empty.join(objects, [key, "path"], "left_anti")
    return kept.unionByName(right.filter("value IS DISTINCT FROM '{}'").unionByName(empty).select(*left.columns))


def merged(left: object, right: object) -> object:
    """Deep merge of two values, the right one winning: objects merge by key, everything else (arrays, scalars, null) replaces. A stack, so depth is data."""
    if not (isinstance(left, dict) and isinstance(right, dict)):
        return right
    out = dict(left)
    stack = [(out, right)]
    while stack:
        target, more = stack.pop()
        for key, value in more.items():
            if isinstance(value, dict) and isinstance(target.get(key), dict):
                target[key] = dict(target[key])
                stack.append((target[key], value))
            else:
                target[key] = value
    return out


def merge_documents(left: DataFrame, right: DataFrame, key: str = "item_id") -> DataFrame:
    """``key, raw``: the JSON documents of both sides merged by :func:`merged`; a document without another stays, as does one whose other isn't JSON. Keys are unique on each side; null is a key.

    One join by key; each pair is parsed once and merged in its own row, whatever its depth.
    """
    a, b = left.select(F.col(key).alias("__a"), F.col("raw").alias("__left")), right.select(F.col(key).alias("__b"), F.col("raw").alias("__right"))
    both = a.join(b, F.col("__a").eqNullSafe(F.col("__b")), "full")
    both = both.select(F.coalesce("__a", "__b").alias(key), F.col("__left"), F.col("__right"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(x: str | None, y: str | None) -> str | None:
            if x is None or y is None:
                return y if x is None else x
            try:
                under = parsed(x)
            except ValueError:
                return y
            try:
                return compact(merged(under, parsed(y)))
            except ValueError:
                return x

        for batch in batches:
            texts = [one(x, y) for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "raw"])

    return both.mapInArrow(run, T.StructType([both.schema[key], T.StructField("raw", T.StringType())]))


def union_sources(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Ordered distinct union of each key's sources."""
    first = rows.groupBy(key, value).agg(F.min(order).alias("__at"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", value))), lambda s: s[value]).alias("sources"))


def gaps(coverage: DataFrame, uncertain: DataFrame) -> DataFrame:
    """``item_id, gap`` of items to research again: ``field (missing)`` and ``field (uncertain)``."""
    tagged = lambda df, tag: df.select("item_id", F.concat("field", F.lit(f" ({tag})")).alias("gap"))
    return tagged(coverage, "missing").unionByName(tagged(uncertain, "uncertain"))


def resolve_rounds(rounds: DataFrame, max_rounds: int = 2, verify: bool = True) -> DataFrame:
    """One row per item and path after rounds 1, 2 and 3 (verification), later ones winning; items without a first round fail.

    Round 2 counts only where round 1 left a gap (an uncertain value). ``rounds``: ``item_id, round_no, seq, path, value``.
    Result: ``item_id, failed, rounds_used, path, value`` (path and value null for failed items).
    """
    last = rounds.groupBy("item_id", "round_no", "path").agg(F.max_by("value", "seq").alias("value"))
    per = last.groupBy("item_id").agg(
        F.bool_or(F.col("round_no") == 1).alias("started"),
        F.bool_or((F.col("round_no") == 1) & (F.col("value").contains(MARK))).alias("gap"),
        F.bool_or(F.col("round_no") == 2).alias("second"),
    )
    per = per.select("item_id", (~F.col("started")).alias("failed"), (F.col("started") & F.col("gap") & F.col("second") & F.lit(max_rounds >= 2)).alias("refined"))
    per = per.withColumn("rounds_used", F.when(F.col("failed"), 0).when(F.col("refined"), 2).otherwise(1))
    use = (F.col("round_no") == 1) | ((F.col("round_no") == 2) & F.col("refined")) | ((F.col("round_no") == 3) & F.lit(verify))
    rows = last.join(per, "item_id").filter(~F.col("failed") & use).groupBy("item_id", "rounds_used", "path").agg(F.max_by("value", "round_no").alias("value"))
    ok = rows.select("item_id", F.lit(False).alias("failed"), "rounds_used", "path", "value")
    return ok.unionByName(per.filter("failed").select("item_id", "failed", "rounds_used", F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("value")))


def batches(outline: DataFrame, group: str, order: str, batch_size: int, per_agent: int) -> DataFrame:
    """Batch and agent of each outline row, in order, within its topic."""
    at = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    return outline.withColumn("__at", at).withColumn("batch", F.floor(F.col("__at") / (batch_size * per_agent))).withColumn("agent", F.floor(F.pmod("__at", F.lit(batch_size * per_agent)) / per_agent)).drop("__at")


def batch_rollup(results: DataFrame, by: str, flags: tuple[str, ...] = ()) -> DataFrame:
    """Per batch: items, failed and done ones, and for each of the ``flags`` (as ``uncertain, missing, low_confidence, conflicts``) the done ones that have it."""
    done = ~F.col("failed")
    count = [F.count_if(done & F.coalesce(F.col(f), F.lit(False))).alias(f) for f in flags]
    return results.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count_if("failed").alias("failed"), F.count_if(done).alias("ok"), *count)


def with_defaults(outline: DataFrame) -> DataFrame:
    """Absent category as ``n/a``, absent description as empty."""
    return outline.withColumns({"category": F.coalesce(F.nullif("category", F.lit("")), F.lit("n/a")), "description": F.coalesce("description", F.lit(""))})
