"""Exact fingerprints of canonical texts. DataFrame functions only.

A text is made canonical (NFKC, case folding and NFKC again by the ICU library that Spark ships, runs of white space as one
blank, none at the ends) and digested by two differently salted xxhash64 lanes, 128 bits in all. Documents are
grouped by that digest; only digests that occur twice or more have their canonical texts compared byte by byte,
and of texts that share a digest without being equal all but the first get a suffix. So documents with one
fingerprint have one canonical text.

Defined results: a null text is an empty text; the empty text has a fingerprint like any other; repeated rows
share one; documents of one doc_id are ordered by a hash of their text, then by it; a null doc_id comes before all others; a table
of one row is its own next document; an empty table gives an empty result; other columns are left alone, also one of the result's name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.shared import apart, partitions, small, written


def canonical(text: Column) -> Column:
    icu = lambda name, method, x: F.java_method(F.lit(f"com.ibm.icu.{name}"), F.lit(method), x, F.lit(True))
    composed = lambda x: icu("text.Normalizer", "compose", x)
    folded = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(composed(icu("lang.UCharacter", "foldCase", composed(text))))
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def digest(canon: Column) -> Column:
    """32 hex digits."""
    lane = lambda *c: F.lpad(F.lower(F.hex(F.xxhash64(*c))), 16, "0")
    return F.concat(lane(canon), lane(F.lit("second lane"), canon))


def seen_twice(digests: DataFrame) -> DataFrame:
    """Written table ``digest`` of those that occur twice or more in ``digests``."""
    return written(digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest"), "digests-seen-twice", narrow=True)


def unequal(texts: DataFrame) -> DataFrame:
    """Written table ``digest, canon, suffix`` of canonical texts that share a digest without being equal. ``texts``: ``digest, canon`` of the digests seen twice."""
    groups = texts.distinct().groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("canon")).alias("all"))
    return written(groups.filter("n > 1").select("digest", F.posexplode("all").alias("suffix", "canon")), "digest-clashes", narrow=True)


def clashes(texts: DataFrame) -> DataFrame:
    """:func:`unequal` of all ``texts`` (one column, ``canon``)."""
    keyed = texts.select(digest(F.col("canon")).alias("digest"), "canon")
    return unequal(keyed.join(small(seen_twice(keyed.select("digest"))), "digest", "left_semi"))


def fingerprinted(df: DataFrame, canon: str, to: str, clash: DataFrame) -> DataFrame:
    """``df`` with the column ``to``: the digest of ``canon``, with a suffix where it clashes."""
    df = df.withColumn(to, digest(F.col(canon)))
    if clash.isEmpty():
        return df
    c = small(clash.filter("suffix > 0").select(F.col("digest").alias("__d"), F.col("canon").alias("__c"), "suffix"))
    joined = df.join(c, (F.col(to) == F.col("__d")) & (F.col(canon) == F.col("__c")), "left")
    return joined.withColumn(to, F.concat(F.col(to), F.coalesce(F.concat(F.lit("-"), F.col("suffix")), F.lit("")))).drop("__d", "__c", "suffix")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with ``fingerprint`` (or, if it has such a column, that name with an underscore)."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), canonical(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("canon"))
    out = fingerprinted(rows, "canon", "print", clashes(rows.select("canon")))
    return out.select("row.*", F.col("print").alias(apart(docs.columns, "fingerprint")))


def copies(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, class_id`` (least doc_id of its fingerprint), ``n_copies``."""
    prints = fingerprints(docs.select("doc_id", "text")).select("doc_id", "fingerprint")
    classes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_copies"))
    return prints.join(classes, "fingerprint").select("doc_id", "fingerprint", "class_id", "n_copies")


def _range_bucket(key: Column, bounds: list[int]) -> Column:
    """Number of ``bounds`` below ``key``, found in two steps of about the square root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    fine = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    below = lambda xs: F.size(F.filter(xs, lambda b: b < key))
    coarse = F.array(*[F.lit(x[-1]) for x in fine])
    lists = F.array(*[F.array(*[F.lit(b) for b in x]) for x in fine])
    at = below(coarse)
    return F.when(key.isNull(), 0).otherwise(at * step + F.coalesce(below(F.get(lists, at)), F.lit(0)))


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, next_id, next_text``: those of the next document in ascending doc_id, the first's after the last.

    Ids are dealt to ranges between quantiles of their own (as many as shuffle partitions, a bounded list), null ids to as many ranges of
    their texts' hashes; each range also gets the first document of the range that follows, so that no task sees more than a range.
    """
    spark, docs = docs.sparkSession, docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    k = partitions(spark)
    bounds = docs.select(F.percentile_approx("doc_id", [i / k for i in range(1, k)] or [0.5], 20 * k)).first()[0] or []
    bounds = sorted(set(bounds))
    docs = docs.withColumn("hash", F.xxhash64("text"))
    unknown = F.floor((F.col("hash") / 2.0**64 + 0.5) * k).cast("int") - (k + 1)
    dealt = docs.withColumn("range", F.when(F.col("doc_id").isNull(), unknown).otherwise(_range_bucket(F.col("doc_id"), bounds)))
    ids = dealt.groupBy("range").agg(F.min(F.struct("doc_id", "hash")).alias("least"))  # at most 2 k + 1 rows
    first = dealt.join(F.broadcast(ids.select("range", "least")), ["range"]).filter(F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("hash") == F.col("least.hash")))
    first = first.groupBy("range").agg(F.min("text").alias("text"), F.first("doc_id").alias("doc_id"), F.first("hash").alias("hash"))
    around = Window.partitionBy(F.lit(0)).orderBy("range")  # over the few ranges
    order = ids.select("range", F.lag("range").over(around).alias("before"), F.max("range").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last"))
    borders = first.join(F.broadcast(order), "range").select("doc_id", "text", "hash", F.coalesce("before", "last").alias("range"), F.lit(1).alias("border"))
    w = Window.partitionBy("range").orderBy("border", "doc_id", "hash", "text")
    rows = dealt.select("doc_id", "text", "hash", "range", F.lit(0).alias("border")).unionByName(borders)
    return rows.withColumns({"next_id": F.lead("doc_id").over(w), "next_text": F.lead("text").over(w)}).filter("border = 0").select("doc_id", "text", "next_id", "next_text")
