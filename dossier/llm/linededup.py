"""Near-duplicate lines, removed after their first occurrence, by an exact set-similarity join (:mod:`.linejoin`).

A line's tokens are its distinct words (A-Z lowered). They are ordered by rarity; prefix, positional and length filters leave the pairs
whose Jaccard likeness is then verified. A line goes if any line before it (in the order of doc_id, then line number) has a likeness of at least 3/4.
So lines of one or two words go where they repeat one; the order of words doesn't matter, nor how often a line has each.

Defined results: a null text stays null; lines without words stay; a document may become empty, but keeps its row; repeated rows (same doc_id
and text) count as one occurrence and are edited alike; rows of one doc_id with different texts are ordered by a hash of the text;
a null doc_id comes before all others; an empty table gives an empty result; other columns are left alone, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.linejoin import SOME, counted, further_pairs, line_words, postings, rarity, survey
from dossier.llm.setjoin import verified
from dossier.llm.shared import scratch, small, written


def place() -> Column:
    """What orders occurrences; a null doc_id comes first."""
    return F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "version", "number")


def later_matches(docs: DataFrame) -> DataFrame:
    """Written table ``doc_id, version, number`` of all lines that match a line before them; rows may repeat. ``docs``: ``doc_id, version, text``."""
    with scratch(docs.sparkSession):
        return written(_later_matches(docs), "line-matches", keep=True)


def _later_matches(docs: DataFrame) -> DataFrame:
    found = survey(docs)
    lines = found.filter("part IS NULL").select("doc_id", "version", "number", "sid", "n", "later")
    heads = lines.filter("NOT later").drop("later").withColumn("first", F.min(place()).over(Window.partitionBy("sid")))
    heads = written(heads, "line-heads")
    firsts = heads.filter(place() == F.col("first"))
    posted = postings(docs, rarity(found), *counted(docs, firsts))
    kept = posted.filter("token IS NOT NULL").select("token", "sid", "n", "at", "first", "map", "more")

    def gone(pairs: DataFrame) -> DataFrame:
        """Of each of the ``pairs`` that is alike, the set that occurs first later."""
        links = verified(written(pairs, "line-pairs", narrow=True), docs, line_words, firsts, later=True)
        return links.select(F.col("later").alias("sid")).distinct()

    removed = written(gone(posted.filter("a IS NOT NULL").select("a", "b").distinct()), "line-removed", narrow=True)
    for most in (SOME, None):
        # Lists with a set that nothing removed and that has partners which it wasn't paired with.
        left = written(kept.filter("more").join(small(removed), "sid", "left_anti").select("token").distinct(), "line-open", narrow=True)
        rows = kept.join(small(left), "token", "left_semi").join(small(removed.withColumn("gone", F.lit(True))), "sid", "left")
        rows = written(rows.withColumn("open", F.col("more") & F.col("gone").isNull()).drop("more", "gone"), "line-lists", narrow=True)
        if rows.isEmpty():
            break
        removed = written(removed.unionByName(gone(further_pairs(rows, most))).distinct(), "line-removed", narrow=True)

    # A line goes if it occurs after another of its set, or if its set goes.
    at = ["doc_id", "version", "number"]
    repeats = lines.filter("later").select(*at).unionByName(heads.filter(place() > F.col("first")).select(*at))
    return repeats.unionByName(lines.join(small(removed), "sid", "left_semi").select(*at))


def without_later_matches(docs: DataFrame, numbers: str | None = None) -> DataFrame:
    """``docs`` with the lines of ``text`` that match a line before them taken out; the column ``numbers``, if named, has the lines' numbers (null where there are none)."""
    spark, columns = docs.sparkSession, [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.struct(*columns).alias("row"), "doc_id", F.xxhash64("text").alias("version"), "text")
    found = later_matches(keyed.select("doc_id", "version", "text"))
    with scratch(spark):
        per = found.groupBy(F.col("doc_id").alias("d"), F.col("version").alias("v")).agg(F.array_sort(F.collect_set(F.col("number").cast("int"))).alias("removed"))
        per = small(written(per, "lines-removed", keep=True))
    joined = keyed.join(per, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")), "left")
    # The lines as one value, so that a text is split once; the numbers that stay come from a hash of those that go, so a text of any number of lines takes time in proportion.
    stay = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), "removed")
    left = F.transform(F.array(F.split("text", "\n", -1)), lambda x: F.array_join(F.transform(stay(x), lambda i: F.get(x, i)), "\n"))[0]
    edited = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(left)
    out = [(edited if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    return joined.select(*out, *([F.col("removed").alias(numbers)] if numbers else []))
