"""Near-duplicate documents by an n-gram Jaccard join: size-banded tiles with hashed bitmap signatures (:mod:`.setjoin`).

A document's set is its distinct 5-word shingles (words outside ASCII white space, A-Z lowered); with fewer
words, the whole sequence is one shingle. Two documents link at a Jaccard likeness of at least 3/4.

Defined results: a null text or one without words has an empty set and links with nothing, so it is its own
component; repeated rows and texts with equal sets link; a row with a null doc_id links like any other,
and a component of such rows alone has a null id; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.setjoin import block_count, bounded, components, document_units, frequent, inventory, leader_pairs, popular_pairs, set_bits, shared_postings, tile_pairs, verified, wide_postings
from dossier.llm.shared import scratch, small, written


def classes(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, version`` (a hash of the text), ``n_shingles, component_id``."""
    return _grouped(docs).drop("class")


def _grouped(docs: DataFrame) -> DataFrame:
    """Written table of :func:`classes`, with ``class``, which is null where a text has no words."""
    with scratch(docs.sparkSession):
        return written(_classes(docs.select("doc_id", F.xxhash64("text").alias("version"), "text")), "near-duplicate-classes", keep=True)


def _classes(docs: DataFrame) -> DataFrame:
    units = inventory(docs, document_units, every=True)
    nodes = units.filter("token IS NULL").select("doc_id", "version", "sid", "n", "bits")
    posted = shared_postings(docs, document_units, frequent(units), block_count(docs, nodes))
    bits = set_bits(nodes, posted)
    links = verified(bounded(leader_pairs(posted), bits), docs, document_units, nodes)
    group = components(links)

    def unsettled(group: DataFrame) -> DataFrame:
        """Postings of shingles whose sets aren't in one component yet."""
        members = wide_postings(posted).join(small(group), "sid", "left").withColumn("group", F.coalesce("component", "sid")).drop("component")
        mixed = members.groupBy("token").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low < high").select("token")
        return written(members.join(small(mixed), "token", "left_semi"), "unsettled-postings", narrow=True)

    rows = unsettled(group)
    if not rows.isEmpty():
        more = verified(bounded(popular_pairs(rows.join(small(bits.select("sid", "copies")), "sid").withColumn("open", F.lit(True))), bits), docs, document_units, nodes)
        if not more.isEmpty():
            links = links.unionByName(more)
            group = components(links)
            rows = unsettled(group)
    if not rows.isEmpty():
        # All pairs across components that filters and bitmaps leave.
        pairs = tile_pairs(rows, bits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        more = verified(written(pairs, "tile-pairs"), docs, document_units, nodes)
        if not more.isEmpty():
            group = components(links.unionByName(more))

    keyed = nodes.drop("bits").join(group, "sid", "left").withColumn("class", F.coalesce("component", "sid"))
    least = keyed.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    return keyed.join(small(least), "class", "left").select("doc_id", "version", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(F.col("n") > 0, F.col("class")).alias("class"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component: that of the least doc_id (a null one comes last), then text hash; same columns as ``docs``.

    Texts without words link with nothing and stay; of repeated rows (same doc_id and text) one stays, whatever the text.
    """
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.xxhash64("text").alias("version"))
    found = _grouped(docs.select("doc_id", "text"))
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "version")
    best = found.filter("class IS NOT NULL").groupBy("class").agg(F.min(place).alias("best"), F.count(F.lit(1)).alias("members")).filter("members > 1").drop("members")
    per = found.join(small(best), "class", "left").groupBy("doc_id", "version").agg(F.count(F.lit(1)).alias("rows"), F.max(F.coalesce(place != F.col("best"), F.lit(False))).alias("gone"))
    marked = written(per.filter("gone OR rows > 1").select(F.col("doc_id").alias("__d"), F.col("version").alias("__v"), "gone"), "near-duplicate-rows")
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("version") == F.col("__v"))
    left = own.join(small(marked), same, "left_anti")
    repeated = marked.filter("NOT gone")
    if not repeated.isEmpty():
        left = left.unionByName(own.join(small(repeated), same, "left_semi").dropDuplicates(["doc_id", "version"]))
    return left.select("row.*")
