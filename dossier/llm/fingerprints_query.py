"""Query of the document fingerprints: every text beside an edited one and the next document's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.fingerprints import canonical, digest, fingerprinted, seen_twice, unequal, with_next
from dossier.llm.shared import documents, small, written

KINDS = ("text", "edited", "next_text")


def _edited(pairs: DataFrame) -> DataFrame:
    """``pairs`` of :func:`with_next` with ``n_chars`` and ``edited``, the text whose last quarter is the next one's beginning."""
    pairs = pairs.withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    return pairs.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next_text", F.lit(1), cut)))


def _same_digest(docs: DataFrame, seen: DataFrame) -> DataFrame:
    """``digest, canon`` of all texts and edited texts whose digest occurs twice; texts are fetched by their documents' keys."""
    twice = seen_twice(seen.select(F.explode(F.array_distinct(F.array("d_text", "d_edited"))).alias("digest")))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("version", F.xxhash64("text"))
    keyed = lambda kind, d: seen.withColumnRenamed(f"d_{d}", "digest").join(small(twice), "digest", "left_semi").select("digest", *kind).distinct()
    own = lambda t, doc, version: (t["doc_id"].eqNullSafe(doc)) & (t["version"] == version)
    first = keyed(("id", "v"), "text")
    plain = texts.join(small(written(first, "digest-texts", narrow=True)).alias("k"), own(texts, F.col("id"), F.col("v"))).select("digest", canonical(F.col("text")).alias("canon"))
    second = small(written(keyed(("id", "v", "next_id", "next_v"), "edited"), "digest-edits", narrow=True))
    half = texts.join(second, own(texts, F.col("id"), F.col("v"))).select("digest", "text", "next_id", "next_v").distinct()
    other = texts.withColumnRenamed("text", "next_text")
    whole = other.join(small(written(half, "digest-halves", narrow=True)), own(other, F.col("next_id"), F.col("next_v"))).select("digest", "text", "next_text")
    return plain.unionByName(_edited(whole).select("digest", canonical(F.col("edited")).alias("canon")))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    pairs = _edited(with_next(docs))
    sha = F.sha2("edited", 256).alias("edited_sha256")
    keys = [F.col("doc_id").alias("id"), F.xxhash64("text").alias("v"), "next_id", F.xxhash64("next_text").alias("next_v")]
    seen = written(pairs.select(*keys, "n_chars", sha, *[digest(canonical(F.col(c))).alias(f"d_{c}") for c in KINDS]), "digests")
    clash = unequal(_same_digest(docs, seen))
    if clash.isEmpty():
        prints = seen.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", *[F.col(f"d_{c}").alias(f"{c}_print") for c in KINDS])
    else:
        prints = pairs.select("doc_id", "n_chars", sha, *[canonical(F.col(c)).alias(f"{c}_canon") for c in KINDS])
        for c in KINDS:
            prints = fingerprinted(prints, f"{c}_canon", f"{c}_print", clash)
    like = lambda c: (F.col("text_print") == F.col(f"{c}_print")).cast("double")
    return prints.select("doc_id", "n_chars", "edited_sha256", F.col("text_print").alias("fingerprint"), F.col("edited_print").alias("edited_fingerprint"), like("edited").alias("near_edited"), like("next_text").alias("near_next"))


QUERIES = {"op2_document_fingerprints": op2_document_fingerprints}
