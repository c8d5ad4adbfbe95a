"""Importance resampling towards a target's distribution, with hashed runs of words as features.

A text's features are its runs of 1 to 3 consecutive words (A-Z lowered, joined by one space, repeats counted), each hashed to one of ``BUCKETS`` by CRC-32.
All documents and all target texts are counted; a bucket's gain is the logarithm of its smoothed share in the target over that in the documents, in
thousandths. A document's weight is the sum of its features' gains, read from one array. Its score adds noise of a Gumbel distribution, taken from a
digest of its doc_id, so the highest scores are a sample without replacement in proportion to the exponentials of the weights. Ranks come from :mod:`.ranking`.

The features are made twice, as a table of them would be larger than the texts. What is sent to the workers is the array of gains, ``BUCKETS`` numbers whatever the data.

Defined results: a null text has no words, no features and the weight 0; a text of fewer words than wanted is never drawn; repeated rows are
scored alike and drawn one by one; a null doc_id is noised by the seed alone and comes before others of its score; an empty table gives an empty result, an empty target equal gains
but for the documents' own counts; other columns are left alone, and where one has the name of a result, the result gets an underscore.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.checksums import joined, span_crcs
from dossier.llm.ranking import ranked
from dossier.llm.shared import apart, partitions, scratch, written
from dossier.llm.textarrays import LOWER, flat, slices, words

BUCKETS = 10_000
PERCENT, SEED, LEAST_WORDS = 5, 42, 20
#: Bytes between words: ASCII but for digits and letters (A-Z is lowered before).
BETWEEN = np.zeros(256, bool)
BETWEEN[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
_SPACE = 0x20


def features(part: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Of the texts ``cuts[i]:cuts[i+1]``: each text's cuts in the words; per length the features' buckets; per length the word at which each feature starts."""
    data = LOWER[part]
    s, e, upto = words(data, cuts, BETWEEN)
    text, length = np.repeat(np.arange(len(cuts) - 1), np.diff(upto)), e - s
    own = span_crcs(data, s, e)
    space = span_crcs(np.array([_SPACE], np.uint8), np.zeros(1, np.int64), np.ones(1, np.int64))
    after = joined(np.broadcast_to(space, own.shape), own, length)  # of a space and the word
    value, at = own, np.arange(len(own))
    found, starts = [own % np.uint32(BUCKETS)], [at]
    for k in (1, 2):
        at = np.flatnonzero(text[k:] == text[:-k]) if len(text) > k else np.zeros(0, np.int64)
        before = np.zeros(len(own), np.uint32)
        before[starts[-1]] = value
        value = joined(before[at], after[at + k], length[at + k] + 1)
        found.append(value % np.uint32(BUCKETS))
        starts.append(at)
    return upto, found, starts


def bucket_counts(df: DataFrame, text: str = "text") -> np.ndarray:
    """How many features of all texts each bucket holds. A task sends one array, the shuffle's partitions add them up, and ``BUCKETS`` sums come back."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            data, offsets = flat(batch.column(0))
            for i, j in slices(offsets):
                for x in features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[1]:
                    sums += np.bincount(x, minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([sums.tobytes()], pa.binary())], names=["task", "sums"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for x in batch.column(1):
                sums += np.frombuffer(x.as_py(), np.int64)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at], pa.int64())], names=["bucket", "n"])

    parts = df.select(text).mapInArrow(count, "task int, sums binary").repartition(max(1, partitions(df.sparkSession) // 8), "task")
    out = np.zeros(BUCKETS, np.int64)
    for r in parts.mapInArrow(add, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(pool: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain in thousandths, from its counts in the documents and in the target."""
    s_all, t_all = int(pool.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + BUCKETS) / ((s + 1) * (t_all + BUCKETS)))) for s, t in zip(pool.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, from a digest of the seed and the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row. ``docs``: ``doc_id, text``."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for i, j in slices(offsets):
                upto, found, starts = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                per_word = np.zeros(int(upto[-1]) + 1, np.int64)
                for x, at in zip(found, starts, strict=True):
                    per_word[at + 1] += sent.value[x]
                n, weight = np.diff(upto), np.diff(np.cumsum(per_word)[upto])
                doc = batch.column(0).slice(i, j - i)
                extra = np.fromiter((noise(x, seed) for x in doc.to_pylist()), np.int64, j - i)
                yield pa.RecordBatch.from_arrays(
                    [doc, pa.array(n, pa.int64()), pa.array(n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0), pa.int64()), pa.array(weight, pa.int64()), pa.array(weight + extra, pa.int64())],
                    names=["doc_id", "n_words", "n_features", "weight", "score"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def assessed(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row: the highest ``percent`` in a hundred of the scores among texts of ``least_words`` or more have ranks.

    ``docs``: ``doc_id, text``; ``target``: ``text``.
    """
    with scratch(docs.sparkSession):
        gain = gains(bucket_counts(docs), bucket_counts(target))
        rows = written(scored(docs, gain, seed), "resampling-scores", keep=True)
    enough = F.col("n_words") >= least_words
    may = rows.filter(enough)
    return ranked(may, percent * may.count() // 100).unionByName(rows.filter(~enough).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """The drawn rows of ``docs`` (``doc_id``, ``text`` and more) with their ``rank``. Rows of one doc_id are drawn together, by the best rank among them."""
    found = assessed(docs.select("doc_id", "text"), target, percent, seed, least_words).filter("rank IS NOT NULL")
    found = found.groupBy(F.col("doc_id").alias("__id")).agg(F.min("rank").alias(apart(docs.columns, "rank")))
    return docs.join(found, docs["doc_id"].eqNullSafe(F.col("__id"))).drop("__id")
