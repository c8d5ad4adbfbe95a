"""Query of the spelling variants, over the documents' words with letters dropped from some of them."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from dossier.llm.checksums import joined, span_crcs
from dossier.llm.shared import documents
from dossier.llm.spelling import variants, word_counts

#: A word loses a letter if this divides the checksum of its document's id and itself.
EVERY = 199


def dropped_letters(doc_id: pa.Array, data: np.ndarray, s: np.ndarray, e: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """The words that lose a letter, and what is left of them: of ``h = crc32(<doc_id>:<word>)`` (a null id is empty), the code point ``h % length``."""
    head = np.array([zlib.crc32(f"{'' if x is None else x}:".encode()) for x in doc_id.to_pylist()], np.uint32)
    h = joined(head[row], span_crcs(data, s, e), e - s)
    at = np.flatnonzero(h % EVERY == 0)
    out = []
    for k in at.tolist():
        word = data[s[k] : e[k]].tobytes().decode()
        i = int(h[k]) % len(word)
        out.append(word[:i] + word[i + 1 :])
    return at, out


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(word_counts(documents(spark, sf_dir), dropped_letters))


QUERIES = {"op12_spelling_variants": op12_spelling_variants}
