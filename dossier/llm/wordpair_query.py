"""Query of the BPE with word ends: digests of every document's ids and of what they decode to."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from dossier.llm.shared import documents
from dossier.llm.wordpair import WordVocabulary, encoded, with_lexicon

VOCABULARY = "word_bpe_49k.json"


def op11_lexicon_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """``path``: of the vocabulary, by default that of the public tokenizers."""
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text")
    vocabulary = with_lexicon(docs, WordVocabulary(spark, path or public_tokenizers.path(VOCABULARY)))

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, tokens, numbers = vocabulary.library()
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for i, j, ids, at in encoded(batch, vocabulary):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(at), pa.int64()), pa.array(map(sha, numbers.joined(ids, at))), pa.array(map(sha, tokens.joined(ids, at)))],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


QUERIES = {"op11_lexicon_bpe": op11_lexicon_bpe}
