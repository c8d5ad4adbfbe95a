"""Query of the byte-level BPE: digests of every document's ids and of what they decode to."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from dossier.llm.bytepair import Vocabulary, encoded
from dossier.llm.shared import documents

RANKS = "byte_bpe_multi_50k.tiktoken"


def op3_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """``ranks``: path of the rank file, ``pattern``: of its splitting pattern; by default those of the public tokenizers."""
    import public_tokenizers

    vocabulary = Vocabulary(spark, ranks or public_tokenizers.path(RANKS), "ranks", pattern or public_tokenizers.PATTERN)

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabulary.encoder()
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for i, j, ids, at, _ in encoded(batch, encoder):
                data, upto = encoder.decode(ids)
                raw, at_list, byte_list = ids.astype("<u4"), at.tolist(), upto[at].tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(np.diff(at), pa.int64()),
                        pa.array([sha(raw[a:b]) for a, b in zip(at_list, at_list[1:])]),
                        pa.array([sha(data[a:b]) for a, b in zip(byte_list, byte_list[1:])]),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return documents(spark, sf_dir).select("doc_id", "text").mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


QUERIES = {"op3_byte_bpe": op3_byte_bpe}
