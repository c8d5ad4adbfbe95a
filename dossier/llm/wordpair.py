"""BPE with word ends by a lexicon: frequent words are looked up with their ids, unseen ones are merged exactly by the tokenizers library.

The vocabulary's normaliser and splitting pattern drop white space and join nothing across it, so the texts' parts between ASCII white space (words here, with their
punctuation and in their own case) can be encoded apart. All words of the corpus are counted; the most frequent ones, up to ``WORDS``, are encoded and compiled into a
minimal acyclic transducer (:mod:`.lexicon`), a file that goes to every executor and is mapped into memory by its workers. Words that it lacks go through the
library, each distinct one of a slice once. So which words it holds decides how fast encoding is, never what it gives.

Special tokens that stand in a text are found by the library as everywhere else, as no word that holds one is encoded otherwise.

Defined results: a null text is empty and has no ids; equal texts have equal ids; an empty table gives an empty result; decoding gives what the library's does
(tokens with their word ends, joined by spaces), ids out of range nothing; other columns are left alone, and where one has the name of a result, the result gets an underscore.
"""

from __future__ import annotations

import copy
import os
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.llm.lexicon import Lexicon, compiled
from dossier.llm.shared import apart, saved, scratch, written
from dossier.llm.textarrays import SPACE, flat, slices, span_hashes, words

#: Words that the lexicon may hold, and their bytes at most.
WORDS, WORD_BYTES = 1 << 17, 64
#: Steps of a doubling in which words are counted by their frequency, to find the least one that fits.
_STEPS = 16

_LIBRARIES: dict[str, tuple] = {}
_LEXICONS: dict[str, Lexicon] = {}


def _library(key: str, content: bytes):
    """A worker's tokenizer of a vocabulary file (kept), its tokens as bytes with a space after each, and the ids as decimals with a space, as flat arrays."""
    if key not in _LIBRARIES:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(content.decode())
        library.no_truncation()
        library.no_padding()
        vocab = library.get_vocab(with_added_tokens=True)
        name = {i: t for t, i in vocab.items()}
        size = max(name, default=-1) + 1
        _LIBRARIES[key] = library, Pieces([(f"{name[i]} " if i in name else "").encode() for i in range(size)]), Pieces([f"{i} ".encode() for i in range(size)])
    return _LIBRARIES[key]


class Pieces:
    """A byte string per id."""

    def __init__(self, pieces: list[bytes]):
        self.n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.at, self.data = np.cumsum(self.n) - self.n, np.frombuffer(b"".join(pieces), np.uint8)

    def joined(self, ids: np.ndarray, cuts: np.ndarray) -> list[bytes]:
        """The pieces of the ids ``cuts[i]:cuts[i+1]`` in a row, without the last byte (a space)."""
        n = self.n[ids]
        upto = np.concatenate([[0], np.cumsum(n)])
        raw = self.data[np.arange(upto[-1]) + np.repeat(self.at[ids] - upto[:-1], n)].tobytes() if len(ids) else b""
        return [raw[a : max(a, b - 1)] for a, b in zip(upto[cuts[:-1]].tolist(), upto[cuts[1:]].tolist(), strict=True)]


class WordVocabulary:
    """A tokenizers file, read on the driver and sent to the workers (a few MB, whatever the data), and the lexicon that goes with it."""

    def __init__(self, spark, path: str):
        with open(path, "rb") as f:
            self.content = spark.sparkContext.broadcast(f.read())
        self.path, self.lexicon = path, None

    def library(self):
        return _library(self.path, self.content.value)

    def found(self) -> Lexicon:
        """The lexicon, mapped from the executor's copy of its file."""
        if self.lexicon is None:
            return Lexicon(compiled([], []))
        if self.lexicon not in _LEXICONS:
            _LEXICONS.clear()
            _LEXICONS[self.lexicon] = Lexicon.mapped(SparkFiles.get(self.lexicon))
        return _LEXICONS[self.lexicon]


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``word (binary), n`` of all words of at most ``WORD_BYTES`` bytes. Counts are combined per slice, per task, then by a shuffle of words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(0))
            for i, j in slices(offsets):
                part, cuts = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                s, e, _ = words(part, cuts)
                all_ = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(e - s)]).astype(np.int64)), pa.py_buffer(part[~SPACE[part]].tobytes())])
                found = all_.filter(pa.array(e - s <= WORD_BYTES)).value_counts()
                yield pa.RecordBatch.from_arrays([found.field(0).cast(pa.binary()), found.field(1)], names=["word", "n"])

    return df.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The most frequent rows of ``counts`` (``word, n``), whole levels of frequency, at most ``most`` rows; a histogram of levels tells the least one, so no table is sorted."""
    level = F.floor(F.log2("n") * _STEPS).cast("int")
    found, least = 0, None
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        if found + r["count"] > most:
            break
        found, least = found + r["count"], r["level"]
    return counts.filter(level >= least) if least is not None else counts.limit(0)


def with_lexicon(df: DataFrame, vocabulary: WordVocabulary, text: str = "text", most: int = WORDS) -> WordVocabulary:
    """``vocabulary`` with a lexicon of the ``most`` frequent words of ``df`` that occur more than once. The chosen words come to the driver, ``most`` at most."""
    spark = df.sparkSession

    def encode_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(0).to_pylist()
            found = [e.ids for e in vocabulary.library()[0].encode_batch_fast([w.decode() for w in raw], add_special_tokens=False)] if raw else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["word", "ids"])

    with scratch(spark):
        counts = written(word_counts(df, text).filter("n > 1"), "lexicon-counts", narrow=True)
        chosen = frequent(counts, most).select("word").mapInArrow(encode_words, "word binary, ids array<int>").toArrow()
    rows = sorted(zip(chosen.column("word").to_pylist(), chosen.column("ids").to_pylist(), strict=True))
    name = f"lexicon-{uuid.uuid4().hex}"
    spark.sparkContext.addFile(saved(spark, name, compiled([w for w, _ in rows], [x for _, x in rows])))
    out = copy.copy(vocabulary)
    out.lexicon = name
    return out


def encoded(batch: pa.RecordBatch, vocabulary: WordVocabulary, text: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a batch with their ids and each row's cuts in them."""
    lexicon, library = vocabulary.found(), vocabulary.library()[0]
    data, offsets = flat(batch.column(batch.schema.get_field_index(text)))
    for i, j in slices(offsets):
        part, cuts = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        s, e, upto = words(part, cuts)
        rank = lexicon.ranks(part, s, e)
        start, n = lexicon.cut[np.maximum(rank, 0)], np.where(rank >= 0, np.diff(lexicon.cut)[np.maximum(rank, 0)] if len(lexicon.cut) > 1 else 0, 0)
        new, pool = np.flatnonzero(rank < 0), lexicon.ids
        if len(new):
            h, check = span_hashes(part, s[new], e[new]), span_hashes(part, s[new], e[new], lane=1)
            _, first, which = np.unique(np.rec.fromarrays([h, check]), return_index=True, return_inverse=True)
            raw = part.tobytes()
            merged = [x.ids for x in library.encode_batch_fast([raw[a:b].decode() for a, b in zip(s[new[first]].tolist(), e[new[first]].tolist(), strict=True)], add_special_tokens=False)]
            m = np.fromiter(map(len, merged), np.int64, len(merged))
            pool = np.concatenate([pool, np.fromiter((x for ids in merged for x in ids), np.int32, int(m.sum()))])
            start[new], n[new] = (len(lexicon.ids) + np.cumsum(m) - m)[which], m[which]
        sums = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.arange(sums[-1]) + np.repeat(start - sums[:-1], n)] if len(s) else np.zeros(0, np.int32)
        yield i, j, ids.astype(np.int64), sums[upto]


def encode(df: DataFrame, vocabulary: WordVocabulary, text: str = "text") -> DataFrame:
    """``df`` with ``ids``."""
    made = apart(df.columns, "ids")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, ids, at in encoded(batch, vocabulary, text):
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, lists], names=[*batch.schema.names, made])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(made, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, vocabulary: WordVocabulary, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, as the library's ``decode(ids, skip_special_tokens=False)`` has it."""
    made = apart(df.columns, "decoded")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, tokens, _ = vocabulary.library()
            lists = [np.asarray(x or [], np.int64) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            lists = [x[(x >= 0) & (x < len(tokens.n))] for x in lists]
            texts = tokens.joined(np.concatenate([*lists, np.zeros(0, np.int64)]), np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.decode() for x in texts], pa.string())], names=[*batch.schema.names, made])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(made, T.StringType())]))
