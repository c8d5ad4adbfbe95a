"""Byte-level BPE over Arrow batches with the tokenizers library: ids, offsets and exact decoding.

The splitting pattern never joins a character that isn't white space with white space after it, so every
place before white space that follows another character is a token boundary, and the pieces between such places
(chunks: white space, then a word with its punctuation) can be encoded apart. Each distinct chunk goes through the library once; a
bounded table keyed by two hashes of its bytes, 128 bits in all, gives the ids of those seen before. Texts of any length are worked on
whole, in memory that follows the length of the batch.

A rank file's merges are all splits of a token into two tokens, in the order of the token's rank. The library takes equal ranks in
the order of its list where the rank file's own library takes the leftmost. Two merges of one rank make one token, by different splits, so
it has three bytes at least and stands in the chunk twice: only a chunk that repeats three bytes can differ, and such a one is settled by the rank file's library.

Defined results: a null text is empty and has no ids; equal texts have equal ids; an empty table gives an empty
result; decoding reverses any ids, also those that cut a character in two (the bytes are exact, the string has
a replacement character there); other columns are left alone, and where one has the name of a result, the result gets an underscore.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from dossier.llm.shared import apart
from dossier.llm.textarrays import SPACE, U, flat, slices, span_hashes

#: Slots of a worker's table of chunks and ids that it may hold; it starts anew beyond them.
SLOTS, HELD_IDS = 1 << 21, 12_000_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b if b in plain else next(other)) for b in range(256)]


def repeats_three_bytes(texts: list[bytes]) -> np.ndarray:
    """Marks the texts in which some three bytes stand twice."""
    data, length = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64), np.fromiter(map(len, texts), np.int64, len(texts))
    own = np.repeat(np.arange(len(texts)), length)
    out = np.zeros(len(texts), bool)
    if len(data) > 2:
        key = (own[2:] << 24) | (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
        key = np.sort(key[own[:-2] == own[2:]])
        out[key[1:][key[1:] == key[:-1]] >> 24] = True
    return out


def chunk_starts(data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Byte positions where a chunk starts: every text's start, and white space after a character that surely isn't any."""
    if not len(data):
        return np.zeros(0, np.int64)
    solid = (data > 0x20) & (data != 0x7F)
    high = np.flatnonzero(data >= 0x80)
    if len(high):  # the last bytes of what may be white space beyond ASCII don't count as solid
        one, two = np.roll(data, 1), np.roll(data, 2)
        odd = ((one == 0xC2) & ((data == 0x85) | (data == 0xA0))) | ((two == 0xE2) & ((one == 0x80) | (one == 0x81))) | ((two == 0xE1) & (one == 0x9A)) | ((two == 0xE3) & (one == 0x80))
        solid &= ~(odd & (data >= 0x80))
    start = np.zeros(len(data), bool)
    start[1:] = SPACE[data[1:]] & solid[:-1]
    start[cuts[cuts < len(data)]] = True
    return np.flatnonzero(start)


class Encoder:
    """A vocabulary with a table of chunks. ``kind``: ``json`` (a tokenizers file) or ``ranks`` (base64 tokens with ranks)."""

    def __init__(self, content: bytes, kind: str, pattern: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.reference = None
        if kind == "json":
            self.library = Tokenizer.from_str(content.decode())
            self.library.encode_special_tokens = True
            back = {c: b for b, c in enumerate(byte_characters())}
            vocab = self.library.get_vocab(with_added_tokens=True)
            tokens: dict[int, bytes] = {i: (bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()) for t, i in vocab.items()}
        else:
            tokens = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in content.splitlines() if line)}
            self.library = self._from_ranks(tokens, pattern)
            import tiktoken

            self.reference = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={t: i for i, t in tokens.items()}, special_tokens={})
        size = max(tokens) + 1
        lengths = np.array([len(tokens.get(i, b"")) for i in range(size)], np.int64)
        self.byte_at = np.concatenate([[0], np.cumsum(lengths)])
        self.byte_length = lengths
        self.bytes = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(size)), np.uint8)
        self._clear()

    @staticmethod
    def _from_ranks(tokens: dict[int, bytes], pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        chars = byte_characters()
        name = lambda t: "".join(chars[b] for b in t)
        rank = {t: i for i, t in tokens.items()}
        merges = [(name(t[:k]), name(t[k:])) for i, t in sorted(tokens.items()) for k in range(1, len(t)) if t[:k] in rank and t[k:] in rank]
        out = Tokenizer(models.BPE(vocab={name(t): i for i, t in tokens.items()}, merges=merges, ignore_merges=True))
        out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), behavior="isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return out

    def _clear(self) -> None:
        self.slot_hash, self.slot_check = np.zeros(SLOTS, U), np.zeros(SLOTS, U)
        self.slot_entry = np.zeros(SLOTS, np.int32)
        self.entry_at = np.zeros(1, np.int64)  # entry 0 is no chunk
        self.entry_n = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _learn(self, chunks: list[bytes]) -> list[list[int]]:
        texts = [c.decode("utf-8") for c in chunks]
        found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        if self.reference is not None:
            odd = np.flatnonzero(repeats_three_bytes(chunks)).tolist()
            for k, x in zip(odd, self.reference.encode_ordinary_batch([texts[k] for k in odd], num_threads=1), strict=True):
                found[k] = x
        return found

    def encode(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of texts ``cuts[i]:cuts[i+1]``: ids, each text's cuts in them, and the chunks' byte starts and cuts in the ids."""
        s = chunk_starts(data, cuts)
        e = np.append(s[1:], len(data)).astype(np.int64) if len(s) else s
        h, check = span_hashes(data, s, e), span_hashes(data, s, e, lane=1)
        slot = (h & U(SLOTS - 1)).astype(np.int64)
        entry = np.where((self.slot_hash[slot] == h) & (self.slot_check[slot] == check), self.slot_entry[slot], 0).astype(np.int64)
        new = np.flatnonzero(entry == 0)
        if len(new):
            if len(self.ids) > HELD_IDS:
                self._clear()
                entry[:] = 0
                new = np.arange(len(s))
            order = new[np.lexsort((check[new], h[new]))]
            fresh = np.ones(len(order), bool)
            fresh[1:] = (h[order[1:]] != h[order[:-1]]) | (check[order[1:]] != check[order[:-1]])
            at = order[fresh]
            raw = data.tobytes()
            learned = self._learn([raw[a:b] for a, b in zip(s[at].tolist(), e[at].tolist(), strict=True)])
            n = np.fromiter(map(len, learned), np.int64, len(learned))
            base = len(self.entry_at)
            self.entry_at = np.concatenate([self.entry_at, len(self.ids) + np.cumsum(n) - n])
            self.entry_n = np.concatenate([self.entry_n, n])
            self.ids = np.concatenate([self.ids, np.fromiter((i for x in learned for i in x), np.int32, int(n.sum()))])
            entry[order] = base + np.cumsum(fresh) - 1
            self.slot_hash[slot[at]], self.slot_check[slot[at]], self.slot_entry[slot[at]] = h[at], check[at], base + np.arange(len(at))
        n = self.entry_n[entry]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.arange(upto[-1]) + np.repeat(self.entry_at[entry] - upto[:-1], n)] if len(s) else np.zeros(0, np.int32)
        return ids, upto[np.searchsorted(s, cuts)], s, upto

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids, and each id's cuts in them."""
        n = self.byte_length[ids]
        upto = np.concatenate([[0], np.cumsum(n)])
        return self.bytes[np.arange(upto[-1]) + np.repeat(self.byte_at[ids] - upto[:-1], n)] if len(ids) else np.zeros(0, np.uint8), upto


_ENCODERS: dict[tuple, Encoder] = {}


class Vocabulary:
    """A vocabulary file, read on the driver and sent to the workers (a few MB, whatever the data). The worker's encoder is kept."""

    def __init__(self, spark, path: str, kind: str, pattern: str | None = None):
        with open(path, "rb") as f:
            self.content = spark.sparkContext.broadcast(f.read())
        self.key, self.kind, self.pattern = (path, kind, pattern), kind, pattern

    def encoder(self) -> Encoder:
        if self.key not in _ENCODERS:
            _ENCODERS[self.key] = Encoder(self.content.value, self.kind, self.pattern)
        return _ENCODERS[self.key]


def encoded(batch: pa.RecordBatch, encoder: Encoder, text: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray, tuple]]:
    """Row ranges of a batch with their ids, cuts in the ids, and ``(bytes, cuts in the bytes, chunk starts, chunks' cuts in the ids)``."""
    data, offsets = flat(batch.column(batch.schema.get_field_index(text)))
    for i, j in slices(offsets):
        part, cuts = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        ids, at, s, upto = encoder.encode(part, cuts)
        yield i, j, ids, at, (part, cuts, s, upto)


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values.astype(np.int32)))


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """``df`` with ``ids`` and the code points ``starts``, ``ends`` that the ids cover (one cut inside a character covers it whole)."""
    made = [apart(df.columns, c) for c in ("ids", "starts", "ends")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabulary.encoder()
        for batch in batches:
            for i, j, ids, at, (part, cuts, _, _) in encoded(batch, encoder, text):
                lead = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])  # code points begun before each byte
                upto = np.concatenate([[0], np.cumsum(encoder.byte_length[ids])])
                row = np.repeat(lead[cuts[:-1]], np.diff(at))
                start, end = lead[np.minimum(upto[:-1] + 1, len(part))] - 1 - row, lead[upto[1:]] - row
                rows = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*rows.columns, _lists(ids, at), _lists(start, at), _lists(end, at)], names=[*batch.schema.names, *made])

    whole = T.ArrayType(T.IntegerType())
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *[T.StructField(c, whole) for c in made]]))


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded`` (the exact bytes) and ``decoded_text`` (with replacement characters where a character is incomplete)."""
    made = [apart(df.columns, c) for c in ("decoded", "decoded_text")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabulary.encoder()
        for batch in batches:
            out = [encoder.decode(np.asarray(x or [], np.int64))[0].tobytes() for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            texts = [x.decode("utf-8", "replace") for x in out]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary()), pa.array(texts, pa.string())], names=[*batch.schema.names, *made])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(made[0], T.BinaryType()), T.StructField(made[1], T.StringType())]))
