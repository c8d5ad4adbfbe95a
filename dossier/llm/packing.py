"""Packing of token streams into windows by order-preserving dynamic programming.

Each partition's documents, in their order, are one stream of ids (each document ends with an end id). Windows
of at most ``SIZE`` ids are cut at document ends, at sentence ends, or, in long stretches without either, at regular
places. The cuts minimise padding plus a penalty for each kind of cut: with ``f(j)`` the least cost up to cut j,
``f(j) = penalty(j) + WINDOW + min over i of (f(i) + SIZE - (c_j - c_i))``, and the minimum over the cuts within ``SIZE``
comes from a monotone queue, as ``f(i) + c_i`` doesn't depend on j. A window of a power of two needs no padding.
The stream is taken in blocks; a block's last window goes on to the next. A partition's last window goes through the same
programme once more, with a cut after any id and powers of two of any size, so that it is cut further where that spares more padding than its cuts cost. No row is shuffled, and no more than a block and a batch is held.

Defined results: a null or empty text is its end id alone; repeated rows are packed each; a text of any length
is packed whole; a partition without rows gives none, an empty table an empty result.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from dossier.llm.bytepair import Vocabulary, encoded
from dossier.llm.shared import small_batches, tidy

SIZE = 2048
END_ID = 1
#: Tokens' worth of a cut at a sentence's end, anywhere else, and of one more window.
SENTENCE, ANYWHERE, WINDOW = 4, 40, 8
#: Least tokens between two cuts at sentence ends; stretches longer than LONG get a place to cut every EVERY tokens.
APART, LONG, EVERY = 12, 96, 32
BLOCK = 128 * SIZE
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def windows(cuts: np.ndarray, penalty: np.ndarray, size: int = SIZE, least: int = 128) -> list[int]:
    """Indices of the chosen cuts. A window of a power of two from ``least`` on needs no padding. ``cuts`` ascend from 0, at most ``size`` apart; the first and last are always chosen."""
    c, p = cuts.tolist(), penalty.tolist()
    n = len(c)
    cost, before = [0] * n, [0] * n
    index = dict(zip(c, range(n)))
    powers = [1 << k for k in range(least.bit_length() - 1, size.bit_length() - 1)]
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (f(i) + c_i, i), ascending in both
    for j in range(1, n):
        x = c[j]
        while c[queue[0][1]] < x - size:
            queue.popleft()
        best, at = queue[0][0] + size - x, queue[0][1]
        for w in powers:
            i = index.get(x - w)
            if i is not None and cost[i] < best:
                best, at = cost[i], i
        cost[j] = best = best + p[j] + WINDOW
        before[j] = at
        key = best + x
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    out = [n - 1]
    while out[-1]:
        out.append(before[out[-1]])
    return out[::-1]


def places(doc_ends: np.ndarray, sentence_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts (0 first) and their penalties."""
    ends = np.union1d(doc_ends, sentence_ends)
    kind = np.where(np.isin(ends, doc_ends, assume_unique=True), 0, SENTENCE)
    keep = (kind == 0) | (ends // APART != np.concatenate([[0], ends[:-1]]) // APART)
    ends, kind = ends[keep], kind[keep]
    gaps = np.diff(ends, prepend=0)
    wide = np.flatnonzero(gaps > LONG)
    if len(wide):
        more = np.concatenate([np.arange(ends[k] - gaps[k] + EVERY, ends[k], EVERY) for k in wide.tolist()])
        ends, kind = np.concatenate([ends, more]), np.concatenate([kind, np.full(len(more), ANYWHERE)])
        order = np.argsort(ends, kind="stable")
        ends, kind = ends[order], kind[order]
    return np.concatenate([[0], ends]), np.concatenate([[0], kind])


class _Stream:
    """A partition's ids that no window holds yet, and the pieces made so far."""

    def __init__(self, first_sequence: int):
        self.sequence = first_sequence
        self.parts: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []  # rows (doc_id, doc_tokens, ids before the stream, end in the stream, id is null)
        self.sentences: list[np.ndarray] = []
        self.n = 0

    def add(self, ids: np.ndarray, docs: np.ndarray, sentences: np.ndarray) -> None:
        docs[:, 3] += self.n
        self.parts.append(ids)
        self.docs.append(docs)
        self.sentences.append(sentences + self.n)
        self.n += len(ids)

    def pack(self, last: bool) -> pa.RecordBatch | None:
        ids, docs, sentences = np.concatenate(self.parts), np.concatenate(self.docs), np.concatenate(self.sentences)
        cuts, penalty = places(docs[:, 3], sentences)
        chosen = cuts[windows(cuts, penalty)]
        if last:
            fine = np.arange(chosen[-2], chosen[-1] + 1)
            kind = np.where(np.isin(fine, docs[:, 3]), 0, np.where(np.isin(fine, sentences), SENTENCE, ANYWHERE))
            chosen = np.concatenate([chosen[:-1], fine[windows(fine - fine[0], kind, least=1)[1:]]])
        else:
            chosen = chosen[:-1]
        done = int(chosen[-1])
        bounds = np.unique(np.concatenate([chosen, docs[docs[:, 3] < done, 3]]))
        out = self._pieces(ids, docs, bounds, chosen) if len(bounds) > 1 else None
        self.sequence += len(chosen) - 1
        left = docs[docs[:, 3] > done].copy()
        # The first document left may have begun before: its ids before the stream grow by those that are packed.
        if len(left):
            begun = np.concatenate([[0], docs[:-1, 3]])[docs[:, 3] > done][0]
            left[0, 2] += max(0, done - begun)
            left[:, 3] -= done
        self.parts, self.docs, self.sentences, self.n = [ids[done:]], [left], [sentences[sentences > done] - done], len(ids) - done
        return out

    def _pieces(self, ids: np.ndarray, docs: np.ndarray, bounds: np.ndarray, chosen: np.ndarray) -> pa.RecordBatch:
        a, b = bounds[:-1], bounds[1:]
        d = np.searchsorted(docs[:, 3], a, side="right")
        w = np.searchsorted(chosen, a, side="right") - 1
        begin = np.concatenate([[0], docs[:-1, 3]])
        raw = ids.astype("<u4")
        crc = [zlib.crc32(raw[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(docs[d, 0], pa.int64(), mask=docs[d, 4] == 1), pa.array(docs[d, 2] + a - begin[d], pa.int64()), pa.array(b - a, pa.int64()),
                pa.array(crc, pa.int64()), pa.array(docs[d, 1], pa.int64()), pa.array(self.sequence + w, pa.int64()), pa.array(a - chosen[w], pa.int64()),
            ],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )


def _sentence_ends(part: np.ndarray, starts: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Places in the ids where a chunk ends that closes a sentence or is followed by a line end."""
    if not len(starts):
        return np.zeros(0, np.int64)
    last = part[np.append(starts[1:], len(part)) - 1]
    closes = (last == 0x2E) | (last == 0x21) | (last == 0x3F)
    closes[:-1] |= part[starts[1:]] == 0x0A
    return upto[1:][closes]


def pack(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """One row per piece of a document in a window; see :data:`SCHEMA`. Sequence ids are unique; documents keep the partition's order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabulary.encoder()
        stream = _Stream(TaskContext.get().partitionId() << 33)
        for batch in batches:
            ids_column = batch.column(0)
            doc_ids = ids_column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            null = ids_column.is_null().to_numpy(zero_copy_only=False)
            for i, j, ids, at, (part, _, starts, upto) in encoded(batch, encoder):
                k = np.arange(1, j - i + 1)
                ends = at[1:] + k  # with an end id after each document
                whole = np.full(len(ids) + (j - i), END_ID, np.int32)
                hole = np.ones(len(whole), bool)
                hole[ends - 1] = False
                whole[hole] = ids
                rows = np.stack([doc_ids[i:j], np.diff(at) + 1, np.zeros(j - i, np.int64), ends, null[i:j].astype(np.int64)], axis=1)
                sentences = _sentence_ends(part, starts, upto)
                sentences = sentences + np.searchsorted(at[1:], sentences, side="left")
                stream.add(whole, rows, sentences[sentences > 0])
                if stream.n >= BLOCK and (out := stream.pack(last=False)) is not None:
                    yield out
        if stream.n:
            out = stream.pack(last=True)
            if out is not None:
                yield out

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(tidy(run), SCHEMA)
