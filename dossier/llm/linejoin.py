"""Exact set-similarity join of lines by their words (Jaccard of at least 3/4), on data that Spark deals out.

A line is the set of its words' 64-bit hashes (A-Z lowered); equal sets are one set, named by a hash. The steps:

1. *Survey.* All lines with their sets' names and sizes, and a sketch of bounded size that counts words over all lines.
2. *Rarity order.* A set's words are ordered by the sketch's count, then by hash: one global order for all sets, and the sketch is all that
   is broadcast. Two sets of the wanted likeness share one of the first ``n // 4 + 1`` words of each. Where that word is frequent,
   they share a second one among the first ``n // 4 + 2``, and so on: a frequent word is posted together with those that follow it, so that
   lists stay short as the corpus grows.
3. *Postings.* (word or words, set, size, place, parity map). The bits of a parity map flip with every word of its hash, so two maps
   differ in no more bits than their sets in words. Each block of words is compared in one task: length filter, positional
   filter, maps. Of each set the likeliest earlier partner is paired; postings with further partners are kept as they are, one row each.
4. *Verification* of the pairs on the sets themselves. Kept postings whose set is still open are compared again, first for some
   more partners, then for all. So every pair that could change the result is tested, and a group of near copies costs pairs in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.setjoin import MOST, REMEMBERED, Units, _signed, by_tile, each_of, each_slice, kinds, met_by, set_ids, whole_tiles, within
from dossier.llm.shared import partitions, small, tidy, written
from dossier.llm.textarrays import LOWER, U, mix, span_hashes, words

#: Cells of the sketch that counts words, and the parts in which it is added up.
CELLS, PARTS = 1 << 22, 64
#: Lines beyond which a word is posted with the words after it, and most words of a posting.
OFTEN, TOGETHER = 4096, 3
#: Postings of a block, and of a list that is compared as a whole there; a longer one goes to tiles.
BLOCK_POSTINGS, LIST = 1_000_000, 4096
#: Largest sizes of sets with parity maps of one and two words of 64 bits; larger ones have four.
MAPS = (64, 150)
#: Sets of a tile that others are compared with.
TILE = 1024
#: Partners of an open set that are tried before all others are.
SOME = 8

CELL = np.dtype([("cell", "<u2"), ("n", "<u4")])
HEAD = [("list", "<u4"), ("sid", "<u8"), ("order", "<u4"), ("n", "<u4"), ("at", "<u2")]
POSTING = [np.dtype([*HEAD, ("map", "<u8", (w,))]) for w in (1, 2, 4)]


def packed(x: np.ndarray, cuts: list[int]) -> list[bytes]:
    """The postings between the cuts, column by column and the numbers' like bytes together, which Spark's compression takes up (records of hashes have nothing to compress)."""
    flat = lambda c: np.ascontiguousarray(x[c])
    columns = [flat("list"), flat("sid"), *(p for c in ("order", "n", "at") for p in np.ascontiguousarray(flat(c).view(np.uint8).reshape(len(x), x.dtype[c].itemsize).T)), flat("map")]
    return [b"".join([c[a:b].tobytes() for c in columns]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def unpacked(raw: bytes, t: np.dtype) -> np.ndarray:
    n, at = len(raw) // t.itemsize, 0
    out = np.empty(n, t)
    for c in t.names if n else ():
        size = t[c].itemsize
        part = np.frombuffer(raw, np.uint8, n * size, at)
        part = part.reshape(size, n).T if c in ("order", "n", "at") else part.reshape(n, size)
        out[c] = np.ascontiguousarray(part).view(t[c].base).reshape(out[c].shape)
        at += n * size
    return out


def line_words(part: np.ndarray, cuts: np.ndarray) -> Units:
    """Every line of the texts ``cuts[i]:cuts[i+1]`` (split at line ends) with its words' hashes."""
    data = LOWER[part]
    breaks = np.flatnonzero(data == 0x0A)
    own = np.searchsorted(cuts, breaks, side="right") - 1  # the row of each line end
    per_row = np.bincount(own, minlength=len(cuts) - 1) + 1
    first = np.concatenate([[0], np.cumsum(per_row)])
    starts = np.sort(np.concatenate([cuts[:-1], breaks + 1]), kind="stable")
    s, e, at = words(data, np.append(starts, len(data)))
    rows = np.repeat(np.arange(len(cuts) - 1), per_row)
    return rows, np.arange(len(rows)) - first[rows], span_hashes(data, s, e), at


def _once(sid: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sid), bool)
    out[np.unique(sid, return_index=True)[1]] = True
    return out


def _repeated_runs(x: np.ndarray) -> np.ndarray:
    """Marks the values that are beside an equal one."""
    same = np.zeros(len(x) + 1, bool)
    same[1:-1] = x[1:] == x[:-1]
    return same[1:] | same[:-1]


def _repeated(x: np.ndarray) -> np.ndarray:
    """Marks the values that are there more than once."""
    o = np.argsort(x)
    out = np.empty(len(x), bool)
    out[o] = _repeated_runs(x[o])
    return out


class _Heads:
    """Marks occurrences of sets that come after another one in the same task. Places are those of :func:`dossier.llm.linededup.place`."""

    def __init__(self) -> None:
        self.known: dict[int, tuple] = {}  # sets that a slice has repeatedly, with their least place

    def later(self, sid: np.ndarray, place: tuple[np.ndarray, ...]) -> np.ndarray:
        o = np.lexsort((*place[::-1], sid))
        new = np.ones(len(o), bool)
        new[1:] = sid[o[1:]] != sid[o[:-1]]
        start = np.flatnonzero(new)
        head = o[start][np.cumsum(new) - 1]
        out = np.zeros(len(o), bool)
        out[o] = np.logical_or.reduce([c[o] != c[head] for c in place]) if len(o) else False
        count = np.diff(np.append(start, len(o)))
        for k in np.flatnonzero(count > 1).tolist():
            i = o[start[k]]
            x, at = int(sid[i]), tuple(int(c[i]) for c in place)
            if self.known.get(x, at) < at:
                out[o[start[k] : start[k] + count[k]]] = True
            else:
                self.known[x] = at
        if len(self.known) > REMEMBERED // 4:
            self.known.clear()
        return out


def survey(docs: DataFrame) -> DataFrame:
    """Written table of the lines with a word (``doc_id, version, number, sid, n, later``) and of parts of the sketch (``part, cells``). ``docs``: ``doc_id, version, text``.

    ``later`` lines are surely not the first of their set; of a set that many lines have, few other lines are left.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "version", "number", "sid", "n", "later", "part", "cells"]
        counts, held, heads = np.zeros(CELLS, np.uint32), [], _Heads()

        def add() -> None:
            nonlocal counts
            counts += np.bincount(np.concatenate(held), minlength=CELLS).astype(np.uint32)
            held.clear()

        for batch, i, (rows, number, tokens, upto) in each_slice(batches, line_words):
            n, sid = np.diff(upto), set_ids(tokens, upto)
            keep = np.flatnonzero(n)
            at = rows[keep] + i
            take = pa.array(at)
            doc, version = batch.column(0), batch.column(1).to_numpy()[at]
            place = (doc.is_valid().to_numpy(zero_copy_only=False)[at], doc.fill_null(0).to_numpy(zero_copy_only=False)[at], version, number[keep])
            yield pa.RecordBatch.from_arrays(
                [doc.take(take), pa.array(version), pa.array(number[keep], pa.int64()), _signed(sid[keep]), pa.array(n[keep], pa.int64()), pa.array(heads.later(sid[keep], place)), pa.nulls(len(keep), pa.int32()), pa.nulls(len(keep), pa.binary())],
                names=names,
            )
            # Of equal sets in a slice one counts, so that copies don't make their words frequent.
            held.append(_cell(tokens[np.repeat(_once(sid), n)]))
            if sum(map(len, held)) > CELLS // 2:
                add()
        if held:
            add()
        found = np.flatnonzero(counts)
        out = np.empty(len(found), CELL)
        out["cell"], out["n"] = found % (CELLS // PARTS), counts[found]
        cuts = np.searchsorted(found, np.arange(PARTS + 1) * (CELLS // PARTS))
        use = np.flatnonzero(np.diff(cuts))
        blank = pa.nulls(len(use), pa.int64())
        yield pa.RecordBatch.from_arrays([*[blank] * 5, pa.nulls(len(use), pa.bool_()), pa.array(use, pa.int32()), pa.array([out[cuts[k] : cuts[k + 1]].tobytes() for k in use.tolist()], pa.binary())], names=names)

    return written(docs.mapInArrow(tidy(run), "doc_id long, version long, number long, sid long, n long, later boolean, part int, cells binary"), "line-survey")


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> U(64 - CELLS.bit_length() + 1)).astype(np.int64)


def rarity(found: DataFrame) -> np.ndarray:
    """Each cell's number of words, as the fourth part of a binary logarithm in a byte (``CELLS`` bytes, whatever the data)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, cells in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(cells.as_py(), CELL)
                sums.setdefault(part, np.zeros(CELLS // PARTS))[x["cell"]] += x["n"]
        levels = [np.minimum(np.ceil(4 * np.log2(np.maximum(x, 1))), 255).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], names=["part", "levels"])

    parts = found.filter("part IS NOT NULL").select("part", "cells").repartition(min(PARTS, partitions(found.sparkSession)), "part").mapInArrow(tidy(run), "part int, levels binary").collect()
    out = np.zeros((PARTS, CELLS // PARTS), np.uint8)
    for r in parts:
        out[r["part"]] = np.frombuffer(r["levels"], np.uint8)
    return out.ravel()


def ordered(tokens: np.ndarray, cuts: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each unit's distinct words, rarest first, and the units' cuts in them."""
    n = len(cuts) - 1
    unit = np.repeat(np.arange(n), np.diff(cuts))
    level = levels[_cell(tokens)]
    if n < 1 << 20:
        key = (unit.astype(U) << U(44)) | (level.astype(U) << U(36)) | (tokens >> U(28))
        order = np.argsort(key)
        k, t = key[order], tokens[order]
        if ((k[1:] == k[:-1]) & (t[1:] < t[:-1])).any():
            order = np.lexsort((tokens, level, unit))
    else:
        order = np.lexsort((tokens, level, unit))
    t, u = tokens[order], unit[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (u[1:] != u[:-1])
    return t[new], np.concatenate([[0], np.cumsum(np.bincount(u[new], minlength=n))]).astype(np.int64)


def signatures(tokens: np.ndarray, cuts: np.ndarray, levels: np.ndarray, lines: int, most: int = OFTEN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What is posted of ordered sets: hash of the word or words, unit, and the place that bounds the overlap from there on.

    A word that over ``most`` lines have is posted with words after it. Sets of one or two words have no others than equal ones as partners, and post nothing.
    """
    n = np.diff(cuts)
    unit = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(tokens)) - cuts[unit]
    quarter = np.where(n > 2, n // 4, -1)
    level = levels[_cell(tokens)]
    whole = np.log2(max(lines, 1))
    i = np.flatnonzero((place <= quarter[unit]) & (level > 0))  # a word that the sketch counted once is in no other set
    h, u, last, seen = tokens[i], unit[i], place[i], level[i] / 4
    out = []
    for size in range(1, TOGETHER + 1):
        # ``seen`` is the logarithm of the number of lines with all the words, as if words were independent.
        often = seen > np.log2(most) if size < TOGETHER else np.zeros(len(h), bool)
        out.append((h[~often], u[~often], last[~often] - (size - 1)))
        h, u, last, seen = h[often], u[often], last[often], seen[often]
        more = np.maximum(np.minimum(n[u] - 1, quarter[u] + size) - last, 0)
        k = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1 + np.repeat(last, more)
        u, last = np.repeat(u, more), k
        at = cuts[u] + k
        h, seen = mix(np.repeat(h, more) * U(0x9E3779B97F4A7C15) + tokens[at]), np.repeat(seen, more) + level[at] / 4 - whole
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def parity_maps(tokens: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Each unit's parity map, four words of 64 bits."""
    out = np.zeros((len(cuts) - 1, 4), U)
    unit = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    bit = (mix(tokens ^ U(0x5851F42D4C957F2D)) >> U(56)).astype(np.int64)
    np.bitwise_xor.at(out, (unit, bit >> 6), U(1) << (bit & 63).astype(U))
    return out


def _kind(n: np.ndarray) -> np.ndarray:
    return (n > MAPS[0]).astype(np.int64) + (n > MAPS[1])


def _folded(maps: np.ndarray, kind: int) -> np.ndarray:
    """Maps of four words as those of ``1 << kind`` words: words flip one another."""
    if kind < 2:
        maps = maps[:, :2] ^ maps[:, 2:]
    return maps[:, :1] ^ maps[:, 1:] if kind < 1 else maps


class _Lists:
    """Postings of several lists, sorted by list, then size, with all foldings of their maps."""

    def __init__(self, lists: np.ndarray, n: np.ndarray, at: np.ndarray, order: np.ndarray, maps: np.ndarray, kind: np.ndarray):
        self.n, self.at, self.order, self.kind = n.astype(np.int64), at.astype(np.int64), order, kind
        self.maps = [_folded(maps, 0), _folded(maps, 1), maps]
        start = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]])) if len(lists) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(lists)))
        self.left = np.repeat(size, size) - (np.arange(len(lists)) - np.repeat(start, size))

    def near(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the filters leave the pairs ``i, j``, and the share of the room for differences that those take which maps show."""
        n, m = self.n[i], self.n[j]
        need = -(-3 * (n + m) // 7)
        ok = (4 * np.minimum(n, m) >= 3 * np.maximum(n, m)) & (np.minimum(n - self.at[i], m - self.at[j]) >= need)
        at = np.flatnonzero(ok)
        x, y, room = i[at], j[at], (n + m - 2 * need)[at]
        kind, differ = np.minimum(self.kind[x], self.kind[y]), np.zeros(len(x), np.int64)
        for k in range(3):
            own = kind == k
            if own.any():
                differ[own] = np.bitwise_count(self.maps[k][x[own]] ^ self.maps[k][y[own]]).sum(axis=1)
        ok[at] = differ <= room
        share = np.zeros(len(ok))
        share[at] = differ / np.maximum(room, 1)
        return ok, share

    def pairs(self, among: np.ndarray | None = None, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of postings of one list that the filters leave, with their shares. ``among``: marks the lists; ``wanted``: one of the two must be marked."""
        i, d = np.flatnonzero((self.left > 1) if among is None else (self.left > 1) & among), 1
        while len(i):
            i = i[4 * self.n[i] >= 3 * self.n[i + d]]  # sizes ascend: one that doesn't fit has none after it
            x = i if wanted is None else i[wanted[i] | wanted[i + d]]
            ok, share = self.near(x, x + d)
            if ok.any():
                yield x[ok], x[ok] + d, share[ok]
            d += 1
            i = i[self.left[i] > d]


_KEPT = "a long, b long, token long, sid long, n int, at int, first long, map binary, more boolean"


def postings(docs: DataFrame, levels: np.ndarray, lines: int, blocks: int) -> DataFrame:
    """Written table of two kinds of rows: pairs to test (``a, b``), and postings to look at again (``token, sid, n, at, first, map``; ``more``: the set has partners before it that aren't paired)."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    scale = float(MOST * MOST) / max(1, (high or 0) - (low or 0))
    sent, most, longest = docs.sparkSession.sparkContext.broadcast(levels), OFTEN, LIST

    def post(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, int] = {}
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], [], []]
        size = 0

        def flush() -> pa.RecordBatch:
            columns = []
            for k, t in enumerate(POSTING):
                block = np.concatenate([b for b, _ in held[k]]) if held[k] else np.zeros(0, np.int64)
                x = np.concatenate([x for _, x in held[k]]) if held[k] else np.zeros(0, t)
                held[k].clear()
                order = np.argsort(block.astype(np.uint16) if blocks <= MOST else block, kind="stable")  # 16 bits are sorted by their digits
                cuts = np.concatenate([[0], np.cumsum(np.bincount(block, minlength=blocks))])
                x = x[order]
                columns.append(packed(x, cuts.tolist()))
            return pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), *[pa.array(c, pa.binary()) for c in columns]], names=["block", "p0", "p1", "p2"])

        ordered_sets = lambda tokens, cuts: ordered(tokens, cuts, sent.value)
        for batch, i, (rows, _, tokens, upto) in each_slice(batches, line_words, sets=ordered_sets):
            sid, n = set_ids(tokens, upto), np.diff(upto)
            doc = batch.column(0).fill_null(low or 0).to_numpy(zero_copy_only=False)[i + rows] if len(rows) else np.zeros(0)
            order = np.minimum((doc - (low or 0)) * scale, MOST * MOST).astype(np.uint32)
            # A set is posted once by a task, unless it turns up in an earlier document.
            once = np.zeros(len(n), bool)
            first = np.lexsort((order, sid))
            first = first[np.concatenate([[True], sid[first[1:]] != sid[first[:-1]]])] if len(first) else first
            for k in first[n[first] > 2].tolist():
                x, o = int(sid[k]), int(order[k])
                if known.get(x, MOST * MOST + 1) > o:
                    once[k] = True
                    known[x] = o
            if len(known) > REMEMBERED:
                known.clear()
            keep = np.repeat(once, n)
            tokens, n, sid, order = tokens[keep], n[once], sid[once], order[once]
            upto = np.concatenate([[0], np.cumsum(n)])
            h, unit, at = signatures(tokens, upto, sent.value, lines, most)
            maps, kind = parity_maps(tokens, upto), _kind(n)
            # The high half of the mixed hash tells the block, the low half the list in it; lists that share both only make more pairs to test.
            h = mix(h)
            block = (((h >> U(32)) * U(blocks)) >> U(32)).astype(np.int64)
            for k, t in enumerate(POSTING):
                own = np.flatnonzero(kind[unit] == k)
                p = np.empty(len(own), t)
                u = unit[own]
                p["list"], p["sid"], p["order"], p["n"], p["at"] = h[own] & U(0xFFFFFFFF), sid[u], order[u], n[u], np.minimum(at[own], MOST)  # a lesser place bounds the overlap less
                p["map"] = _folded(maps[u], k)
                held[k].append((block[own], p))
            size += len(h)
            if size > 500_000:
                yield flush()
                size = 0
        if size:
            yield flush()

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[], [], []]
        block = 0
        for batch in batches:
            block = batch.column(0)[0].as_py() if batch.num_rows else block
            for k in range(3):
                parts[k] += [unpacked(x.as_py(), POSTING[k]) for x in batch.column(k + 1)]
        heads, maps, kinds = [], [], []
        rows = [np.concatenate(parts[k]) if parts[k] else np.zeros(0, POSTING[k]) for k in range(3)]
        parts.clear()
        shared = np.split(_repeated(np.concatenate([x["list"] for x in rows])), np.cumsum([len(x) for x in rows[:2]]))
        for k in range(3):
            if len(x := rows[k][shared[k]]):
                heads.append(np.stack([x["list"].astype(U) | U(block << 32), x["sid"], x["order"].astype(U), x["n"].astype(U), x["at"].astype(U)]))
                wide = np.zeros((len(x), 4), U)
                wide[:, : 1 << k] = x["map"]  # folds back to itself
                maps.append(wide)
                kinds.append(np.full(len(x), k))
            rows[k] = rows[k][:0]
        if heads:
            yield from compared(*np.concatenate(heads, axis=1), np.concatenate(maps), np.concatenate(kinds))

    def compared(token, sid, order, n, at, maps, kind) -> Iterator[pa.RecordBatch]:
        # All tokens are of one block. A set that is there more than once takes its least order; where two hashes share a list, it has two places: the least one bounds the overlap least.
        key = (token << U(32)) | (sid >> U(32))
        o = np.argsort(key)
        same = np.zeros(len(o), bool)
        same[1:] = key[o[1:]] == key[o[:-1]]
        if (same[1:] & (sid[o[1:]] != sid[o[:-1]])).any():
            o = np.lexsort((sid, token))
            same[1:] = (token[o[1:]] == token[o[:-1]]) & (sid[o[1:]] == sid[o[:-1]])
        first = np.flatnonzero(~same)
        at, order, o = np.minimum.reduceat(at[o], first) if len(o) else at, np.minimum.reduceat(order[o], first) if len(o) else order, o[first]
        use = np.flatnonzero(_repeated_runs(token[o]))
        at, order, o = at[use], order[use], o[use]
        # By list, then size, 32 bits of each: all tokens differ in their low halves.
        by = np.argsort((token[o] << U(32)) | n[o])
        at, order, o = at[by], order[by], o[by]
        token, sid, n, maps, kind = token[o], sid[o], n[o], maps[o], kind[o]
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        count = np.repeat(np.diff(np.append(start, len(o))), np.diff(np.append(start, len(o))))
        best, score, partners = np.full(len(o), -1), np.full(len(o), np.inf), np.zeros(len(o), np.int64)
        touched = np.zeros(len(o), bool)

        def offer(x: np.ndarray, y: np.ndarray, near: np.ndarray) -> None:
            """``y`` as partner of ``x``; no place occurs twice in ``x``."""
            may = order[y] <= order[x]
            x, y, near = x[may], y[may], near[may]
            partners[x] += 1
            better = (near < score[x]) | ((near == score[x]) & (order[y] < order[best[x]]))
            best[x[better]], score[x[better]] = y[better], near[better]

        whole = count <= longest
        lists = _Lists(token, n, at, order, maps, kind)
        for x, y, near in lists.pairs(whole):
            touched[x] = touched[y] = True
            offer(x, y, near)
            offer(y, x, near)
        # Long lists: each posting beside the earliest one of about its size; all of them are looked at again.
        for a, b in _runs(token, lists.n, np.flatnonzero(~whole)):
            rest = np.arange(a, b)
            lead = np.full(b - a, a + int(np.argmin(order[a:b])))
            ok = lists.near(rest, lead)[0] & (rest != lead)
            best[rest[ok]] = lead[ok]
            partners[a:b], touched[a:b] = 2, True
        x = np.flatnonzero(best >= 0)
        pairs = np.stack([sid[x], sid[best[x]]])
        pairs = np.unique(pairs, axis=1) if len(x) else pairs
        # A list is looked at again if some set of it has further partners.
        again = np.zeros(len(o), bool)
        if len(o):
            start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            again = np.repeat(np.maximum.reduceat(partners, start) > 1, np.diff(np.append(start, len(o)))) & touched
        y = np.flatnonzero(again)
        empty = lambda k, t: pa.nulls(k, t)
        names = [c.split()[0] for c in _KEPT.split(", ")]
        yield pa.RecordBatch.from_arrays([_signed(pairs[0]), _signed(pairs[1]), *[empty(pairs.shape[1], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.bool_())]], names=names)
        for c in range(0, len(y), 100_000):
            z = y[c : c + 100_000]
            raw = [maps[k, : 1 << kind[k]].tobytes() for k in z.tolist()]
            yield pa.RecordBatch.from_arrays(
                [empty(len(z), pa.int64()), empty(len(z), pa.int64()), _signed(token[z]), _signed(sid[z]), pa.array(n[z].astype(np.int32)), pa.array(at[z].astype(np.int32)), pa.array(order[z].astype(np.int64)), pa.array(raw, pa.binary()), pa.array(partners[z] > 1)],
                names=names,
            )

    posted = docs.mapInArrow(tidy(post), "block int, p0 binary, p1 binary, p2 binary").repartitionById(blocks, F.col("block"))
    return written(posted.mapInArrow(tidy(meet), _KEPT), "line-postings")


def _runs(token: np.ndarray, n: np.ndarray, i: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of ``i`` (ascending) with one token and sizes within a sixth of their least."""
    k = 0
    while k < len(i):
        end = int(np.searchsorted(token[i], token[i[k]], side="right"))
        j = k + int(np.searchsorted(n[i[k:end]], n[i[k]] + n[i[k]] // 6, side="right"))
        yield int(i[k]), int(i[j - 1]) + 1
        k = j


def _beside(rows: DataFrame) -> DataFrame:
    """``rows`` (``token, sid, n, at, open`` and more) dealt to tiles, with ``tile`` and ``other``.

    A list of at most ``TILE`` sets is one tile. In a longer one, open sets ask and all sets (``other``) are asked. The sets of each kind (:func:`dossier.llm.setjoin.kinds`)
    are dealt to parts of about ``TILE``, and so are those that may ask them; a tile is a part of both. So place and size are filtered
    before rows are copied, and a tile is bounded whatever the number of open sets.
    """
    rows = kinds(rows)
    counts = written(rows.groupBy("token", "kind").agg(F.count(F.lit(1)).alias("sets"), F.count_if("open").alias("asking")), "line-counts", narrow=True)
    entry = lambda c, n: F.map_from_entries(F.collect_list(F.struct("kind", n))).alias(c)
    per = counts.groupBy("token").agg(F.sum("sets").alias("all"), entry("parts", F.ceil(F.col("sets") / TILE).cast("int")), entry("asking", F.col("asking")))
    askers = lambda k: F.aggregate(met_by(k), F.lit(0).cast("long"), lambda n, j: n + F.coalesce(F.try_element_at("asking", j), F.lit(0)))
    long_ = per.filter(F.col("all") > TILE).select("token", "parts", F.transform_values("parts", lambda k, _: F.ceil(askers(k) / TILE).cast("int")).alias("asks"))
    rows = rows.join(small(written(long_, "line-long", narrow=True)), "token", "left")
    kind, parts, asks = F.col("kind"), lambda k: F.try_element_at("parts", k), lambda k: F.try_element_at("asks", k)
    dealt = lambda n: F.pmod(F.xxhash64("sid"), F.greatest(n, F.lit(1))).cast("int")
    role = lambda tile, opened, other: F.struct(tile.alias("tile"), opened.alias("open"), other.alias("other"))
    yes, no = F.lit(True), F.lit(False)
    asked = each_of(asks(kind), lambda j: role(F.xxhash64("token", kind, dealt(parts(kind)), j), no, yes))
    whom = F.filter(met_by(kind), lambda k: within(F.col("reach"), k))
    asking = F.flatten(F.transform(whom, lambda k: each_of(parts(k), lambda i: role(F.xxhash64("token", k, i, dealt(asks(k))), yes, no))))
    roles = F.when(F.col("parts").isNull(), F.array(role(F.xxhash64("token"), F.col("open"), yes))).when(F.col("open"), F.concat(asked, asking)).otherwise(asked)
    return rows.withColumn("r", F.explode(roles)).select("r.tile", "sid", "n", "at", "first", "map", "r.open", "r.other")


def further_pairs(kept: DataFrame, most: int | None) -> DataFrame:
    """Pairs ``a, b`` of an ``open`` set and one before it (or as early, by ``first``) from kept postings: of each tile the ``most`` likeliest, or all."""

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.take(pa.array(np.lexsort((t.column("n").to_numpy(), t.column("tile").to_numpy()))))
        tile, sid, n, at, first = (t.column(c).to_numpy().astype(np.int64) for c in ("tile", "sid", "n", "at", "first"))
        opened, other = (t.column(c).to_numpy().astype(bool) for c in ("open", "other"))
        maps = np.zeros((len(sid), 4), U)
        raw = t.column("map").to_pylist()
        length = np.fromiter(map(len, raw), np.int64, len(raw)) // 8
        for k in (1, 2, 4):
            own = np.flatnonzero(length == k)
            maps[own, :k] = np.frombuffer(b"".join(raw[x] for x in own.tolist()), U).reshape(-1, k)
        found: list[np.ndarray] = []

        def some() -> None:
            x = np.concatenate(found, axis=1)
            found.clear()
            x = x[:, np.lexsort((x[2], x[0]))]
            place = np.arange(x.shape[1]) - np.searchsorted(x[0], x[0], side="left")
            found.append(x[:, place < most])

        out = lambda x, y: pa.RecordBatch.from_arrays([pa.array(sid[x]), pa.array(sid[y])], names=["a", "b"])
        for x, y, near in _Lists(tile, n, at, first, maps, _kind(n)).pairs(wanted=opened):
            x, y, near = np.concatenate([x, y]), np.concatenate([y, x]), np.tile(near, 2)
            ok = opened[x] & other[y] & (first[y] <= first[x]) & (sid[x] != sid[y])
            if most is None:
                yield out(x[ok], y[ok])
            elif ok.any():
                found.append(np.stack([x[ok], y[ok], near[ok]]))
                if sum(f.shape[1] for f in found) > 500_000:
                    some()
        if found:
            some()
            yield out(*found[0][:2].astype(np.int64))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return whole_tiles(batches, compare)

    return by_tile(_beside(kept)).mapInArrow(tidy(run), "a long, b long").distinct()


def counted(docs: DataFrame, lines: DataFrame) -> tuple[int, int]:
    """The number of ``lines``, and of blocks of postings: as many as shuffle partitions, more if a block would hold over ``BLOCK_POSTINGS``."""
    n, total = lines.agg(F.count(F.lit(1)), F.sum(F.expr("n div 4 + 1"))).first()
    return n, max(partitions(docs.sparkSession), (total or 0) // BLOCK_POSTINGS + 1)
