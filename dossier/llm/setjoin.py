"""Exact set-similarity joins of shingle sets (Jaccard of at least 3/4), for documents. Lines use some of it (:mod:`.linejoin`).

Units are the sets of their shingles' 64-bit hashes; equal sets are one unit, named by a
64-bit hash of the set. The steps, all on data that Spark deals out:

1. *Rarity order.* Shingles seen repeatedly are counted over all rows; the most frequent ones (a bounded table) come last in a global
   order, all others are ordered by hash. Any global order gives exact results; this one keeps common passages out of the prefixes.
2. *Postings.* Two sets of the wanted likeness share one of the first ``n // 4 + 1`` shingles of each. A posting is (shingle, set,
   size, place in the prefix). Postings are grouped within each batch first; one per shingle and batch is shuffled, in packed blocks.
3. *Leaders.* Each shingle's postings are paired with the earliest set among them, a number of pairs linear in the postings. Length
   and positional filters drop pairs; the others are verified by intersecting the sorted sets.
4. *Tiles.* Shingles whose postings the verified links don't settle are taken up again: their sets fall in bands of sizes and blocks of
   bounded length, and pairs of blocks of the same or the next band are compared by hashed bitmaps, whose bit counts bound the overlap from
   above. What passes is verified. Every pair that could change the result is thereby tested.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.shared import partitions, small, tidy, written
from dossier.llm.textarrays import LOWER, U, flat, mix, shingles, slices, span_hashes, words

#: Words of a shingle.
K = 5
#: Entries of the table of frequent shingles, and sets in a block of a tile.
FREQUENT, BLOCK = 400_000, 1024
#: Postings of a block, which a task holds at once.
BLOCK_POSTINGS = 1_000_000
#: Sets that a task keeps in mind to post each only once; shingles among which it looks for repeated ones.
REMEMBERED, COUNTED = 500_000, 1_000_000
#: Bytes of text that are worked on at once, and of bitmaps.
SLICE, BITMAP_BYTES = 1 << 20, 4 << 20
POSTING = np.dtype([("token", "<u8"), ("sid", "<u8"), ("order", "<u4"), ("n", "<u2"), ("at", "<u2")])
LEADER = np.dtype([("token", "<u8"), ("sid", "<u8"), ("n", "<u2"), ("at", "<u2"), ("leader", "<u8"), ("leader_n", "<u2"), ("leader_at", "<u2")])
MOST = 65535

Units = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # row, number in the row, shingles, cuts


def document_units(part: np.ndarray, cuts: np.ndarray) -> Units:
    data = LOWER[part]
    s, e, at = words(data, cuts)
    tokens, upto = shingles(span_hashes(data, s, e), at, K)
    rows = np.arange(len(cuts) - 1)
    return rows, np.zeros(len(rows), np.int64), tokens, upto


def distinct_sets(tokens: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each unit's distinct shingles, ascending, and the units' cuts in them."""
    n = len(cuts) - 1
    unit = np.repeat(np.arange(n), np.diff(cuts))
    if n < 1 << 20:
        key = (unit.astype(U) << U(44)) | (tokens >> U(20))
        order = np.argsort(key)
        k, t = key[order], tokens[order]
        if ((k[1:] == k[:-1]) & (t[1:] < t[:-1])).any():
            order = np.lexsort((tokens, unit))
    else:
        order = np.lexsort((tokens, unit))
    t, u = tokens[order], unit[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (u[1:] != u[:-1])
    return t[new], np.concatenate([[0], np.cumsum(np.bincount(u[new], minlength=n))]).astype(np.int64)


def set_ids(tokens: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(tokens ^ U(0xA0761D6478BD642F)), dtype=U)])
    return mix(total[cuts[1:]] - total[cuts[:-1]] + np.diff(cuts).astype(U))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def each_slice(batches: Iterable[pa.RecordBatch], units: Callable, text: str = "text", sets: Callable = distinct_sets) -> Iterator[tuple[pa.RecordBatch, int, Units]]:
    for batch in batches:
        data, offsets = flat(batch.column(batch.schema.get_field_index(text)))
        for i, j in slices(offsets, SLICE):
            rows, number, tokens, upto = units(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            tokens, upto = sets(tokens, upto)
            yield batch, i, (rows, number, tokens, upto)


def inventory(docs: DataFrame, units: Callable, every: bool) -> DataFrame:
    """Written table of the units (``doc_id, version, number, sid, n, bits``; ``every``: also those without a shingle) and of repeated shingles (``token, seen``).

    ``docs``: ``doc_id, version, text``.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "version", "number", "sid", "n", "bits", "token", "seen"]
        held: list[np.ndarray] = []

        def repeated() -> pa.RecordBatch:
            t = np.sort(np.concatenate(held))
            held.clear()
            start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
            seen = np.diff(np.append(start, len(t)))
            often = seen > 1
            blank = pa.nulls(int(often.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([blank, blank, blank, blank, blank, pa.nulls(len(blank), pa.binary()), _signed(t[start[often]]), pa.array(seen[often], pa.int64())], names=names)

        for batch, i, (rows, number, tokens, upto) in each_slice(batches, units):
            n, sid = np.diff(upto), set_ids(tokens, upto)
            keep = np.arange(len(n)) if every else np.flatnonzero(n)
            take = pa.array(rows[keep] + i)
            blank = pa.nulls(len(keep), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(number[keep], pa.int64()), _signed(sid[keep]), pa.array(n[keep], pa.int64()), pa.array(bitmaps(tokens, upto)[keep].tolist(), pa.binary()), blank, blank], names=names)
            # Of equal sets in a slice one counts, so that copies don't make their shingles frequent.
            once = np.zeros(len(n), bool)
            once[np.unique(sid, return_index=True)[1]] = True
            held.append(tokens[np.repeat(once, n)])
            if sum(map(len, held)) > COUNTED:
                yield repeated()
        if held:
            yield repeated()

    return written(docs.mapInArrow(tidy(run), "doc_id long, version long, number long, sid long, n long, bits binary, token long, seen long"), "set-units")


def frequent(units: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent shingles (ascending), their ranks, rarest first, and marks of their low bits: a table of at most ``FREQUENT`` entries."""
    top = units.filter("token IS NOT NULL").groupBy("token").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "token").limit(FREQUENT).toPandas()
    token = top["token"].to_numpy(np.int64).view(U)
    order = np.argsort(token)
    marks = np.zeros(1 << 22, bool)
    marks[(token & U(len(marks) - 1)).astype(np.int64)] = True
    return token[order], (len(token) - 1 - order).astype(np.int64), marks


def prefixes(tokens: np.ndarray, cuts: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of the prefixes' shingles, their units, and their places in the order."""
    n = np.diff(cuts)
    unit = np.repeat(np.arange(len(n)), n)
    want = n // 4 + 1
    known, rank, marks = table
    at, common = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
    maybe = np.flatnonzero(marks[(tokens & U(len(marks) - 1)).astype(np.int64)])
    if len(maybe):
        at[maybe] = np.minimum(np.searchsorted(known, tokens[maybe]), len(known) - 1)
        common[maybe] = known[at[maybe]] == tokens[maybe]
    upto = np.concatenate([[0], np.cumsum(~common)])
    place = upto[:-1] - upto[cuts[:-1]][unit]
    rare = np.diff(upto[cuts]) if len(n) else n
    f = np.flatnonzero(common & (rare < want)[unit])
    if len(f):
        f = f[np.lexsort((rank[at[f]], unit[f]))]
        begin = np.searchsorted(unit[f], unit[f], side="left")
        place[f] = rare[unit[f]] + np.arange(len(f)) - begin
    chosen = (~common | (rare < want)[unit]) & (place < want[unit])
    i = np.flatnonzero(chosen)
    return i, unit[i], place[i]


def _with_leaders(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Postings sorted by shingle, the earliest set of each shingle alone; and those of shared shingles with their leaders."""
    p = p[np.argsort(p["token"])]
    new = np.ones(len(p), bool)
    new[1:] = p["token"][1:] != p["token"][:-1]
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(p)))
    shared = np.repeat(count > 1, count)
    if not shared.any():
        return p, np.zeros(0, LEADER)
    s = p[shared]
    s = s[np.lexsort((s["sid"], s["order"], s["token"]))]
    new = np.ones(len(s), bool)
    new[1:] = s["token"][1:] != s["token"][:-1]
    lead = s[new]
    of = np.cumsum(new) - 1
    out = np.empty(len(s), LEADER)
    for c in ("token", "sid", "n", "at"):
        out[c] = s[c]
    out["leader"], out["leader_n"], out["leader_at"] = lead["sid"][of], lead["n"][of], lead["at"][of]
    single = np.concatenate([p[~shared], lead])
    return single[np.argsort(single["token"])], out


def _firsts(x: np.ndarray, *columns: str) -> np.ndarray:
    """Marks rows that differ from the row before in one of ``columns``."""
    new = np.ones(len(x), bool)
    new[1:] = np.logical_or.reduce([x[c][1:] != x[c][:-1] for c in columns])
    return new


def _as_postings(led: np.ndarray) -> np.ndarray:
    out = np.zeros(len(led), POSTING)
    for c in ("token", "sid", "n", "at"):
        out[c] = led[c]
    return out


def _plausible(n, at, m, bt):
    """Length and positional filters; saturated values pass."""
    n, at, m, bt = (x.astype(np.int64) for x in (n, at, m, bt))
    open_ = (n == MOST) | (m == MOST) | (at == MOST) | (bt == MOST)
    long_ = 4 * np.minimum(n, m) >= 3 * np.maximum(n, m)
    need = -(-3 * (n + m) // 7)
    return open_ | (long_ & (np.minimum(n - at, m - bt) >= need))


def shared_postings(docs: DataFrame, units: Callable, table: tuple[np.ndarray, np.ndarray, np.ndarray], blocks: int) -> DataFrame:
    """Written table of two kinds of rows: pairs to test (``sid, leader``; no ``token``), and postings (``token, sid, n, at``) of shingles that three sets or more have.

    Rows of both kinds may repeat.
    """
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    scale = float(MOST * MOST) / max(1, (high or 0) - (low or 0))
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def post(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            single, led = _with_leaders(np.concatenate(held))
            held.clear()
            # Prefixes hold the least hashes of their sets, so the block comes from a hash of the shingle.
            block = lambda x: (((mix(x["token"]) >> U(32)) * U(blocks)) >> U(32)).astype(np.int64)
            single, led = single[np.argsort(block(single), kind="stable")], led[np.argsort(block(led), kind="stable")]
            edges = np.arange(blocks + 1)
            a, b = np.searchsorted(block(single), edges), np.searchsorted(block(led), edges)
            use = [k for k in range(blocks) if a[k] < a[k + 1]]
            return pa.RecordBatch.from_arrays(
                [pa.array(use, pa.int32()), pa.array([single[a[k] : a[k + 1]].tobytes() for k in use], pa.binary()), pa.array([led[b[k] : b[k + 1]].tobytes() for k in use], pa.binary())],
                names=["block", "postings", "led"],
            )

        for batch, i, (rows, _, tokens, upto) in each_slice(batches, units):
            sid, n = set_ids(tokens, upto), np.diff(upto)
            once = np.zeros(len(n), bool)
            for k in np.unique(sid, return_index=True)[1].tolist():
                if n[k] and (x := int(sid[k])) not in known:
                    once[k] = True
                    known.add(x)
            if len(known) > REMEMBERED:
                known.clear()
            at, unit, place = prefixes(tokens, upto, sent.value)
            keep = once[unit]
            at, unit, place = at[keep], unit[keep], place[keep]
            p = np.empty(len(at), POSTING)
            doc = batch.column(0).fill_null(low or 0).to_numpy(zero_copy_only=False)[i + rows[unit]] if len(at) else np.zeros(0)
            p["token"], p["sid"], p["order"] = tokens[at], sid[unit], np.minimum((doc - (low or 0)) * scale, MOST * MOST).astype(np.uint32)
            p["n"], p["at"] = np.minimum(n[unit], MOST), np.minimum(place, MOST)
            held.append(p)
            size += len(p)
            if size > 250_000:
                yield flush()
                size = 0
        if size:
            yield flush()

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, twos, wide = [], [], []
        names = ["token", "sid", "n", "at", "leader"]

        def tested(led: np.ndarray) -> pa.RecordBatch:
            x = led[_plausible(led["n"], led["at"], led["leader_n"], led["leader_at"]) & (led["sid"] != led["leader"])]
            x = x[np.lexsort((x["leader"], x["sid"]))]
            x = x[_firsts(x, "sid", "leader")]
            return pa.RecordBatch.from_arrays([pa.nulls(len(x), pa.int64()), _signed(x["sid"]), *[pa.nulls(len(x), pa.int32())] * 2, _signed(x["leader"])], names=names)

        def lists(x: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([_signed(x["token"]), _signed(x["sid"]), pa.array(x["n"].astype(np.int32)), pa.array(x["at"].astype(np.int32)), pa.nulls(len(x), pa.int64())], names=names)

        for batch in batches:
            for postings, led in zip(batch.column(1), batch.column(2), strict=True):
                parts.append(np.frombuffer(postings.as_py(), POSTING))
                if len(x := np.frombuffer(led.as_py(), LEADER)):
                    yield tested(x)
                    start = np.flatnonzero(_firsts(x, "token"))
                    count = np.diff(np.append(start, len(x)))
                    more = np.repeat(count > 2, count)
                    if more.any():
                        yield lists(x[more])
                        wide.append(x["token"][start[count > 2]])
                    twos.append(_as_postings(x[~more]))
        if parts:
            p = np.concatenate(parts)
            p = p[np.lexsort((p["sid"], p["token"]))]
            led = _with_leaders(p[_firsts(p, "token", "sid")])[1]
            if len(led):
                yield tested(led)
            # A shingle of two sets is settled by testing that pair.
            rest = np.concatenate([*twos, _as_postings(led)])
            rest = rest[np.lexsort((rest["sid"], rest["token"]))]
            rest = rest[_firsts(rest, "token", "sid")]
            count = np.diff(np.append(np.flatnonzero(_firsts(rest, "token")), len(rest)))
            more = np.repeat(count > 2, count)
            if wide:
                more |= np.isin(rest["token"], np.concatenate(wide))
            if more.any():
                yield lists(rest[more])

    posted = docs.mapInArrow(tidy(post), "block int, postings binary, led binary").repartitionById(blocks, F.col("block"))
    return written(posted.mapInArrow(tidy(meet), "token long, sid long, n int, at int, leader long"), "set-postings")


def bitmaps(tokens: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Each unit's bitmap: a power of two of bits, at least four for each shingle."""
    n = np.diff(cuts)
    size = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(n, 1) * 4)).astype(np.int64))
    unit = np.repeat(np.arange(len(n)), n)
    out = np.empty(len(n), object)
    for s in np.unique(size).tolist():
        own = np.flatnonzero(size == s)
        row = np.full(len(n), -1)
        row[own] = np.arange(len(own))
        mine = row[unit] >= 0
        bits = np.zeros(len(own) * s, bool)
        bits[row[unit[mine]] * s + ((tokens[mine] >> U(7)) & U(s - 1)).astype(np.int64)] = True
        packed = np.packbits(bits).reshape(len(own), -1)
        for k, x in zip(own.tolist(), packed, strict=True):
            out[k] = x.tobytes()
    return out


def set_bits(nodes: DataFrame, posted: DataFrame) -> DataFrame:
    """Written table ``sid, n, bits, copies`` (units that have the set) of the sets in ``posted``. ``nodes``: units of the inventory."""
    named = written(posted.select("sid").unionByName(posted.filter("leader IS NOT NULL").select(F.col("leader").alias("sid"))).distinct(), "set-names", narrow=True)
    found = nodes.filter("n > 0").join(small(named), "sid", "left_semi")
    return written(found.groupBy("sid").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.count(F.lit(1)).alias("copies")), "set-bits")


def leader_pairs(posted: DataFrame) -> DataFrame:
    return posted.filter("leader IS NOT NULL").select(F.col("sid").alias("a"), F.col("leader").alias("b"))


def wide_postings(posted: DataFrame) -> DataFrame:
    """Postings of shingles whose sets aren't all paired with their leader alone."""
    return posted.filter("token IS NOT NULL").select("token", "sid", "n", "at")


def bounded(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """Written table of the distinct ``pairs`` (``a, b``) whose bitmaps leave room for the wanted overlap."""
    side = lambda c: bits.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.num_rows
            n = np.concatenate([batch.column(2).to_numpy(), batch.column(3).to_numpy()])
            fits = _Maps([*batch.column(4).to_pylist(), *batch.column(5).to_pylist()], n).fits(np.arange(k), np.arange(k) + k)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(fits)) for c in batch.columns[:2]], names=["a", "b"])

    joined = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
    return written(joined.mapInArrow(tidy(run), "a long, b long"), "bounded-pairs", narrow=True)


def verified(pairs: DataFrame, docs: DataFrame, units: Callable, nodes: DataFrame, later: bool = False) -> DataFrame:
    """Written table of the ``pairs`` (``a, b``, written) whose sets have a Jaccard likeness of at least 3/4.

    The sorted shingles are taken anew from one row that holds each set (``nodes``: units of the inventory). ``later``: with a column ``later``, the set of the two
    whose first place in its row (by ``doc_id, version, number``, a null doc_id first) comes later.
    """
    asked = written(pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct(), "sets-asked", narrow=True)
    holders = nodes.select("sid", "doc_id", "version").join(small(asked), "sid", "left_semi").groupBy("sid").agg(F.min(F.struct("doc_id", "version")).alias("at"))
    wanted = holders.groupBy(F.col("at.doc_id").alias("__d"), F.col("at.version").alias("__v")).agg(F.collect_list("sid").alias("sids"))
    rows = docs.join(small(written(wanted, "sets-wanted", narrow=True)), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("version") == F.col("__v"))).select("doc_id", "version", "text", "sids")

    def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, (rows, number, tokens, upto) in each_slice(batches, units):
            sid = set_ids(tokens, upto).view(np.int64)
            out: dict[int, tuple[bytes, int, int]] = {}
            lists = batch.column(3)
            for row in np.unique(rows).tolist():
                ask = set(lists[i + row].as_py())
                for k in range(*np.searchsorted(rows, [row, row + 1]).tolist()):
                    if (x := int(sid[k])) in ask and x not in out:
                        out[x] = tokens[upto[k] : upto[k + 1]].tobytes(), i + row, int(number[k])
            if out:
                elements, at, numbers = zip(*out.values(), strict=True)
                columns, take = [pa.array(list(out), pa.int64()), pa.array(elements, pa.binary())], pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*columns, *([batch.column(0).take(take), batch.column(1).take(take), pa.array(numbers, pa.int64())] if later else [])], names=["sid", "elements", *place])

    place = ["doc_id", "version", "number"] if later else []
    sets = written(rows.mapInArrow(tidy(fetch), ", ".join(["sid long, elements binary", *[f"{c} long" for c in place]])), "set-elements").dropDuplicates(["sid"])
    side = lambda c, elements: sets.select(F.col("sid").alias(c), F.col("elements").alias(elements), *([F.struct(F.col("doc_id").isNotNull().alias("known"), *place).alias(f"first_{c}")] if later else []))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(4 * both >= 3 * (len(x) + len(y) - both))
            kept = [c.filter(pa.array(good, pa.bool_())) for c in (*batch.columns[:2], *batch.columns[4:])]
            yield pa.RecordBatch.from_arrays(kept, names=["a", "b", *(["later"] if later else [])])

    joined = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y", *([F.when(F.col("first_a") > F.col("first_b"), F.col("a")).otherwise(F.col("b")).alias("later")] if later else []))
    return written(joined.mapInArrow(tidy(run), "a long, b long" + (", later long" if later else "")), "set-links", narrow=True)


def popular_pairs(members: DataFrame) -> DataFrame:
    """Of each shingle, pairs of every ``open`` set with the set that most units have: again linear in the postings. ``members``: ``token, sid, n, at, open, copies``."""
    top = members.groupBy("token").agg(F.max_by(F.struct("sid", "n", "at"), F.struct("copies", "sid")).alias("top"))
    n, m = F.col("n"), F.col("top.n")
    fits = (4 * F.least(n, m) >= 3 * F.greatest(n, m)) & (7 * F.least(n - F.col("at"), m - F.col("top.at")) >= 3 * (n + m)) | (F.greatest(n, m) == MOST)
    rows = members.filter("open").join(top, "token").filter((F.col("sid") != F.col("top.sid")) & fits)
    return rows.select(F.col("sid").alias("a"), F.col("top.sid").alias("b")).distinct()


class _Maps:
    """Bitmaps of several sets, stacked by length once for all comparisons."""

    def __init__(self, maps: list[bytes], n: np.ndarray):
        self.n, self.length = n, np.fromiter(map(len, maps), np.int64, len(maps))
        self.at, self.stacks = np.zeros(len(maps), np.int64), {}
        for size in np.unique(self.length).tolist():
            own = np.flatnonzero(self.length == size)
            self.at[own] = np.arange(len(own))
            self.stacks[size] = np.frombuffer(b"".join(maps[k] for k in own.tolist()), np.uint8).reshape(-1, size)

    def fits(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the bitmaps leave room for the wanted overlap of the sets ``i`` and ``j``: a bit that one has alone is an element that isn't shared."""
        ok, n, at = np.zeros(len(i), bool), self.n, self.at
        kind = self.length[i] * (1 << 40) + self.length[j]
        for k in np.unique(kind).tolist():
            x, y = k >> 40, k & ((1 << 40) - 1)
            low = min(x, y)
            rows = np.flatnonzero(kind == k)
            for c in range(0, len(rows), max(1, BITMAP_BYTES // max(x, y))):
                r = rows[c : c + max(1, BITMAP_BYTES // max(x, y))]
                # A larger map folds onto a smaller one.
                one = np.bitwise_or.reduce(self.stacks[x][at[i[r]]].reshape(len(r), -1, low), axis=1)
                two = np.bitwise_or.reduce(self.stacks[y][at[j[r]]].reshape(len(r), -1, low), axis=1)
                one_alone = np.bitwise_count(one & ~two).sum(axis=1, dtype=np.int64)
                two_alone = np.bitwise_count(two & ~one).sum(axis=1, dtype=np.int64)
                ok[r] = 7 * np.minimum(n[i[r]] - one_alone, n[j[r]] - two_alone) >= 3 * (n[i[r]] + n[j[r]])
        return ok


def kinds(rows: DataFrame) -> DataFrame:
    """``rows`` (``n, at`` and more) with ``kind`` and ``reach``, which say before any row is copied whom it can be like.

    By the positional filter a set of size n with a shingle at place p has partners of at most ``(4 * n - 7 * p) / 3`` elements, which hold
    for both sides. ``reach`` is the band of that size, as sizes in a band differ by less than a third. A set that is beyond its own reach (late) is met by smaller ones alone, so
    two late ones are never alike. ``kind`` is twice the set's own band, and one more where it is late.
    """
    band = lambda n: F.floor(F.ln(n) / F.ln(F.lit(4 / 3)) + 1e-9).cast("int")
    n, at = F.col("n").cast("long"), F.when(F.col("at") < MOST, F.col("at")).otherwise(F.lit(0)).cast("long")  # a saturated place bounds nothing
    return rows.withColumn("kind", 2 * band(n) + (7 * at > n).cast("int")).withColumn("reach", band(F.greatest(F.floor((4 * n - 7 * at) / 3), F.lit(1))))


def met_by(kind: Column) -> Column:
    """The kinds whose sets can be alike those of ``kind``: none if both are late, and of an early and a late one the early one is smaller."""
    return F.when(kind % 2 == 0, F.array(*[kind + d for d in (-2, 0, 1, 2, 3)])).otherwise(F.array(kind - 3, kind - 1))


def within(reach: Column, kind: Column) -> Column:
    return F.shiftright(kind, 1) <= reach


def each_of(n: Column, f: Callable) -> Column:
    """``f`` of 0 to ``n - 1``; nothing where ``n`` is 0 or null."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), f)).otherwise(F.array())


def tiled(rows: DataFrame) -> DataFrame:
    """``rows`` (``token, sid, n, at`` and more) with ``tile`` and ``side``: rows of one shingle that can be alike by size and place meet in a tile, in one that holds ``2 * BLOCK`` rows or few more.

    Rows of one ``side`` have another tile for each other; a tile of side 2 compares all its rows.
    """
    rows = kinds(rows)
    counts = written(rows.groupBy("token", "kind").agg(F.count(F.lit(1)).alias("sets")), "tile-counts", narrow=True)
    per = counts.groupBy("token").agg(F.sum("sets").alias("sets"), F.map_from_entries(F.collect_list(F.struct("kind", F.ceil(F.col("sets") / BLOCK).cast("int").alias("n")))).alias("blocks"))
    rows = rows.join(small(written(per.filter(F.col("sets") > BLOCK).select("token", "blocks"), "tile-blocks", narrow=True)), "token", "left")
    kind = F.col("kind")
    blocks = lambda k: F.try_element_at("blocks", k)
    block = F.pmod(F.xxhash64("sid"), F.coalesce(blocks(kind), F.lit(1))).cast("int")
    key = lambda low, high, i, j, side: F.struct(F.xxhash64("token", low, high, i, j).alias("tile"), side.alias("side"))
    two, zero = F.lit(2), F.lit(0)
    side = lambda mine, other: F.when(mine == other, two).otherwise((mine > other).cast("int"))

    def keys(other: Column) -> Column:
        ranked = lambda j: F.when(kind < other, F.col("block")).otherwise(j)
        beside = each_of(blocks(other), lambda j: key(F.least(kind, other), F.greatest(kind, other), ranked(j), F.when(kind < other, j).otherwise(F.col("block")), side(kind, other)))
        own = each_of(blocks(kind), lambda j: key(kind, kind, F.least(F.col("block"), j), F.greatest(F.col("block"), j), side(F.col("block"), j)))
        return F.when(kind == other, own).otherwise(beside)

    whom = F.filter(met_by(kind), lambda k: within(F.col("reach"), k))
    roles = F.when(F.col("blocks").isNull(), F.array(key(zero, zero, zero, zero, two))).otherwise(F.flatten(F.transform(whom, keys)))
    return rows.withColumn("block", block).withColumn("r", F.explode(roles)).drop("kind", "reach", "blocks", "block").select("*", "r.tile", "r.side").drop("r")


def whole_tiles(batches: Iterable[pa.RecordBatch], work: Callable) -> Iterator[pa.RecordBatch]:
    """``work`` on tables of whole tiles; rows come sorted by their first column, the tile, and the last tile of a batch may go on in the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        tile = batch.column(0).to_numpy()
        differ = np.flatnonzero(tile != tile[-1]) if len(tile) else tile
        last = int(differ[-1]) + 1 if len(differ) else 0
        if len(tile) and held and held[-1].column(0)[-1].as_py() != tile[0]:
            yield from work(pa.Table.from_batches(held))
            held = []
        if last:
            yield from work(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = []
        if last < len(tile):
            held.append(batch.slice(last))
    if held:
        yield from work(pa.Table.from_batches(held))


def by_tile(df: DataFrame) -> DataFrame:
    """Tiles whole and in order. No number of partitions is given, so that few rows make few tasks."""
    return df.repartition("tile").sortWithinPartitions("tile")


def tile_pairs(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of sets of different ``group`` with a common shingle in ``rows`` (``token, sid, at, group``) that length, positional filter and bitmaps leave.

    Tiles are first gone through without bitmaps, which are then fetched only for sets that have a partner in their tile.
    """
    rows = rows.select("token", "sid", "at", "group").join(small(bits.select("sid", "n")), "sid")
    columns = ["sid", "n", "at", "group", "side"]

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        tile, sid, n, at, group, side = (t.column(c).to_numpy().astype(np.int64) for c in ("tile", *columns))
        start = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
        size = np.diff(np.append(start, len(tile)))
        left = np.repeat(size, size) - (np.arange(len(tile)) - np.repeat(start, size))  # members from each on, itself included
        maps = _Maps(t.column("bits").to_pylist(), n) if "bits" in t.column_names else None
        partnered = np.zeros(len(sid), bool)
        i = np.flatnonzero(left > 1)
        d = 1
        while len(i):
            j = i + d
            ok = ((side[i] != side[j]) | (side[i] == 2)) & (group[i] != group[j]) & (sid[i] != sid[j]) & _plausible(n[i], at[i], n[j], at[j])
            x, y = i[ok], j[ok]
            if maps is None:
                partnered[x] = partnered[y] = True
            elif len(x):
                fits = maps.fits(x, y)
                if fits.any():
                    yield pa.RecordBatch.from_arrays([pa.array(sid[x[fits]]), pa.array(sid[y[fits]])], names=["a", "b"])
            d += 1
            i = i[left[i] > d]
        if maps is None and partnered.any():
            yield from t.filter(pa.array(partnered)).combine_chunks().to_batches()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return whole_tiles(batches, compare)

    first = by_tile(tiled(rows).select("tile", *columns))
    kept = written(first.mapInArrow(tidy(run), first.schema), "tile-rows")
    return by_tile(kept.join(bits.select("sid", "bits"), "sid").select("tile", *columns, "bits")).mapInArrow(tidy(run), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """Written table ``sid, component`` (a set of it) of all sets with a link, by rounds of contraction.

    Each round, every node takes the least of itself and its neighbours as its parent, parents' parents shorten
    the way, and links are redrawn between parents; links inside a parent vanish. Ends when none is left.
    """
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges", narrow=True)
    label = written(edges.select(F.col("a").alias("sid")).distinct().withColumn("component", F.col("sid")), "labels", narrow=True)
    while not edges.isEmpty():
        parent = written(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("p")), "parents", narrow=True)
        up = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        parent = written(parent.join(up, "p", "left").select("a", F.coalesce("pp", "p").alias("p")), "parents", narrow=True)
        other = parent.select(F.col("a").alias("b"), F.col("p").alias("q"))
        edges = written(edges.join(parent, "a").join(other, "b").select(F.col("p").alias("a"), F.col("q").alias("b")).filter("a <> b").distinct(), "edges", narrow=True)
        label = written(label.join(parent.withColumnRenamed("a", "component"), "component", "left").select("sid", F.coalesce("p", "component").alias("component")), "labels", narrow=True)
    return label


def block_count(docs: DataFrame, units: DataFrame) -> int:
    """Blocks of postings: as many as shuffle partitions, more if a block would hold over ``BLOCK_POSTINGS``."""
    total = units.agg(F.sum(F.expr("n div 4 + 1"))).first()[0] or 0
    return max(partitions(docs.sparkSession), total // BLOCK_POSTINGS + 1)
