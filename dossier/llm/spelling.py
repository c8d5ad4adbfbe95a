"""Groups spelling variants: words one inserted, deleted or replaced code point apart, by asymmetric q-chunks.

Of two such words the longer one (of equally long ones, either) contributes its two disjoint chunks of ``q = length // 2`` code points, its start and its end;
the other its positional q-grams. One edit touches one chunk at most, so the other chunk is a gram of the other word, at a place within one of its own. Words are joined
on (length of the longer one, which chunk, its code points), and each pair is verified.

A chunk that many words share makes a long list. There the pair that is sought agrees in the whole chunk at its exact place, so what is left of the two words is again
one edit apart: the rows of a long list are split by the chunks of what is left, and again while lists stay long. At the end of that, words of one list differ in a
single place, so pairs are made in proportion to the words and to the pairs that are true, whatever the words have in common.

Each word's form is its most frequent near word, if that is ``RATIO`` times as frequent. As counts grow by that with each step, paths of forms
are short (27 steps in 64 bits) and free of cycles; doubling finds their ends in as many joins as the logarithm of the longest.

Defined results: a null text has no words; words are counted over whole texts, a repeated row again; an empty table gives an empty result; ties of frequency go
to the smallest word in code-point order; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.shared import scratch, written
from dossier.llm.textarrays import LOWER, flat, slices

LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: A list is split if its pairs are over so many times its rows.
CROWDED = 16
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_LATIN = 0xC3  # the first byte of U+00C0 to U+00FF, and of nothing else

#: Replaces some words of a slice: gets the rows' doc_ids, and data, starts, ends and row of the words; gives their numbers and new texts.
Edit = Callable[[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, list[str]]]


def letter_runs(part: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lowered (A-Z) bytes of the texts ``cuts[i]:cuts[i+1]``, starts and ends of the maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` in them, and each run's text."""
    data = LOWER[part]
    inside = _ASCII_LETTER[data] | (data == _LATIN)
    inside[1:] |= data[:-1] == _LATIN
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    start[inner] |= inside[inner]
    end[inner - 1] |= inside[inner - 1]
    s = np.flatnonzero(start)
    return data, s, np.flatnonzero(end) + 1, np.searchsorted(cuts, s, side="right") - 1


def spans(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.Array:
    """The byte spans, which ascend and don't meet, as strings."""
    edge = np.zeros(len(data) + 1, np.int8)
    edge[s] += 1
    np.subtract.at(edge, e, 1)  # one may end where the next one starts
    offsets = np.concatenate([[0], np.cumsum(e - s)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(s), pa.py_buffer(offsets), pa.py_buffer(data[np.cumsum(edge[:-1]) > 0].tobytes()))


def word_counts(docs: DataFrame, edit: Edit | None = None, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of the words of at least ``least_length`` code points that occur ``least_count`` times. ``docs``: ``doc_id, text``. Counts are combined per slice, per task, then by a shuffle of words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, offsets = flat(batch.column(1))
            for i, j in slices(offsets):
                data, s, e, row = letter_runs(texts[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                new: list[str] = []
                if edit is not None:
                    at, new = edit(batch.column(0).slice(i, j - i), data, s, e, row)
                    s, e = np.delete(s, at), np.delete(e, at)
                lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                enough = lead[e] - lead[s] >= least_length
                found = pa.chunked_array([spans(data, s[enough], e[enough]), pa.array([x for x in new if len(x) >= least_length], pa.large_string())]).value_counts()
                yield pa.RecordBatch.from_arrays([found.field(0).cast(pa.string()), found.field(1)], names=["word", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _piece(text: str, place: Column | int, length: Column) -> Column:
    return F.substr(F.col(text), F.lit(place) + 1, length)


def chunk_rows(words: DataFrame) -> DataFrame:
    """Rows ``key, chunk (boolean), word, n, longer, left`` of both roles of every word; ``longer`` is the code points of the chunk side's ``left``, which is what remains of a word (null for a gram that isn't in its exact place)."""
    length = F.length("word")
    key = lambda longer, which, piece: F.xxhash64(longer, F.lit(which), piece)
    row = lambda k, chunk, longer, left: F.struct(k.alias("key"), F.lit(chunk).alias("chunk"), longer.cast("int").alias("longer"), left.alias("left"))
    half = F.floor(length / 2)
    rest = length - half
    chunks = [row(key(length, 0, _piece("word", 0, half)), True, rest, _piece("word", half, rest)), row(key(length, 1, _piece("word", rest, half)), True, rest, _piece("word", 0, rest))]
    grams, none = [], F.lit(None).cast("string")
    for more in (0, 1):  # code points that the other word may have beyond this one's
        longer = length + more
        q = F.floor(longer / 2)
        for which, place, shifts in ((0, F.lit(0), (0, 1)), (1, longer - q, (-1, 0, 1))):
            for shift in shifts:
                at = place + shift
                exact = shift == (-more if which else 0)
                left = (_piece("word", q, length - q) if which == 0 else _piece("word", 0, length - q)) if exact else none
                grams.append(F.when((at >= 0) & (at + q <= length), row(key(longer, which, _piece("word", at, q)), False, longer - q, left)))
    return words.select("word", "n", F.explode(F.array_compact(F.array(*chunks, *grams))).alias("r")).select("r.key", "r.chunk", "word", "n", "r.longer", "r.left")


def split_rows(rows: DataFrame) -> DataFrame:
    """Rows of crowded lists, split by the chunks of what is left."""
    q, length = F.floor(F.col("longer") / 2), F.length("left")
    row = lambda which, piece, left: F.struct(F.xxhash64("key", F.lit(which), piece).alias("key"), (F.col("longer") - q).cast("int").alias("longer"), left.alias("left"))
    both = F.array(row(0, _piece("left", 0, q), _piece("left", q, length - q)), row(1, _piece("left", length - q, q), _piece("left", 0, length - q)))
    return rows.filter("left IS NOT NULL").select("chunk", "word", "n", F.explode(both).alias("r")).select("r.key", "chunk", "word", "n", "r.longer", "r.left")


def near_pairs(words: DataFrame) -> DataFrame:
    """Written table ``a, n_a, b, n_b`` of all pairs of ``words`` (``word, n``, words distinct) that are one edit apart, once each."""
    with scratch(words.sparkSession):
        rows, found = written(chunk_rows(words), "spelling-rows"), []
        while True:
            lists = rows.groupBy("key").agg(F.count_if("chunk").alias("c"), F.count_if(~F.col("chunk")).alias("g"), F.max("longer").alias("longer"))
            crowded = (F.col("c") * F.col("g") > CROWDED * (F.col("c") + F.col("g"))) & (F.col("longer") > 1)
            lists = written(lists.filter("c > 0 AND g > 0").select("key", crowded.alias("crowded")), "spelling-lists", narrow=True)
            few = lists.filter("NOT crowded").select("key")
            a = rows.filter("chunk").join(few, "key", "left_semi").select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
            b = rows.filter("NOT chunk").select("key", F.col("word").alias("b"), F.col("n").alias("n_b"))
            near = (F.length("a") > F.length("b")) | (F.col("a") < F.col("b"))
            pairs = a.join(b, "key").filter(near & (F.levenshtein("a", "b", 1) == 1)).select("a", "n_a", "b", "n_b")
            found.append(written(pairs, "spelling-pairs", narrow=True))
            many = lists.filter("crowded").select("key")
            if many.isEmpty():
                break
            rows = written(split_rows(rows.join(many, "key", "left_semi")), "spelling-rows")
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return written(out.distinct(), "spelling-near", keep=True, narrow=True)


def roots(forms: DataFrame) -> DataFrame:
    """Written table ``word, root``: where the path of forms from each word of ``forms`` (``word, form``) ends."""
    with scratch(forms.sparkSession):
        links = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-links", keep=True, narrow=True)
        while not links.filter("moved").isEmpty():
            on = links.select(F.col("word").alias("root"), F.col("root").alias("end"))
            links = links.join(on, "root", "left").select("word", F.coalesce("end", "root").alias("root"), F.col("end").isNotNull().alias("moved"))
            links = written(links, "spelling-links", keep=True, narrow=True)
        return links.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every row of ``words`` (``word, n``, words distinct)."""
    words = written(words.select("word", "n"), "spelling-words", keep=True, narrow=True)
    pairs = near_pairs(words)
    side = lambda x, y: pairs.select(F.col(x).alias("word"), F.struct((-F.col(f"n_{y}")).alias("less"), F.col(y).alias("other")).alias("near"))
    per = side("a", "b").unionByName(side("b", "a")).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("near").alias("best"))
    most = -F.col("best.less")
    formed = most >= ratio * F.col("n")
    out = words.join(per, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.other")).alias("form"), F.when(formed, most).alias("form_n"))
    out = written(out, "spelling-forms", keep=True, narrow=True)
    ends = roots(out.filter("form IS NOT NULL"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
