"""Information-theoretic sanitisation of personal data.

Protected entities (e-mail addresses, IP addresses, card and phone numbers) are found by patterns. A term that
keeps the company of one entity reveals it even where the entity itself is masked: with ``N`` documents, ``n_e`` and ``n_t`` those with
the entity and with the term and ``n_te`` those with the term near the entity, the disclosure

    PMI(t; e) / IC(e) = ln(n_te N / (n_t n_e)) / ln(N / n_e) = 1 + ln(n_te / n_t) / ln(N / n_e)

is the share of the entity's information that the term gives away (1: the term occurs with it alone). Near is the entity's sentence up to ``REACH`` words away, and ``NEAR``
words on each side beyond it; so pairs of terms and entities are in proportion to the entities, also where thousands stand in one line. ``n_te / n_t`` is taken at its lower confidence bound (Wilson's, ``Z``), where the different contexts are the trials
(copies of one passage are one context). Terms at or beyond ``THRESHOLD`` are spans of kind ``term`` in all documents that hold them, with the entity
or without. Counts cover all documents: every batch sends its distinct words with their number of documents.

Sanitising generalises entities to their kind in brackets and removes disclosing terms.

Defined results: a null text has no spans and stays null; equal texts have equal spans; repeated rows count as
documents of their own, their contexts once; overlapping spans are replaced as one, by the kind listed first; an empty table gives an
empty result; other columns are left alone.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.shared import apart, scratch, small, small_batches, tidy, written
from dossier.llm.textarrays import U, flat, slices, span_hashes, words

KINDS = ("email", "ip", "card", "phone")
#: Words on each side of an entity that are near it in any case, and in its own sentence; least share of its information; the confidence bound's normal quantile (95 %, one-sided).
NEAR, REACH, THRESHOLD, Z = 6, 32, 0.8, 1.645
#: Slots that mark the keys of disclosing terms: more slots let fewer other words through to the join, which is exact.
MARKS = 1 << 24
# The contract's patterns. An e-mail address is found from its @, see emails().
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SENTENCE = re.compile(r"[.!?][\"')\]}]*(?=[\x20\x09-\x0D])|[\n\u3002\uFF01\uFF1F]")
_EDGE = ".,;:!?\"'()[]{}"


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses. Each starts at the run of local characters before an @, so a text is read once."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of all kinds, by kind, then start; failing matches are dropped without another try."""
    out = [("email", a, b) for a, b in emails(text)]
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def entity(kind: str, value: str) -> str:
    """An entity's name in one spelling."""
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else re.sub('[^0-9]', '', value)}"


def fold(text: str) -> str:
    """``text`` without differences of case in any script. Each character is folded by itself, so a word folds alike alone and in its text."""
    return text.casefold()


def terms(text: str, start: int = 0, end: int | None = None) -> Iterator[tuple[str, int, int]]:
    """Words without punctuation at their ends, case folded, with their places."""
    for m in _WORD.finditer(text, start, len(text) if end is None else end):
        word = m[0]
        left = len(word) - len(word.lstrip(_EDGE))
        core = word.strip(_EDGE)
        if core:
            yield fold(core), m.start() + left, m.start() + left + len(core)


def passages(text: str, found: list[tuple[str, int, int]]) -> list[tuple[list[str], list[str]]]:
    """Entities with the terms near them, one entry for each stretch of text: the words of an entity's sentence up to ``REACH`` away, and ``NEAR`` words a side beyond it. Words that hold a part of an entity are no terms."""
    if not found:
        return []
    ends = [m.end() for m in _SENTENCE.finditer(text)]
    places = [m.span() for m in _WORD.finditer(text)]
    starts, stops = [a for a, _ in places], [b for _, b in places]
    taken: set[int] = set()
    near: dict[tuple[int, int], dict[str, None]] = {}
    for kind, a, b in found:
        first, last = bisect_right(stops, a), bisect_left(starts, b)  # words that the span touches
        taken.update(range(first, last))
        i, j = bisect_right(ends, a), bisect_left(ends, b)
        low = bisect_right(stops, ends[i - 1]) if i else 0
        high = bisect_left(starts, ends[j]) if j < len(ends) else len(places)
        low, high = max(low, first - REACH), min(high, last + REACH)  # so a list of addresses makes rows in proportion to its length
        near.setdefault((min(low, max(0, first - NEAR)), max(high, min(len(places), last + NEAR))), {})[entity(kind, text[a:b])] = None
    out = []
    for (low, high), names in near.items():
        words_ = dict.fromkeys(w for k in range(low, high) if k not in taken for w, _, _ in terms(text, *places[k]))
        out.append((list(names), list(words_)))
    return out


def term_keys(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of folded texts without ASCII punctuation at their ends, and the texts' cuts in them; a word of punctuation alone has the empty term's."""
    s, e, at = words(data, cuts)
    edge = np.zeros(256, bool)
    edge[[ord(c) for c in _EDGE]] = True
    ends = np.flatnonzero(edge[data[s]] | edge[data[e - 1]]) if len(s) else s
    if len(ends):
        inner = np.append(np.flatnonzero(~edge[data]), len(data))
        a, b = s[ends], e[ends]
        s[ends] = np.minimum(inner[np.searchsorted(inner, a)], b)
        e[ends] = np.where(s[ends] < b, inner[np.searchsorted(inner, b) - 1] + 1, b)
    return span_hashes(data, s, e), at


def term_key(term: str) -> int:
    raw = np.frombuffer(fold(term).encode(), np.uint8)
    return int(span_hashes(raw, np.array([0]), np.array([len(raw)])).view(np.int64)[0])


_FOUND = "doc_id long, version long, row long, spans array<struct<kind:string,start:int,end:int>>, entities array<string>, contexts array<struct<entities:array<string>,terms:array<struct<term:string,key:long>>,context:long>>, key long, docs long"


def survey(docs: DataFrame) -> DataFrame:
    """Written table of each row's base spans, entities and contexts, and (rows with ``key``) of words with their numbers of documents. ``docs``: ``doc_id, version, text``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "version", "row", "spans", "entities", "contexts", "key", "docs"]
        span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        context_type = pa.list_(pa.struct([("entities", pa.list_(pa.string())), ("terms", pa.list_(pa.struct([("term", pa.string()), ("key", pa.int64())]))), ("context", pa.int64())]))
        for batch in batches:
            spans, entities, contexts = [], [], []
            for text in batch.column(2):
                text = text.as_py() or ""
                found = base_spans(text)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
                entities.append(sorted({entity(k, text[a:b]) for k, a, b in found}))
                near = []
                for own, around in passages(text, found):
                    if around:
                        data, at = flat(pa.array([*around, " ".join(around)], pa.string()))
                        keys = span_hashes(data, at[:-1], at[1:]).view(np.int64).tolist()
                        near.append({"entities": own, "terms": [{"term": t, "key": k} for t, k in zip(around, keys[:-1], strict=True)], "context": keys[-1]})
                contexts.append(near)
            blank = pa.nulls(len(spans), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(spans, span_type), pa.array(entities, pa.list_(pa.string())), pa.array(contexts, context_type), blank, blank], names=names)
            data, offsets = flat(pa.array([fold(x.as_py() or "") for x in batch.column(2)], pa.string()))
            keys = []
            for i, j in slices(offsets):
                h, at = term_keys(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                keys += [np.unique(h[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) if a < b]
            if keys:
                h = np.sort(np.concatenate(keys))
                new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                count = np.diff(np.append(new, len(h)))
                n = len(new)
                blank = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([blank, blank, blank, pa.nulls(n, span_type), pa.nulls(n, pa.list_(pa.string())), pa.nulls(n, context_type), pa.array(h[new].view(np.int64)), pa.array(count, pa.int64())], names=names)

    return written(docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(tidy(run), _FOUND), "privacy-survey")


def disclosing(found: DataFrame) -> DataFrame:
    """Written table ``key, term`` of the terms that disclose an entity."""
    rows = found.filter("key IS NULL")
    holders = written(rows.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("with_entity")), "privacy-entities", narrow=True)
    total, most = rows.count(), holders.agg(F.max("with_entity")).first()[0] or 0
    near = rows.select("row", F.explode("contexts").alias("c")).select("row", "c.entities", "c.context", F.explode("c.terms").alias("t")).select("row", "entities", "context", "t.*")
    asked = near.select("key").distinct()
    # n_te is at most n_e: a term in more documents than this discloses no entity, whatever its company.
    limit = most**THRESHOLD * total ** (1 - THRESHOLD) * (1 + 1e-9)
    counts = found.filter("key IS NOT NULL").select("key", "docs").join(small(asked), "key", "left_semi").groupBy("key").agg(F.sum("docs").alias("with_term")).filter(F.col("with_term") <= limit)
    near = near.join(small(written(counts, "privacy-counts", narrow=True)), "key").select("row", "context", "key", "term", "with_term", F.explode("entities").alias("entity"))
    pair = near.groupBy("entity", "key", "term", "with_term").agg(F.count_distinct("row").alias("both"), F.count_distinct("context").alias("contexts")).join(small(holders), "entity")
    p = F.least(F.lit(1.0), F.col("both") / F.col("with_term"))
    trials = F.col("contexts") / p
    z2 = F.lit(Z * Z)
    low = (p + z2 / (2 * trials) - Z * F.sqrt(p * (1 - p) / trials + z2 / (4 * trials * trials))) / (1 + z2 / trials)
    share = 1 + F.ln(low) / F.ln(F.lit(float(total)) / F.col("with_entity"))
    return written(pair.filter((F.col("with_entity") < total) & (share >= THRESHOLD)).select("key", "term").distinct(), "privacy-terms", narrow=True)


def with_terms(docs: DataFrame, names: DataFrame) -> DataFrame:
    """``doc_id, version, terms, extra`` of the documents that hold a disclosing term, and the terms' spans. ``docs``: ``doc_id, version, text``; ``names``: ``key, term``."""
    slot = F.col("key").bitwiseAND(F.lit(MARKS - 1)).cast("int").alias("slot")
    marks = np.zeros(MARKS, bool)
    marks[names.select(slot).distinct().toArrow().column(0).to_numpy()] = True
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(marks))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.unpackbits(sent.value).view(bool)
        for batch in batches:
            at_row, keys, held, places = [], [], [], []
            texts = batch.column(2).to_pylist()
            data, offsets = flat(pa.array([fold(t or "") for t in texts], pa.string()))
            for i, j in slices(offsets):
                h, at = term_keys(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                hit = np.flatnonzero(own[(h & U(MARKS - 1)).astype(np.int64)])
                row = np.searchsorted(at, hit, side="right") - 1
                for k in np.unique(row).tolist():
                    words_ = [m.span() for m in _WORD.finditer(texts[i + k])]
                    found: dict[tuple[int, str], list[dict]] = {}
                    for x in hit[row == k].tolist():
                        for w, a, b in terms(texts[i + k], *words_[x - int(at[k])]):
                            found.setdefault((int(h[x : x + 1].view(np.int64)[0]), w), []).append({"start": a, "end": b})
                    for (key, w), where in found.items():
                        at_row.append(i + k)
                        keys.append(key)
                        held.append(w)
                        places.append(where)
            take = pa.array(at_row, pa.int64())
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(keys, pa.int64()), pa.array(held, pa.string()), pa.array(places, span)], names=["doc_id", "version", "key", "term", "places"])

    marked = written(docs.mapInArrow(tidy(run), "doc_id long, version long, key long, term string, places array<struct<start:int,end:int>>"), "privacy-marked")
    held = marked.join(small(names), ["key", "term"]).groupBy("doc_id", "version").agg(F.collect_set(F.struct("term", "places")).alias("held"))  # repeated rows count once
    extra = F.transform(F.array_sort(F.flatten("held.places")), lambda x: F.struct(F.lit("term").alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return held.select("doc_id", "version", F.array_sort("held.term").alias("terms"), extra.alias("extra"))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("version"), "text")


def spans(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, version, base, extra``, the base spans and those of disclosing terms."""
    rows = keyed(docs)
    found = survey(rows)
    names = disclosing(found)
    base = found.filter("key IS NULL").select("doc_id", "version", F.col("spans").alias("base"))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    if names.isEmpty():
        return base.withColumn("extra", empty)
    extra = written(with_terms(rows, names).select(F.col("doc_id").alias("d"), F.col("version").alias("v"), "extra"), "privacy-extra")
    joined = base.join(small(extra), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")), "left")
    return joined.select("doc_id", "version", "base", F.coalesce("extra", empty).alias("extra"))


def masked(text: str, base: list[tuple[str, int, int]], names: set[str]) -> str:
    """``text`` with its entities generalised and disclosing terms removed."""
    marks = sorted([(a, b, KINDS.index(k), f"[{k}]") for k, a, b in base] + [(a, b, len(KINDS), "") for w, a, b in (terms(text) if names else ()) if w in names])
    out, end = [], 0
    for k, (a, b, _, word) in enumerate(marks):
        if a < end:
            continue
        stop = b
        for c, d, _, _ in marks[k + 1 :]:
            if c >= stop:
                break
            stop = max(stop, d)
        out += [text[end:a], word]
        end = stop
    return "".join([*out, text[end:]])


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` sanitised; same columns."""
    with scratch(docs.sparkSession):
        rows = keyed(docs)
        found = survey(rows)
        ask = written(with_terms(rows, disclosing(found)).drop("extra"), "privacy-ask", keep=True)
    ask = ask.select(F.col("doc_id").alias("d"), F.col("version").alias("v"), F.col("terms").alias("asked"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.xxhash64("text").alias("version"))
    small_batches(docs.sparkSession)
    joined = own.join(small(ask), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")), "left").select("row.*", F.col("asked").alias(apart(docs.columns)))
    at, docs_names = docs.columns.index("text"), docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if (t := x.as_py()) is None else masked(t, base_spans(t), set(y.as_py() or ())) for x, y in zip(b.column(at), b.column(b.num_columns - 1), strict=True)]
            columns = list(b.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=docs_names)

    return joined.mapInArrow(tidy(run), docs.schema)
