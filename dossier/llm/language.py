"""Language identification by error-correcting output codes.

Each language has a codeword; one binary classifier per bit (logistic regression over hashed byte n-grams of one
to three bytes, A-Z lowered, everything that is neither letter nor apostrophe as one blank) predicts that bit. Decoding takes the
codeword with the least loss, each bit weighted by how well a classifier of it did on rows held back from its fit, and flags
a text as ambiguous where the next codeword is close. Features and weights are whole numbers (of ``1 / SCALE``) whose products and sums doubles hold exactly, so a
margin is the same in whatever order it is summed; scores are rounded to ``DIGITS`` digits.

Learning uses a bounded sample: of at most ``LANGUAGES`` languages (the most frequent) at most ``SAMPLE`` documents each, those with the least hash of their id
and text, and no more than about ``ROWS`` in all. Prediction reads whole texts; it sees nothing but the text.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and not ambiguous; equal texts
get equal predictions, whatever stands beside them; without any labelled row every text is ``und``; with one language every text with a letter has it, score 1;
an empty table gives an empty result; a column to keep that has the name of a result is kept, and the result gets an underscore.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.llm.shared import apart
from dossier.llm.textarrays import flat, slices

#: Documents per language that the classifiers learn from, most languages and rows, and texts' dimensions.
SAMPLE, LANGUAGES, ROWS, DIMENSIONS = 300, 1000, 6000, 4096
#: One in so many rows of the sample is held back to weigh the bits.
HELD_BACK = 4
STEPS, RATE, RIDGE = 300, 4.0, 1e-4
#: Steps of a unit in features and weights; with |x| = 1 and weights under 100, sums stay under 2^53. Digits of scores and losses.
SCALE, DIGITS = 2.0**18, 9
#: Scores under this flag a text as ambiguous.
AMBIGUOUS = 0.6
UNKNOWN = "und"
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[0x27] = 0x27
_FOLD[0x80:] = np.arange(0x80, 0x100)


def codewords(n: int) -> np.ndarray:
    """``n`` codewords of bits -1 and 1: all distinct splits of the languages up to five of them, else random ones well apart."""
    if n <= 5:
        bits = [[1 if (s >> k) & 1 else -1 for k in range(n)] for s in range(1, 1 << max(0, n - 1))]
        return np.array(bits, np.int8).T if bits else np.zeros((n, 0), np.int8)
    width = 15 * int(np.ceil(np.log2(n)))
    best, apart = None, -1
    for seed in range(50):
        code = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (n, width))
        near = min(int((code[i] != code[:i]).sum(axis=1).min()) for i in range(1, n))
        if near > apart and (np.abs(code.sum(axis=0)) < n).all():
            best, apart = code, near
    return best


def features(part: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Square roots of each text's shares of n-grams, of unit length; one row per text."""
    data = _FOLD[part].astype(np.int64)
    one = (data * 0x9E3779B1) >> 7
    two = data[:-1] * 257 + data[1:]
    three = two[:-1] * 257 + data[2:]
    grams = [one % DIMENSIONS, ((two * 0x85EBCA6B) >> 11) % DIMENSIONS, ((three * 0xC2B2AE35) >> 13) % DIMENSIONS]
    out = np.zeros((len(cuts) - 1, DIMENSIONS))
    for i in range(len(cuts) - 1):
        a, b = int(cuts[i]), int(cuts[i + 1])
        count = np.bincount(grams[0][a:b], minlength=DIMENSIONS)
        for g, x in enumerate(grams[1:], 1):
            if b - a > g:
                count = count + np.bincount(x[a : b - g], minlength=DIMENSIONS)
        out[i] = np.rint(np.sqrt(count / max(1, int(count.sum()))) * SCALE) / SCALE
    return out


@dataclass
class Model:
    """``weights`` and ``bias`` are multiples of ``1 / SCALE``."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability-like score of each language, by the loss of its codeword."""
        margin = ((x * SCALE) @ (self.weights * SCALE) + self.bias * SCALE * SCALE) / (SCALE * SCALE)
        loss = np.log1p(np.exp(-np.clip(margin[:, None, :] * self.code[None], -30, 30)))
        total = np.round((loss * self.trust).sum(axis=2), DIGITS)
        total = np.exp(total.min(axis=1, keepdims=True) - total)
        return np.round(total / total.sum(axis=1, keepdims=True), DIGITS)


def _fitted(x: np.ndarray, y: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of the bits ``y``; ``row``: the rows' weights."""
    x = x.astype(np.float32)
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(STEPS):
        g = -y * row / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30)))
        vw = 0.9 * vw - RATE * (x.T @ g + RIDGE * w)
        vb = 0.9 * vb - RATE * g.sum(axis=0)
        w, b = w + vw, b + vb
    return w, b


def fit(x: np.ndarray, lang: list[str]) -> Model:
    """A model of all rows. The bits' weights come from a fit without every ``HELD_BACK``th row of a language, by its share of right bits on those rows."""
    languages = sorted(set(lang))
    code = codewords(len(languages))
    at = np.array([languages.index(v) for v in lang], np.int64)
    share = np.bincount(at, minlength=len(languages)).astype(np.float32)
    y = code[at].astype(np.float32)
    row = (1 / share[at])[:, None] / max(1, len(languages))
    place = np.zeros(len(at), np.int64)
    for k in range(len(languages)):
        place[at == k] = np.arange((at == k).sum())
    back = place % HELD_BACK == HELD_BACK - 1
    if not back.any():
        back[:] = len(at) > 0
        w, b = _fitted(x, y, row)
    else:
        w, b = _fitted(x[~back], y[~back], row[~back])
    right = ((y[back] * (x[back] @ w + b) > 0) * row[back]).sum(axis=0) / max(float(row[back].sum()), 1e-9)
    right = np.clip(right, 0.5 + 1e-3, 1 - 1e-3)
    w, b = (np.rint(v.astype(np.float64) * SCALE) / SCALE for v in _fitted(x, y, row))
    return Model(languages, code, w, b, np.log(right / (1 - right)) / np.log(999))


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the rows of ``docs`` (``doc_id, text, lang``) with a text and a language, a bounded sample of them.

    The sample is taken in two steps, so that no language's rows meet in one task: the first of each of a number of
    slices, then the first of those.
    """
    rows = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text", F.xxhash64("doc_id", "text").alias("key"))
    known = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).select("lang")
    known = docs.sparkSession.createDataFrame(known.collect(), "lang string")  # at most LANGUAGES rows
    sample = min(sample, max(1, ROWS // max(1, known.count())))
    keys = rows.join(F.broadcast(known), "lang", "left_semi").select("lang", "key").withColumn("slice", F.pmod("key", F.lit(64)))
    first = keys.withColumn("k", F.row_number().over(Window.partitionBy("lang", "slice").orderBy("key"))).filter(F.col("k") <= sample)
    first = first.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).filter(F.col("k") <= sample)
    limits = F.broadcast(first.groupBy("lang").agg(F.max("key").alias("limit")))  # one row per language

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for i, j in slices(offsets):
                x = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array([v.astype(np.float32).tobytes() for v in x], pa.binary())], names=["lang", "key", "x"])

    found = rows.join(limits, "lang").filter("key <= limit").select("lang", "text", "key").dropDuplicates(["lang", "key"]).mapInArrow(run, "lang string, key long, x binary").orderBy("lang", "key").collect()  # the sample
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in found]) if found else np.zeros((0, DIMENSIONS), np.float32)
    return fit(x, [r["lang"] for r in found])


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``lang_pred, score, ambiguous``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # languages x bits x dimensions, whatever the data
    kept = docs.select(*keep).schema
    made = [apart(kept.names, c) for c in ("lang_pred", "score", "ambiguous")]
    schema = T.StructType([*kept.fields, *[T.StructField(c, t) for c, t in zip(made, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True)]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = np.array([*m.languages, UNKNOWN], object)
        for batch in batches:
            at = len(batch.schema.names) - 1
            data, offsets = flat(batch.column(at))
            texts = batch.column(at)
            for i, j in slices(offsets):
                part, cuts = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                said = np.array([_has_letter(part[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], bool)
                best, score = np.full(j - i, len(m.languages)), np.zeros(j - i)
                if said.any() and m.languages:
                    if len(m.languages) == 1:
                        best[said], score[said] = 0, 1.0
                    else:
                        for a in range(0, j - i, 512):  # dense rows, so few at once
                            b = min(j - i, a + 512)
                            s = m.scores(features(part[cuts[a] : cuts[b]], cuts[a : b + 1] - cuts[a]))
                            ok = said[a:b]
                            best[a:b][ok], score[a:b][ok] = s.argmax(axis=1)[ok], s.max(axis=1)[ok]
                known = best < len(m.languages)
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(i, j - i) for c in batch.columns[:at]], pa.array(names[best].tolist(), pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(known & (score < AMBIGUOUS))],
                    names=schema.names,
                )

    return docs.select(*keep, F.col("text").alias(apart(schema.names, "text"))).mapInArrow(run, schema)


def _has_letter(raw: np.ndarray) -> bool:
    """Whether a text has a letter; only texts without an ASCII letter are decoded."""
    low = raw | 0x20
    if ((low >= 97) & (low <= 122)).any():
        return True
    return bool((raw >= 0x80).any()) and any(c.isalpha() for c in raw.tobytes().decode("utf-8", "replace"))
