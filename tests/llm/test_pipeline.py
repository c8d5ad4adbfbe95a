"""The pipeline: each stage on its predecessor's rows against brute force, and on odd tables."""

import collections
import os
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from test_joins import components, removed_lines
from test_tokens import disclosed
from tokenizers import Tokenizer

from dossier.llm import packing, packing_query, privacy, quality_query, shared

corpus_pipeline = pytest.importorskip("corpus_pipeline")
WHERE = "/root/testdata/sf0.001"


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Each stage's rows, read again as the next one's documents."""
    folder = tmp_path_factory.mktemp("steps")
    docs = spark.read.parquet(f"{WHERE}/documents.parquet")
    out = {"documents": docs}
    for name, run in corpus_pipeline.STAGES:
        run(spark, docs, WHERE).write.parquet(str(folder / name))
        out[name] = docs = spark.read.parquet(str(folder / name))
    return out


def rows(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=lambda r: r[0])


def test_columns(steps):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "ngram_jaccard_join", "pii", "packing"]
    assert all(steps[n].columns == steps["documents"].columns for n in names[:-1])


def test_quality_rules(spark, steps):
    judged = quality_query.op1_quality_rules(spark, WHERE).collect()
    kept, failed = ({r["doc_id"] for r in judged if r[c]} for c in ("kept", "base_failed"))
    assert rows(steps["quality_rules"]) == [r for r in rows(steps["documents"]) if r[0] in kept]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{WHERE}/labels.parquet").collect()}
    assert sum(labels.get(i) == 0 for i in kept) <= 2 and all(i in kept for i, q in labels.items() if q == 1 and i not in failed)


def test_line_dedup(steps):
    before = rows(steps["quality_rules"])
    gone = removed_lines(before)
    assert rows(steps["line_dedup"]) == [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in set(gone[i]))) for i, t in before]


def test_ngram_jaccard_join(steps):
    before = rows(steps["line_dedup"])
    least = {c for _, c in components([t for _, t in before]).values()}
    assert rows(steps["ngram_jaccard_join"]) == [r for k, r in enumerate(before) if k in least]


def test_pii(steps):
    before = rows(steps["ngram_jaccard_join"])
    names = disclosed(before)
    assert rows(steps["pii"]) == [(i, privacy.masked(t, privacy.base_spans(t), names)) for i, t in before]


def test_packing(steps):
    library = Tokenizer.from_file(P.path(packing_query.VOCABULARY))
    library.encode_special_tokens = True
    ids = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in rows(steps["pii"])}
    at, windows = collections.defaultdict(list), collections.Counter()
    for p in steps["packing"].collect():
        assert zlib.crc32(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"]
        at[p["doc_id"]].append((p["start"], p["length"]))
        windows[p["sequence_id"]] += p["length"]
    assert set(at) == set(ids) and all(sum(n for _, n in at[i]) == len(x) for i, x in ids.items()) and max(windows.values()) <= packing.SIZE


def test_run(spark, steps):
    key = lambda df: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in df.collect())
    got = corpus_pipeline.run(spark, WHERE)
    tokens = lambda xs: {(i, n) for i, _, _, _, n in xs}
    assert tokens(key(got)) == tokens(key(steps["packing"]))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, name):
    """Nulls in all columns, empty and long texts, repeated rows, clashing names of extra columns; and an empty table."""
    long_ = "a long line of words and more " * 40_000
    texts = [None, "", " \n\n", "one", "x@y.org 1.2.3.4 and words " * 9, "x@y.org 1.2.3.4 and words " * 9, long_, "line\n" * 50 + "last", "é" * 3000]
    made = [(i if i != 2 else None, t, None if i == 3 else "en", None if i == 4 else "s", None) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*made, made[4], made[4], (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for k, c in enumerate(("version", "sid", "row", "removed", "ids", "d", "v", "own", "canon", "__version", "__words", "key", "terms")):
        df = df.withColumn(c, F.lit(k))
    out = stage(name)(spark, df.repartition(3), "unused")
    got = out.collect()
    empty = stage(name)(spark, df.limit(0), "unused")
    assert empty.columns == out.columns and empty.count() == 0
    if name == "packing":
        assert sum(r["length"] for r in got) == sum(n for (n,) in {(r["doc_id"], r["doc_tokens"]): (r["doc_tokens"],) for r in got if r["doc_id"] not in (None, 4)}.values()) + sum(r["length"] for r in got if r["doc_id"] in (None, 4))
        return
    assert out.columns == df.columns and all(r["sid"] == 1 and r["__words"] == 10 for r in got)
    n = collections.Counter(r["doc_id"] for r in got)
    if name == "quality_rules":
        assert set(n) <= set(range(9)) and not n[0] and not n[1] and not n[3]
    elif name == "ngram_jaccard_join":
        assert n[4] == 1 and n[5] == 0 and n[0] == n[1] == n[3] == 1
    else:
        assert n == collections.Counter([*(r[0] for r in made), 4, 4, None])
        assert all(r["text"] is None for r in got if r["doc_id"] == 0)
        if name == "pii":
            assert {r["text"] for r in got if r["doc_id"] == 4} == {r["text"] for r in got if r["doc_id"] == 5} and not any("@" in (r["text"] or "") for r in got)


@pytest.mark.parametrize("name", ["pii", "packing"])
def test_lazy_stages_send_small_batches(spark, name):
    """A stage's result runs after its operator; its batches of whole texts are small then too, but never larger than the session's own."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    df = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    try:
        for before, after in (("10000", shared.BATCH_ROWS), ("0", shared.BATCH_ROWS), ("70", 70)):
            spark.conf.set(rows, before)
            stage(name)(spark, df, "unused")
            assert int(spark.conf.get(rows)) == after and int(spark.conf.get(size)) <= shared.BATCH_BYTES
    finally:
        spark.conf.unset(rows)
        spark.conf.unset(size)


def test_workers_give_memory_back():
    """After a task its worker doesn't hold on to what the task took and freed, though something small outlives it."""
    held = []

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6

    def run(batches):
        parts = []
        for batch in batches:
            for _ in range(6000):
                parts.append(np.ones(40_000, np.uint8))
            held.append(np.ones(40_000, np.uint8))
            yield batch

    def grown(f):
        before = resident()
        assert list(f(iter([1, 2]))) == [1, 2]
        return resident() - before

    assert grown(shared.tidy(run)) < 100  # of 480
