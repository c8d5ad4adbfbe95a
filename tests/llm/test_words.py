"""Lexicon BPE, spelling variants and importance resampling: brute force and edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import checksums, lexicon, ranking, resampling, resampling_query, spelling, spelling_query, wordpair, wordpair_query

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{(k * k) % 7919}é's" for k in range(160_000))  # over a slice's share of bytes
ODD = [None, "", " \n\t ", "one", "Don't STOP!!", "a<|endoftext|>b <|startoftext|>", "İSTANBUL ﬁne Straße é x́̂ ÀÉ×ß", "a\x1cb\x85c d　e \x0b f", "x" * 70_000, "12345 ½ ٣ 東京都 😀👍🏽", "́ lone", LONG]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t) for i, t in enumerate([*ODD, *ODD[4:7]])]
    return spark.createDataFrame([*rows, rows[4], (None, "null id")], DOCS).repartition(3)


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(public_tokenizers.path(wordpair_query.VOCABULARY))
    out.no_truncation()
    out.no_padding()
    return out


def test_lexicon():
    rng = random.Random(1)
    made = sorted({bytes(rng.choice(b"abc\xc3") for _ in range(rng.randint(1, 7))) + rng.choice([b"", b"ing", b"ed"]) for _ in range(4000)})
    found = lexicon.Lexicon(lexicon.compiled(made, [[k, 7] for k in range(len(made))]))
    asked = [*made, b"", *[bytes(rng.choice(b"abcd\xc3") for _ in range(rng.randint(0, 8))) for _ in range(4000)]]
    ends = np.cumsum([len(x) for x in asked])
    rank = {w: k for k, w in enumerate(made)}
    assert found.ranks(np.frombuffer(b"".join(asked), np.uint8), ends - [len(x) for x in asked], ends).tolist() == [rank.get(x, -1) for x in asked]
    assert found.ids[found.cut[5] : found.cut[6]].tolist() == [5, 7]
    # Minimal: no two states have the same continuations and finality.
    arcs = collections.defaultdict(list)
    for key, to in zip(found.arc.tolist(), found.to.tolist(), strict=True):
        arcs[key >> 8].append((key & 255, to))
    assert len({(tuple(arcs[k]), f) for k, f in enumerate(found.final.tolist())}) == len(found.final) < sum(map(len, made)) // 3
    empty = lexicon.Lexicon(lexicon.compiled([], []))
    assert empty.ranks(np.frombuffer(b"ab", np.uint8), np.array([0]), np.array([2])).tolist() == [-1]


@pytest.mark.parametrize("most", [0, 3, 1 << 17])
def test_word_bpe(odd, spark, most):
    """Any lexicon gives the library's ids, as does none."""
    tool = library()
    vocabulary = wordpair.with_lexicon(odd, wordpair.WordVocabulary(spark, __import__("public_tokenizers").path(wordpair_query.VOCABULARY)), most=most)
    out = wordpair.decode(wordpair.encode(odd.withColumn("decoded", F.lit("clash")), vocabulary), vocabulary)
    assert out.columns == ["doc_id", "text", "decoded", "ids", "decoded_"]
    rows = out.collect()
    assert len(rows) == len(ODD) + 5
    for r in rows:
        want = tool.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded_"] == tool.decode(want, skip_special_tokens=False) and r["decoded"] == "clash"
    assert wordpair.encode(odd.limit(0), vocabulary).count() == 0
    few = spark.createDataFrame([([1, 2, 99_999_999],), (None,), ([],)], "ids array<int>")
    assert [r["decoded"] for r in wordpair.decode(few, vocabulary).collect()] == [tool.decode([1, 2], skip_special_tokens=False), "", ""]


def test_word_bpe_query(spark):
    tool, docs = library(), {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = wordpair_query.op11_lexicon_bpe(spark, SMALL).collect()
    assert len(got) == len(docs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in got:
        ids = tool.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert tuple(r)[1:] == (len(ids), sha(" ".join(map(str, ids))), sha(tool.decode(ids, skip_special_tokens=False)))


def test_frequent_words(spark):
    counts = spark.createDataFrame([(bytes([65 + k]), n) for k, n in enumerate([1000, 400, 400, 90, 90, 90, 2])], "word binary, n long")
    for most, want in ((0, 0), (2, 1), (3, 3), (5, 3), (6, 6), (9, 7)):
        assert wordpair.frequent(counts, most).count() == want


def variants(counts):
    near, cut = collections.defaultdict(set), collections.defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            v = w[:i] + w[i + 1 :]
            cut[v, i].add(w)
            if v in counts:
                near[w].add(v)
                near[v].add(w)
    for same in cut.values():
        for w in same:
            near[w] |= same - {w}
    best = {w: min(near[w], key=lambda v: (-counts[v], v)) for w in counts if near[w]}
    form = {w: v for w, v in best.items() if counts[v] >= 5 * counts[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None) for w, n in counts.items()}


@pytest.mark.parametrize("crowded", [16, 0])
def test_variants(spark, monkeypatch, crowded):
    """Pairs of all kinds of edits, chains of forms, words that share long starts and ends; with ``crowded`` 0 every list is split to its end."""
    monkeypatch.setattr(spelling, "CROWDED", crowded)
    rng, made = random.Random(5), set()
    for stem in ["aaaaaa", "abababab", "prefixprefixprefix", "éàüßöñ", "wordword"]:
        made.add(stem)
        for _ in range(60):
            w = rng.choice(sorted(x for x in made if x[0] == stem[0]))
            i = rng.randrange(len(w))
            made.add(rng.choice([w[:i] + rng.choice("abpé×") + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice("abpé×") + w[i + 1 :]]))
    made |= {"prefixprefix" + "".join(rng.choice("abc") for _ in range(4)) for _ in range(80)} | {"".join(rng.choice("ab") for _ in range(9)) for _ in range(200)}
    counts = {w: rng.choice([5, 5, 30, 160, 900, 5000, 26000]) for w in made if len(w) >= 6}
    out = spelling.variants(spark.createDataFrame(sorted(counts.items()), "word string, n long").repartition(3))
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(counts) and set(got) == variants(counts)
    assert sum(1 for w in got if w[1] not in (None, w[2])) > 20
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0


def planted(docs):
    out = collections.Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if n >= 5 and len(w) >= 6}


def test_variants_query(spark, odd, tmp_path):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert {tuple(r) for r in spelling_query.op12_spelling_variants(spark, SMALL).collect()} == variants(planted(docs))
    rows = [(k, f"Éclair straße {'xß' * (k + 2)} Reading reading-READINGĀreading") for k in range(400)] + [(r["doc_id"], r["text"]) for r in odd.collect()]
    spark.createDataFrame(rows, DOCS).withColumn("word", F.lit("clash")).withColumn("n", F.lit(0)).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in spelling_query.op12_spelling_variants(spark, str(tmp_path)).collect()}
    assert got == variants(planted(rows)) and {"reading", "straße"} < {r[0] for r in got}


def test_checksums():
    rng = random.Random(3)
    parts = [bytes(rng.randrange(256) for _ in range(n)) for n in [0, 1, 2, 5, 63, 64, 65, 127, 128, 400, 70_000]]
    ends = np.cumsum([len(x) for x in parts])
    data, starts = np.frombuffer(b"".join(parts), np.uint8), ends - [len(x) for x in parts]
    own = checksums.span_crcs(data, starts, ends)
    assert own.tolist() == [zlib.crc32(x) for x in parts]
    pairs = [(a, b) for a in range(len(parts)) for b in range(len(parts))]
    x, y = np.array(pairs).T
    assert checksums.joined(own[x], own[y], (ends - starts)[y]).tolist() == [zlib.crc32(parts[a] + parts[b]) for a, b in pairs]


def brute(docs, target, percent=5):
    def found(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    made = [(i, *found(t)) for i, t in docs]
    s, t = (collections.Counter(b for _, x in rows for b in x) for rows in ([m[1:] for m in made], [found(x) for x in target]))
    sums = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sums[0] + 10_000) / ((s[b] + 1) * (sums[1] + 10_000)))) for b in range(10_000)]
    rows = []
    for i, n, x in made:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in x)
        rows.append((i, n, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    may = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = [(r[0], *r[2:], k) for k, r in enumerate(may[: percent * len(may) // 100], 1)]
    rest = [(r[0], *r[2:], None) for r in [*may[percent * len(may) // 100 :], *[r for r in rows if r[1] < 20]]]
    return collections.Counter(drawn + rest)


def test_resampling_query(spark, odd, tmp_path):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert collections.Counter(map(tuple, resampling_query.op13_importance_resampling(spark, SMALL).collect())) == brute(docs, target)
    rows = docs[:60] + [docs[7]] * 300 + [(r["doc_id"], r["text"]) for r in odd.collect()]
    spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None,), ("",), (target[0],)], "text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert collections.Counter(map(tuple, resampling_query.op13_importance_resampling(spark, str(tmp_path)).collect())) == brute(rows, [target[0]])
    table = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("rank", F.lit("clash"))
    out = resampling.resampled(table, spark.createDataFrame([(target[0],)], "text string"), percent=50)
    want = {r[0] for r in brute(rows, [target[0]], 50).elements() if r[4]}
    assert out.columns == [*table.columns, "rank_"] and {r["doc_id"] for r in out.collect()} == want
    none = resampling.assessed(table.limit(0), spark.createDataFrame([], "text string"))
    assert none.count() == 0


@pytest.mark.parametrize(("most", "samples"), [(0, 64), (1, 64), (700, 1000), (700, 1), (10_000, 4)])
def test_ranks(spark, monkeypatch, most, samples):
    """Exact ranks whatever the samples are; a score and a row that half of all rows have."""
    monkeypatch.setattr(ranking, "PER_SEGMENT", samples)
    rng = random.Random(4)
    rows = [(rng.choice([7, 7, rng.randrange(-50, 50)]), rng.choice([None, 3, 3, k])) for k in range(3000)]
    got = ranking.ranked(spark.createDataFrame(rows, "score long, doc_id long").repartition(7), most, 13).collect()
    assert collections.Counter((r["score"], r["doc_id"]) for r in got) == collections.Counter(rows)
    ordered = sorted(rows, key=lambda r: (-r[0], r[1] is not None, r[1] or 0))
    assert [(r["score"], r["doc_id"]) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == ordered[:most]
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, min(most, 3000) + 1))
