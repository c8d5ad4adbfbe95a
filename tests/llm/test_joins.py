"""Near-duplicate documents and lines against brute force, with hot shingles, ties and edge cases."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dossier.llm import linededup, linededup_query, linejoin, neardup, neardup_query, setjoin
from dossier.llm.textarrays import U

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, version string, sid long"


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def alike(a, b):
    both = len(a & b)
    return bool(both) and 4 * both >= 3 * (len(a) + len(b) - both)


def corpus(seed=3):
    """Near copies in chains, a passage that many share, copies, short and odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    passage = " ".join(word() for _ in range(30))
    texts = []
    for _ in range(12):
        w = [word() for _ in range(rng.randint(8, 90))]
        for _ in range(rng.randint(1, 6)):
            texts.append(" ".join(w))
            w = list(w)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = word()
    texts += [" ".join([word() for _ in range(rng.randint(5, 60))] + [passage]) for _ in range(30)]
    texts += [texts[0]] * 8 + [texts[1].upper()] * 2 + [None, "", " \n", "one", "one", "One two", "a b c d e", "A b  c\nd e"]
    rng.shuffle(texts)
    return texts


def components(texts):
    sets = [shingle_set(t) for t in texts]
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for j in range(len(texts)):
        for i in range(j):
            if alike(sets[i], sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(sets[i]), top(i)) for i in range(len(texts))}


@pytest.mark.parametrize("block", [1024, 4])
def test_classes(spark, monkeypatch, block):
    monkeypatch.setattr(setjoin, "BLOCK", block)
    texts = corpus()
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in enumerate(texts)], DOCS).repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.classes(df).collect()}
    assert got == components(texts)
    left = {r["doc_id"] for r in neardup.one_of_each(df).collect()}
    assert left == {c for _, c in components(texts).values()}


def test_join_query(spark):
    where = "/root/testdata/sf0.001"
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{where}/documents.parquet").collect())
    want = components([t for _, t in rows])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup_query.op9_ngram_jaccard_join(spark, where).collect()}
    assert got == {rows[i][0]: (n, rows[c][0]) for i, (n, c) in want.items()}


def test_classes_of_odd_tables(spark):
    df = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (7, None), (None, None)], "doc_id long, text string")
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.classes(df).collect()), key=str) == sorted([(5, 2, 5), (5, 2, 5), (None, 2, 5), (7, 0, 7), (None, 0, None)], key=str)
    assert neardup.classes(df.limit(0)).count() == 0


def test_one_row_of_each_component(spark):
    same, near = "a b c d e f g h i j k l m n o p", "A b c d e f g h i j k l m n o p q"
    rows = [(5, same)] * 40 + [(5, near), (6, same), (None, same), (None, "v w x y z"), (None, "V w x y z"), (None, "V w x y z"), (7, None), (7, None), (8, " "), (9, "one two"), (None, None)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, n long").repartition(3)
    out = neardup.one_of_each(df)
    left = [(r["doc_id"], (r["text"] or "").lower().strip()) for r in out.collect()]
    assert out.columns == df.columns and len(left) == 6
    assert sorted(left, key=str) == sorted([(5, left[[x[0] for x in left].index(5)][1]), (None, "v w x y z"), (7, ""), (8, ""), (9, "one two"), (None, "")], key=str)


def word_set(line):
    return frozenset(re.findall(r"[^\x20\x09-\x0D]+", line.translate(LOW)))


def removed_lines(rows):
    sets, gone = [], collections.defaultdict(list)
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        for k, line in enumerate((t or "").split("\n")):
            s = word_set(line)
            if s and any(alike(s, x) for x in sets):
                gone[i].append(k)
            if s:
                sets.append(s)
    return gone


def line_rows():
    """Near copies, one word changed, lines of one to four words, other orders of words, repeated rows, a null id, a long text."""
    rng = random.Random(5)
    lines = [(t or "").replace("\n", " ") for t in corpus(9)]
    lines += ["Subscribe to our newsletter", "subscribe to our  newsletter", "All rights reserved.", "The.", "the.", "a b", "b a", "one two three", "three two one four", " ".join(f"w{k}" for k in range(20)), " ".join(f"w{k}" for k in range(19)) + " x"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 8)))) for i in range(60)] + [(60, None), (61, ""), (62, "\n\n"), (None, lines[0] + "\nThe.")]
    return [*rows, rows[3], rows[3], (70, "\n".join(rng.choice(lines) + (f" {k}" if k % 3 else "") for k in range(3000)))]


@pytest.mark.parametrize("often, longest, block, some", [(4096, 4096, 1024, 8), (6, 5, 4, 1)])
def test_lines(spark, monkeypatch, often, longest, block, some):
    monkeypatch.setattr(linejoin, "OFTEN", often)
    monkeypatch.setattr(linejoin, "LIST", longest)
    monkeypatch.setattr(linejoin, "TILE", block)
    monkeypatch.setattr(linededup, "SOME", some)
    rows = line_rows()
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], DOCS).withColumn("removed", F.lit("clash")).repartition(3)
    out = linededup.without_later_matches(df, "numbers")
    assert out.columns == [*df.columns, "numbers"] and linededup.without_later_matches(df.limit(0)).count() == 0
    got = collections.Counter((r["doc_id"], r["text"], tuple(r["numbers"] or ())) for r in out.collect())
    gone = removed_lines(rows)
    want = collections.Counter((i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in set(gone[i])), tuple(gone[i])) for i, t in rows)
    assert got == want


def test_hot_lines(spark, monkeypatch):
    """A group of near copies that holds a third of all lines, beside unlike lines with its words."""
    monkeypatch.setattr(linejoin, "LIST", 20)
    monkeypatch.setattr(linejoin, "TILE", 16)
    rng = random.Random(8)
    hot = [f"h{k}" for k in range(24)]
    rows = []
    for i in range(240):
        w = list(hot)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(24)] = f"x{rng.randrange(400)}"
        rows.append((i, "\n".join([" ".join(w), " ".join(rng.sample(hot, 5) + [f"y{rng.randrange(3000)}" for _ in range(15)]), f"line {i} by itself"])))
    got = {r["doc_id"]: r["numbers"] or [] for r in linededup.without_later_matches(spark.createDataFrame(rows, "doc_id long, text string"), "numbers").collect()}
    gone = removed_lines(rows)
    assert got == {i: gone[i] for i, _ in rows}


def test_line_query(spark):
    where = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{where}/documents.parquet").collect()]
    gone = removed_lines(rows)
    got = {r["doc_id"]: (r["n_removed"], r["removed_lines"]) for r in linededup_query.op7_line_dedup(spark, where).collect()}
    assert got == {i: (len(gone[i]), ",".join(map(str, gone[i]))) for i, _ in rows}


def test_words_of_one_set_are_not_posted():
    """A word that the sketch counted once can meet no other set; its place in the order still counts."""
    tokens, cuts = np.arange(1, 17, dtype=np.uint64) << np.uint64(60 - 16), np.array([0, 8, 16])
    levels = np.zeros(linejoin.CELLS, np.uint8)
    levels[linejoin._cell(tokens[[2, 9]])] = 4
    h, unit, at = linejoin.signatures(tokens, cuts, levels, 100)
    assert (h.tolist(), unit.tolist(), at.tolist()) == (tokens[[2, 9]].tolist(), [0, 1], [2, 1])
    assert linejoin._repeated(np.array([5, 7, 5, 1], np.uint64)).tolist() == [True, False, True, False] and not len(linejoin._repeated(np.zeros(0, np.uint64)))


def test_parity_maps_bound_the_difference():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, n).astype(U) * U(0x9E3779B97F4A7C15)) for n in rng.integers(1, 250, 60)]
    maps = linejoin.parity_maps(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])]))
    for kind in range(3):
        m = linejoin._folded(maps, kind)
        for a in range(0, 60, 7):
            for b in range(60):
                assert np.bitwise_count(m[a] ^ m[b]).sum() <= len(np.setxor1d(sets[a], sets[b]))


def test_prefixes_hold_the_overlap():
    rng = np.random.default_rng(1)
    tokens = np.sort(rng.choice(1 << 40, 90, replace=False).astype(U))
    known = np.sort(rng.choice(tokens, 50, replace=False))
    marks = np.zeros(1 << 22, bool)
    marks[(known & U(len(marks) - 1)).astype(np.int64)] = True
    cuts = np.array([0, 40, 40, 90])
    i, unit, place = setjoin.prefixes(tokens, cuts, (known, np.arange(50)[::-1].copy(), marks))
    assert np.bincount(unit, minlength=3).tolist() == [11, 0, 13]
    for u in (0, 2):
        assert sorted(place[unit == u].tolist()) == list(range(len(place[unit == u])))
        rare = ~np.isin(tokens[cuts[u] : cuts[u + 1]], known)
        assert np.isin(tokens[i[unit == u]], known).sum() == max(0, (unit == u).sum() - rare.sum())


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 400, n).astype(U) << U(7)) for n in rng.integers(1, 300, 60)]
    n = np.array([len(x) for x in sets])
    i, j = (x.ravel() for x in np.meshgrid(np.arange(60), np.arange(60)))
    cuts = np.concatenate([[0], np.cumsum(n)])
    fits = setjoin._Maps(setjoin.bitmaps(np.concatenate(sets), cuts).tolist(), n).fits(i, j)
    both = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    assert fits[7 * both >= 3 * (n[i] + n[j])].all() and not fits.all()


def test_components_of_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (900, 900)], "a long, b long")
    rows = setjoin.components(links).collect()
    by = collections.defaultdict(set)
    for r in rows:
        by[r["component"]].add(r["sid"])
    assert sorted(map(len, by.values())) == [2, 201]
    assert setjoin.components(links.filter(F.lit(False))).count() == 0


def test_long_lists_meet_their_neighbours(spark):
    """A list over the real ``TILE``, in several parts of each band: every open set meets the sets of its own and of both neighbouring bands."""
    rng = np.random.default_rng(3)
    sets = []
    for k in range(900):
        whole = rng.integers(1, 1 << 63, 24, dtype=np.uint64)
        for n in (18, 21, 24) if k % 2 else (24, 18, 17):
            sets.append(whole[:n])
    n = np.array([len(x) for x in sets])
    maps = linejoin._folded(linejoin.parity_maps(np.concatenate(sets), np.concatenate([[0], np.cumsum(n)])), 0)
    rows = [(7, k, int(n[k]), 0, k, maps[k].tobytes(), k % 3 != 0) for k in range(len(sets))] + [(8, k, int(n[k]), 0, k, maps[k].tobytes(), True) for k in range(30)]
    assert len(sets) > 2 * linejoin.TILE
    kept = spark.createDataFrame(rows, "token long, sid long, n int, at int, first long, map binary, open boolean")
    got = {(r["a"], r["b"]) for r in linejoin.further_pairs(kept, None).collect()}
    i, j = np.triu_indices(len(sets), 1)
    need = -(-3 * (n[i] + n[j]) // 7)
    near = (4 * np.minimum(n[i], n[j]) >= 3 * np.maximum(n[i], n[j])) & (np.minimum(n[i], n[j]) >= need) & (np.bitwise_count(maps[i, 0] ^ maps[j, 0]) <= n[i] + n[j] - 2 * need)
    want = {(int(b), int(a)) for a, b in zip(i[near], j[near]) if b % 3 != 0 or b < 30}
    assert got == want and sum(1 for a, b in want if {n[a], n[b]} == {18, 24}) > 500


def test_one_set_in_a_list_twice(spark):
    """Where two words share a list by their hashes, the set's least place counts."""
    lines = [f"a{k % 3} b{k} c d e f g h" for k in range(40)]
    rows = list(enumerate(lines))
    got = {r["doc_id"]: r["numbers"] or [] for r in linededup.without_later_matches(spark.createDataFrame(rows, "doc_id long, text string"), "numbers").collect()}
    gone = removed_lines(rows)
    assert got == {i: gone[i] for i, _ in rows}


def posted_list(rng, token, many, sizes):
    """Postings of one list: sets of every size in ``sizes`` at every place of their prefixes."""
    n = rng.choice(sizes, many)
    return [(token, token * 100_000 + k, int(n[k]), int(rng.integers(0, n[k] // 4 + 1)), k) for k in range(many)]


def near_places(rows):
    """Pairs of positions in ``rows`` (``token, sid, n, at, ...``) that the length and positional filters leave."""
    n, at, token = (np.array([r[c] for r in rows]) for c in (2, 3, 0))
    i, j = np.triu_indices(len(rows), 1)
    need = -(-3 * (n[i] + n[j]) // 7)
    ok = (token[i] == token[j]) & (4 * np.minimum(n[i], n[j]) >= 3 * np.maximum(n[i], n[j])) & (np.minimum(n[i] - at[i], n[j] - at[j]) >= need)
    return list(zip(i[ok].tolist(), j[ok].tolist(), strict=True))


def test_tiles_hold_all_pairs_that_size_and_place_leave(spark, monkeypatch):
    """Long lists of op9: each such pair meets in just one tile, whatever its bands and places; two late sets need none."""
    monkeypatch.setattr(setjoin, "BLOCK", 16)
    rng = np.random.default_rng(4)
    rows = posted_list(rng, 1, 400, [40, 41, 52, 53, 55, 70, 71, 93, 94, 200]) + posted_list(rng, 2, 12, [30, 31, 40])
    df = spark.createDataFrame([(*r[:4], r[4]) for r in rows], "token long, sid long, n int, at int, group long")
    tiles = collections.defaultdict(list)
    for r in setjoin.tiled(df).collect():
        tiles[r["tile"]].append((r["sid"], r["side"]))
    met = collections.Counter(frozenset((a, b)) for t in tiles.values() for k, (a, x) in enumerate(t) for b, y in t[:k] if x != y or x == 2)
    wanted = near_places(rows)
    assert len(wanted) > 5000 and all(met[frozenset((rows[i][1], rows[j][1]))] == 1 for i, j in wanted)
    assert max(met.values()) == 1
    late = [k for k, r in enumerate(rows) if r[0] == 1 and 7 * r[3] > r[2]]
    assert len(late) > 100 and not any(frozenset((rows[i][1], rows[j][1])) in met for i in late for j in late if i != j)


@pytest.mark.parametrize("asking", [1, 3])
def test_tiles_of_open_sets_are_bounded(spark, monkeypatch, asking):
    """Long lists of op7: each open set meets all sets that size and place leave, and no tile grows with the open ones."""
    monkeypatch.setattr(linejoin, "TILE", 32)
    rng = np.random.default_rng(5)
    rows = posted_list(rng, 1, 900, [18, 20, 21, 24, 28, 29]) + posted_list(rng, 2, 20, [18, 20])
    df = spark.createDataFrame([(*r[:4], r[4], b"", k % asking == 0) for k, r in enumerate(rows)], "token long, sid long, n int, at int, first long, map binary, open boolean")
    tiles = collections.defaultdict(list)
    for r in linejoin._beside(df).collect():
        tiles[r["tile"]].append((r["sid"], r["open"], r["other"]))
    met = {(a, b) for t in tiles.values() for a, x, _ in t if x for b, _, y in t if y and a != b}
    for i, j in near_places(rows):
        a, b = rows[i][1], rows[j][1]
        assert (i % asking or (a, b) in met) and (j % asking or (b, a) in met)
    assert max(map(len, tiles.values())) < 4 * 32


def test_a_passage_that_unlike_documents_share_copies_nothing(spark):
    """Sets whose common shingles come late in their order can't be alike: 20,000 of them on one shingle go to no tile."""
    rows = spark.range(20_000).select(F.lit(7).cast("long").alias("token"), F.col("id").alias("sid"), (F.col("id") % 90 + 100).cast("int").alias("n"), F.col("id").alias("group"))
    late = rows.withColumn("at", F.ceil(F.col("n") / 5).cast("int"))
    assert setjoin.tiled(late).count() == 0
    beside = linejoin._beside(late.select("token", "sid", "n", "at", F.col("group").alias("first"), F.lit(b"").alias("map"), F.lit(True).alias("open")))
    assert beside.count() == 0


def test_few_rows_make_few_tiles_tasks(spark):
    """Tiles are dealt out by their rows: a small table makes fewer tasks than the session has shuffle partitions."""
    df = spark.range(300).select((F.col("id") % 9).alias("tile"), "id")
    parts, partitions = spark.conf.get("spark.sql.shuffle.partitions"), "spark.sql.shuffle.partitions"
    try:
        spark.conf.set(partitions, "64")
        dealt = setjoin.by_tile(df).rdd
        tiles = [[r["tile"] for r in p] for p in dealt.glom().collect()]
    finally:
        spark.conf.set(partitions, parts)
    assert len(tiles) < 64 and all(t == sorted(t) for t in tiles)
    assert sum(len(set(t)) for t in tiles) == 9 and sum(map(len, tiles)) == 300


def test_verified_says_which_set_is_later(spark):
    """Places of both sets come with the verified pair: by document, null first, then by line."""
    rows = [(None, "a b c d e"), (3, "a b c d\nz y x\na b c d e f"), (1, "q r s t\nq r s t u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("version", F.xxhash64("text")).select("doc_id", "version", "text")
    lines = linejoin.survey(docs).filter("part IS NULL").collect()
    sid = {(r["doc_id"], r["number"]): r["sid"] for r in lines}
    nodes = spark.createDataFrame([(r["sid"], r["doc_id"], r["version"]) for r in lines], "sid long, doc_id long, version long")
    pairs = spark.createDataFrame([(sid[None, 0], sid[3, 0]), (sid[3, 2], sid[None, 0]), (sid[1, 1], sid[1, 0]), (sid[3, 1], sid[1, 0])], "a long, b long")
    got = {(r["a"], r["b"]): r["later"] for r in setjoin.verified(pairs, docs, linejoin.line_words, nodes, later=True).collect()}
    assert got == {(sid[None, 0], sid[3, 0]): sid[3, 0], (sid[3, 2], sid[None, 0]): sid[3, 2], (sid[1, 1], sid[1, 0]): sid[1, 1]}


@pytest.mark.parametrize("kind", [0, 1, 2])
def test_packed_postings(kind):
    """Postings come back as they were, in any parts, and their bytes leave the numbers' room to compression."""
    rng = np.random.default_rng(kind)
    x = np.zeros(3000, linejoin.POSTING[kind])
    for c in ("list", "sid", "map"):
        x[c] = rng.integers(0, np.iinfo(x[c].dtype).max, x[c].shape, x[c].dtype, endpoint=True)
    x["order"], x["n"], x["at"] = np.sort(rng.integers(7 << 20, 8 << 20, 3000)), rng.integers(3, 90, 3000), rng.integers(0, 20, 3000)
    x["n"][5], x["at"][6], x["order"][7] = 2**32 - 1, 65535, 2**32 - 1
    cuts = [0, 0, 1, 900, 900, 3000, 3000]
    got = [linejoin.unpacked(b, x.dtype) for b in linejoin.packed(x, cuts)]
    assert [len(g) for g in got] == np.diff(cuts).tolist() and np.concatenate(got).tobytes() == x.tobytes()
    assert linejoin.packed(x[:0], [0, 0]) == [b""]
    size = lambda b: len(pa.compress(b, "lz4_raw", asbytes=True))
    assert size(linejoin.packed(x, [0, 3000])[0]) < size(x.tobytes()) - 4 * 3000
