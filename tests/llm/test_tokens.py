"""Byte-level BPE, packing, language identification, sanitisation and the pipeline."""

import base64
import collections
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dossier.llm import bytepair, bytepair_query, language, language_query, packing, packing_query, privacy, privacy_query, textarrays

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [None, "", " ", "\n\n  x", "Hello  world!! it's 12345 ok  y 　z\x85w\x1cv", "größer 😀😀 naïve 日本語テキスト", "-" * 777 + "=" * 333 + " " * 99, "a" * 5000, "<|endoftext|> and </s>", "tab\t\ttab \t x\r\n\r\n y", "é " * 2000, "́‍👩‍👩‍👧 नमस्ते", "x.y!z?", "don't we'll I'M THEY'RE"]
DOCS = "doc_id long, text string, ids string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate([*TEXTS, TEXTS[4]])], DOCS).withColumn("decoded", F.lit(0)).repartition(2)


def test_ids_are_those_of_the_rank_file(spark, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    v = bytepair.Vocabulary(spark, RANKS, "ranks", P.PATTERN)
    df = bytepair.encode(docs, v)
    rows = bytepair.decode(df.withColumnRenamed("ids", "clash").withColumnRenamed("ids_", "ids"), v).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        t = r["text"] or ""
        assert r["ids"] == own.encode_ordinary(t)
        assert bytes(r["decoded_"]) == t.encode() and r["decoded_text"] == t and (r["clash"], r["decoded"]) == ("clash", 0)
        raw, at = t.encode(), 0
        for i, a, b in zip(r["ids"], r["starts"], r["ends"], strict=True):
            piece = own.decode_single_token_bytes(i)
            assert raw[at : at + len(piece)] == piece and piece in t[a:b].encode()
            at += len(piece)
        assert not r["ends"] or r["ends"][-1] == len(t)
    assert bytepair.encode(docs.limit(0), v).count() == 0


def test_split_characters_decode(spark):
    v = bytepair.Vocabulary(spark, RANKS, "ranks", P.PATTERN)
    ids = v.encoder().encode(np.frombuffer("𝔘".encode(), np.uint8), np.array([0, 4]))[0].tolist()
    r = bytepair.decode(spark.createDataFrame([(ids[:1],)], "ids array<int>"), v).first()
    assert len(ids) > 1 and "𝔘".encode().startswith(bytes(r["decoded"])) and "�" in r["decoded_text"]


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_words_with_colliding_polynomials():
    one = thue_morse(2048)
    two = one.translate(str.maketrans("ab", "ba"))
    raw = f"{one} {two} {one[:40]} {two[:40]}".encode()
    e = bytepair.Encoder(open(RANKS, "rb").read(), "ranks", P.PATTERN)
    ids = e.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
    assert e.decode(ids)[0].tobytes() == raw and ids.tolist() == e.reference.encode_ordinary(raw.decode())
    data = np.frombuffer(raw, np.uint8)
    s, n, _ = textarrays.words(data, np.array([0, len(raw)]))
    assert len(set(textarrays.span_hashes(data, s, n).tolist())) == 4


def test_ties_of_ranks():
    """Chunks that repeat three bytes are settled by the rank file's library, whatever the merge list says."""
    tokens = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"bab": 259, b"aba": 260, b"ba": 261}
    content = b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for t, i in tokens.items())
    e = bytepair.Encoder(content, "ranks", P.PATTERN)
    rng = np.random.default_rng(0)
    for n in (*range(1, 12), 40):
        for _ in range(60):
            raw = "".join(rng.choice(list("abc"), n))
            assert e._learn([raw.encode()])[0] == e.reference.encode_ordinary(raw)
    assert bytepair.repeats_three_bytes([b"banana", b"abcabd", b"aaaa", b"aaa", b"", b"abcdefab"]).tolist() == [True, False, True, False, False, False]


def test_bpe_query(spark):
    where = "/root/testdata/sf0.001"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = spark.read.parquet(f"{where}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in bytepair_query.op3_byte_bpe(spark, where).collect()}
    assert len(got) == len(rows)
    for r in rows:
        ids = own.encode_ordinary(r["text"] or "")
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
        assert (got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["ids_sha256"], got[r["doc_id"]]["decoded_sha256"]) == want


def test_the_table_of_chunks_starts_anew(monkeypatch, spark):
    monkeypatch.setattr(bytepair, "HELD_IDS", 50)
    e = bytepair.Encoder(open(RANKS, "rb").read(), "ranks", P.PATTERN)
    for k in range(6):
        raw = " ".join(f"word{i * 7 % (50 + k)} again" for i in range(100)).encode()
        ids = e.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        assert ids.tolist() == e.reference.encode_ordinary(raw.decode())


def test_packing(spark, docs):
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    library = Tokenizer.from_file(P.path(packing_query.VOCABULARY))
    library.encode_special_tokens = True
    ids = {r["doc_id"]: np.array([*library.encode(r["text"], add_special_tokens=False).ids, 1], "<u4") for r in rows}
    pieces = packing.pack(docs, packing_query.vocabulary(spark)).collect()
    by, windows = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        assert zlib.crc32(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] and p["doc_tokens"] == len(ids[p["doc_id"]])
        by[p["doc_id"]].append((p["start"], p["length"]))
        windows[p["sequence_id"]].append((p["offset"], p["length"]))
    for k, x in ids.items():
        assert [a for a, _ in sorted(by[k])] == [0, *np.cumsum([n for _, n in sorted(by[k])]).tolist()][:-1] and sum(n for _, n in by[k]) == len(x)
    for w in windows.values():
        assert [a for a, _ in sorted(w)] == [0, *np.cumsum([n for _, n in sorted(w)]).tolist()][:-1] and sum(n for _, n in w) <= packing.SIZE
    assert packing.pack(docs.limit(0), packing_query.vocabulary(spark)).count() == 0


def test_windows_are_the_cheapest():
    rng = np.random.default_rng(4)
    for _ in range(30):
        cuts = np.concatenate([[0], np.cumsum(rng.integers(1, 60, 25))])
        penalty = rng.integers(0, 30, len(cuts))
        size = 128
        best = [0] + [10**9] * (len(cuts) - 1)
        for j in range(1, len(cuts)):
            for i in range(j):
                n = int(cuts[j] - cuts[i])
                if n <= size:
                    free = n & (n - 1) == 0 and n >= 128
                    best[j] = min(best[j], best[i] + (0 if free else size - n) + int(penalty[j]) + packing.WINDOW)
        got = packing.windows(cuts, penalty, size)
        cost = sum((size - int(cuts[b] - cuts[a])) + int(penalty[b]) + packing.WINDOW for a, b in zip(got, got[1:]))
        assert cost == best[-1] and got[0] == 0 and got[-1] == len(cuts) - 1


def test_the_last_window_goes_through_the_programme(spark):
    """A partition's rest: no more padding and cuts than the cheapest way to cut it has, by brute force over its ids."""
    v = packing_query.vocabulary(spark)
    for words_ in (3, 30, 131, 700):
        df = spark.createDataFrame([(1, "one two three. " * words_), (2, "tail")], "doc_id long, text string").coalesce(1)
        pieces = sorted(packing.pack(df, v).collect(), key=lambda p: (p["sequence_id"], p["offset"]))
        total = sum(p["length"] for p in pieces)
        docs_end = {pieces[0]["doc_tokens"], total}
        length = collections.Counter()
        for p in pieces:
            length[p["sequence_id"]] += p["length"]
        ends = np.cumsum([length[k] for k in sorted(length)]).tolist()
        last = ends[-1] - (ends[-2] if len(ends) > 1 else 0)
        assert last & (last - 1) == 0 or packing.SIZE - last < 200
        if total <= packing.SIZE:  # all of it is the rest
            sentence = set(range(4, total, 4))
            best = [0] + [10**9] * total
            for j in range(1, total + 1):
                cost = packing.WINDOW + (0 if j in docs_end else packing.ANYWHERE)
                for i in range(j):
                    n = j - i
                    best[j] = min(best[j], best[i] + cost + (0 if n & (n - 1) == 0 else packing.SIZE - n))
            padding = sum(0 if x & (x - 1) == 0 else packing.SIZE - x for x in length.values())
            assert padding + packing.WINDOW * len(length) <= best[total] and len(sentence) >= 0


def test_blocks_carry_their_last_window(spark, monkeypatch):
    rows = [(i, f"Sentence number {i} is here. " * (1 + i % 200)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    pieces = packing.pack(df, packing_query.vocabulary(spark)).collect()
    n = collections.Counter()
    for p in pieces:
        n[p["sequence_id"]] += p["length"]
    padding = sum(0 if x & (x - 1) == 0 else packing.SIZE - x for x in n.values())
    assert sum(n.values()) > 2 * packing.BLOCK and padding < 0.01 * sum(n.values())
    ends = {p["doc_id"]: max(q["start"] + q["length"] for q in pieces if q["doc_id"] == p["doc_id"]) for p in pieces[:50]}
    assert all(ends[p["doc_id"]] == p["doc_tokens"] for p in pieces[:50])


def test_languages(spark):
    made = {"aa": "the and of that with from", "bb": "der und die das mit von", "cc": "le les et des avec pour", "dd": "el los que con para una", "ee": "og ikke det som på til", "ff": "ja ei se on mutta kun"}
    rng = np.random.default_rng(0)
    say = lambda v: " ".join(rng.choice(v.split(), 30))
    for count in (6, 4, 1):
        rows = [(i, say(v), k) for k, v in list(made.items())[:count] for i in range(40)]
        model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=30)
        test = spark.createDataFrame([(i, say(v), k) for i, (k, v) in enumerate(list(made.items())[:count])] + [(90, None, "aa"), (91, "12 !!", "aa"), (92, "", None)], "doc_id long, text string, lang string")
        got = {r["doc_id"]: r for r in language.predict(test.withColumn("score", F.lit("x")), model, ["doc_id"]).collect()}
        assert [got[i]["lang_pred"] for i in range(count)] == list(made)[:count] and all(0 < got[i]["score"] <= 1 for i in range(count))
        assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (90, 91, 92))
    none = language.learn(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert language.predict(test, none, ["doc_id"]).first()["lang_pred"] == "und"
    one, two = (np.frombuffer(x, np.uint8) for x in (b"ab", b"ab" + b"cdefg"))
    assert (language.features(one, np.array([0, 2]))[0] == language.features(two, np.array([0, 2, 7]))[0]).all()
    repeated = language.predict(test.union(test).withColumn("lang_pred", F.lit("x")), model, ["doc_id", "lang_pred"]).collect()
    assert len(repeated) == 2 * test.count() and {r["lang_pred"] for r in repeated} == {"x"} and all(r["lang_pred_"] for r in repeated)
    assert language.predict(test.limit(0), model, ["doc_id"]).count() == 0
    code = language.codewords(9)
    assert min((code[i] != code[j]).sum() for i in range(9) for j in range(i)) >= 15


def test_decoding_by_brute_force():
    """The nearest codeword by the weighted loss, one bit at a time."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 12)).astype(np.float32)
    model = language.fit(x, [f"l{i % 7}" for i in range(40)])
    assert (0 <= model.trust).all() and (model.trust <= 1).all() and len(set(np.round(model.trust, 6))) > 1
    for row, s in zip(x, model.scores(x), strict=True):
        loss = [sum(t * np.log1p(np.exp(-b * (row @ w + c))) for b, w, c, t in zip(code, model.weights.T, model.bias, model.trust, strict=True)) for code in model.code]
        want = np.exp(min(loss) - np.array(loss))
        assert np.allclose(s, want / want.sum(), atol=1e-4) and s.argmax() == int(np.argmin(loss))


def test_held_out_accuracy(spark):
    where = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{where}/documents.parquet").collect()}
    rows = language_query.op8_language_id(spark, where).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) > 0.95 * len(held)


def test_base_spans():
    import re

    texts = ["a@b.c x.y@z.w-q.com@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4", "4111 1111-1111 1111 4111 1111 1111 1112", "+1 (555) 123-4567. +12 +1234567890123456 +49-(0)30 1234567", "...@..@a.b_c", "p@q.r" * 50, "😀+1 2345678@x.yz"]
    for t in texts:
        want = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        assert privacy.emails(t) == want
    assert privacy.base_spans(texts[1]) == [("ip", 0, 7), ("ip", 8, 15), ("ip", 26, 35)]
    assert privacy.base_spans("a 4111 1111-1111 1111 b") == [("card", 2, 21)] and privacy.base_spans("a 4111 1111-1111 1112 b") == []
    assert privacy.base_spans(texts[2]) == []  # one run of more than 19 digits, dropped without another try
    assert [(a, b) for k, a, b in privacy.base_spans(texts[3]) if k == "phone"] == [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", texts[3]) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_disclosing_terms(spark):
    rows = [(i, f"filler{i} words here. Contact Zarquon at zq@site.org number{chr(97 + i)} today") for i in range(5)]
    rows += [(100 + i, f"other text {i} with words here and contact at today") for i in range(60)] + [(200, None), (201, ""), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash"))
    found = {r["doc_id"]: r for r in privacy.spans(df.drop("spans")).collect()}
    t = rows[0][1]
    assert [(s["kind"], t[s["start"] : s["end"]]) for s in found[0]["extra"]] == [("term", "Zarquon")] and not found[100]["extra"]
    safe = {r["doc_id"]: r["text"] for r in privacy.sanitised(df).collect()}
    assert safe[0] == "filler0 words here. Contact  at [email] numbera today" and safe[200] is None and safe[100] == rows[5][1]
    assert privacy.sanitised(df).columns == df.columns and privacy.sanitised(df.limit(0)).count() == 0


def disclosed(rows):
    """Terms by brute force: counts over rows, the lower bound of the share with different contexts as trials."""
    import math

    n = len(rows)
    with_entity, with_term, both, contexts = collections.Counter(), collections.Counter(), collections.defaultdict(set), collections.defaultdict(set)
    for k, (_, t) in enumerate(rows):
        t = t or ""
        base = privacy.base_spans(t)
        with_entity.update({privacy.entity(x, t[a:b]) for x, a, b in base})
        with_term.update({w for w, _, _ in privacy.terms(t)})
        for names, near in privacy.passages(t, base):
            for e in names:
                for w in near:
                    both[e, w].add(k)
                    contexts[e, w].add(" ".join(near))
    out = set()
    for (e, w), found in both.items():
        p = min(1, len(found) / with_term[w])
        m, z = len(contexts[e, w]) / p, privacy.Z
        low = (p + z * z / (2 * m) - z * math.sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)
        if with_entity[e] < n and 1 + math.log(low) / math.log(n / with_entity[e]) >= privacy.THRESHOLD:
            out.add(w)
    return out


def test_pii_query_by_brute_force(spark, tmp_path):
    import re

    rng = np.random.default_rng(5)
    common = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(400):
        w = rng.choice(common, 25).tolist()
        if i % 20 == 0:
            who = i // 20 % 5
            w[10:10] = [f"Name{who}", f"n{who}@site.org.", "+49 30 1234567" if who == 2 else "10.0.0.7", "card", "4111 1111 1111 1111"]
        if i % 33 == 0:
            w.append("Name0" if i < 200 else "NAME1,")
        rows.append((i, " ".join(w)))
    rows += [rows[0], rows[0], rows[20], (None, rows[40][1]), (None, rows[40][1]), (None, None), (900, ""), (901, "x" * 30_000 + " n1@site.org"), (902, rows[60][1])]
    spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, spans string").write.parquet(str(tmp_path / "documents.parquet"))
    names = disclosed(rows)
    assert names and any(x.startswith("name") for x in names)
    want = collections.Counter()
    for i, t in rows:
        base = sorted(privacy.base_spans(t or ""), key=lambda x: (privacy.KINDS.index(x[0]), x[1]))
        more = [("term", a, b) for w, a, b in privacy.terms(t or "") if w in names]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        want[i, tuple(sum(x[0] == k for x in base) for k in privacy.KINDS), hashlib.sha256(joined.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for k, a, b in [*base, *more])] += 1
        assert [(a, b) for k, a, b in base if k == "card"] == [m.span() for m in re.finditer("4111 1111 1111 1111", t or "")]
    got = collections.Counter((r["doc_id"], tuple(r[f"n_{k}"] for k in privacy.KINDS), r["base_sha256"], r["spans"]) for r in privacy_query.op4_pii(spark, str(tmp_path)).collect())
    assert got == want


def test_terms_fold_alike_everywhere(spark):
    names = ["Élodie", "Иванов", "ΟΔΥΣΣΕΥΣ", "(((((Zarquon)))))"]
    for word in names:
        text = f"Contact {word} at zq@site.org"
        data, offsets = textarrays.flat(pa.array([privacy.fold(text)]))
        assert {privacy.term_key(w) for w, _, _ in privacy.terms(text)} == set(privacy.term_keys(data, offsets)[0].view(np.int64).tolist())
    rows = [(i, f"Contact {(names[0], names[0].upper())[i % 2]} or ((((({names[1]}))))) at zq@site.org number{chr(97 + i)} today") for i in range(5)]
    rows += [(100 + i, f"other text {i} or contact at today") for i in range(60)]
    found = {r["doc_id"]: r["extra"] for r in privacy.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all([t[s["start"] : s["end"]].lower() for s in found[i]] == ["élodie", "иванов"] for i, t in rows[:5]) and not found[100]


def test_terms_are_removed_wherever_they_are(spark):
    rows = [(i, f"The account KD-4711 and, in one long list of all the many other things at hand, Zarquon: zq@site.org number{chr(97 + i)} today") for i in range(12)]
    rows += [(100 + i, f"The account and in one long list of all the many other things at hand {i} number today") for i in range(600)]
    rows += [(200, "KD-4711 is here without an address, as is zarquon"), (201, "顾客编号四七一一在这里。")]
    df = spark.createDataFrame([*rows, rows[70]], "doc_id long, text string")
    got = privacy.spans(df).collect()
    found = {r["doc_id"]: [dict(rows)[r["doc_id"]][s["start"] : s["end"]] for s in r["extra"]] for r in got}
    assert len(got) == len(rows) + 1 and found[0] == ["KD-4711", "Zarquon"] and found[200] == ["KD-4711", "zarquon"] and not found[100] and not found[201]
    assert {r["doc_id"]: r["text"] for r in privacy.sanitised(df).collect()}[200] == " is here without an address, as is "
    assert privacy.passages("Jo Roe.\nzq@site.org and more. Next", privacy.base_spans("Jo Roe.\nzq@site.org and more. Next")) == [(["email:zq@site.org"], ["jo", "roe", "and", "more", "next"])]


def test_rare_entities_are_covered(spark):
    rows = [(i, f"filler text {i % 50} without any name") for i in range(3000)] + [(5000, "Plate K-XY99 belongs to zq@site.org here")]
    found = {r["doc_id"]: len(r["extra"]) for r in privacy.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found.pop(5000) == 5 and not any(found.values())


def test_list_of_entities():
    """Two thousand addresses and names in one line: terms near entities are in proportion to the line, and each address has its own name."""
    text = "Guests: " + ", ".join(f"Name{k} Sur{k} <u{k}@site{k}.example.org>" for k in range(2000))
    found = privacy.passages(text, privacy.base_spans(text))
    pairs = sum(len(names) * len(near) for names, near in found)
    assert sum(len(names) for names, _ in found) == 2000 and pairs <= 2000 * (2 * privacy.REACH + 2 * privacy.NEAR)
    assert all(f"name{names[0].split('@')[0].split(':u')[1]}" in near for names, near in found)


def test_scores_depend_on_the_text_alone(spark):
    """Bit for bit: alone, in batches of any size, beside long texts."""
    rng = np.random.default_rng(5)
    words_ = {"en": "the of and to in that it was for with".split(), "de": "der die und in das nicht mit von zu auf".split(), "fr": "le la et les des une que pour dans est".split()}
    texts = [(" ".join(rng.choice(words_[v], rng.integers(3, 40))), v) for v in words_ for _ in range(60)]
    x = np.concatenate([language.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])) for t, _ in texts])
    model = language.fit(x, [v for _, v in texts])
    together = model.scores(x)
    for size in (1, 2, 7, 50):
        apart = np.concatenate([model.scores(x[k : k + size]) for k in range(0, len(x), size)])
        assert (apart == together).all()
    long_ = " ".join(t for t, _ in texts) * 150
    assert len(long_) > 1_500_000
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate([*texts, (long_, None), texts[0]])], "doc_id long, text string")
    for parts in (1, 5):
        got = {r["doc_id"]: r["score"] for r in language.predict(df.repartition(parts), model, ["doc_id"]).collect()}
        assert [got[k] for k in range(len(texts))] == together.max(axis=1).tolist() and got[len(texts) + 1] == got[0] and got[len(texts)] > 0


def test_long_texts_in_bytes(spark):
    """A text over a slice's size, with every kind of white space, in one piece."""
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path(bytepair_query.RANKS)
    ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in open(path, "rb") if line.strip())}
    library = tiktoken.Encoding("long", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = "".join(f"wörd{k % 977}{' ' if k % 7 else chr(10) + '  '}" for k in range(600_000)) + "x" * 30_000
    assert len(text.encode()) > 5_000_000
    vocabulary = bytepair.Vocabulary(spark, path, "ranks", public_tokenizers.PATTERN)
    assert bytepair.encode(spark.createDataFrame([(text,), ("a",)], "text string"), vocabulary).filter("length(text) > 1").first()["ids"] == library.encode_ordinary(text)
