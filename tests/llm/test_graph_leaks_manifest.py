"""Collocations, benchmark decontamination and the dataset manifest against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import collocations, contamination, merkle

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def same_rows(got, want):
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


# --- collocations


def brute_phrases(rows, least=10, top=2000, share=50):
    found, sizes = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            sizes[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    found[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, f in found.items():
        kept = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            if len(p) == 2 and any(100 * b >= share * a for q, b in f.items() if len(q) == 3 and b >= least and p in (q[:2], q[1:])):
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, sizes[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return out


def talk(n=4000, seed=1):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(30)] + ["Straße", "ÉA", "日本", "don't"]
    line = lambda k: " ".join(words[i] for i in np.minimum(rng.zipf(1.5, k) - 1, len(words) - 1))
    rows = [(f"{line(int(rng.integers(0, 30)))}{rng.choice([',', '.', chr(10), ' ', chr(9)])}{line(12)}", rng.choice(["en", "de"])) for _ in range(n // 40)]
    passage = " ".join(f"p{i}" for i in range(40))
    rows += [(f"x{i} {passage} y{i}", "en") for i in range(12)] + [(passage + ". " + passage, "de")] * 6
    return rows + [(None, "en"), ("", None), ("one two " * 15, None), (" \t\n", "xx"), ("a a a a a a a a a a a a", "fr"), ("A b\vA b\rA b\fA b\nA b;A b:A b!A b?A b.A b", "it"), (" ".join(["k l m"] * 3000), "long")]


@pytest.mark.parametrize("top", [2000, 7])
def test_phrases_against_brute_force(spark, top):
    rows = [(t, str(g) if g is not None else None) for t, g in talk()]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3).withColumn("x", F.lit("clash")).withColumn("n", F.lit(1))
    got = collocations.mine(df, top=top).collect()
    same_rows(got, brute_phrases(rows, top=top))
    assert {r["lang"] for r in got} >= {"en", "de", "und", "fr", "it"}


def test_hot_nodes_change_nothing(spark, monkeypatch):
    rows = [(t, str(g) if g is not None else None) for t, g in talk(seed=2)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    key = lambda r: (r["x1"], r["x2"], r["x3"])
    some = sorted(collocations.counts(df).collect(), key=key)
    nodes = np.array([(r["x1"], r["x2"]) for r in some if r["x2"] and not r["x3"]], np.int64).T.copy()
    assert nodes.shape[1] > 40
    monkeypatch.setattr(collocations, "_hot_nodes", lambda *_: collocations._node(*nodes))
    assert sorted(collocations.counts(df).collect(), key=key) == some


def test_paths_compact_to_the_passage(spark):
    passage = [f"p{i}" for i in range(40)]
    df = spark.createDataFrame([(f"a{i} {' '.join(passage)} b{i}", "en") for i in range(12)] + [("p5 p6 z", "en")], "text string, lang string")
    counted = collocations.counts(df)
    found = collocations.paths(counted).collect()
    # p5 p6 also stands elsewhere, so its node parts the passage
    assert sorted(len(r["words"]) for r in found) == [7, 35] and {r["c"] for r in found} == {12}
    names = dict(zip(collocations.hashed("en", [" ".join(passage).encode()])[0].tolist(), passage, strict=True))
    ordered = sorted(([names[w] for w in r["words"]] for r in found), key=len)
    assert ordered[0] == passage[:7] and ordered[1] == passage[5:]


def test_colliding_words_are_found_and_hashed_anew(spark, monkeypatch):
    rows = [("alpha beta gamma. alpha beta delta", "en")] * 12
    df = spark.createDataFrame(rows, "text string, lang string")
    want = brute_phrases(rows)
    real = collocations.hashed

    def colliding(lang, texts, salt=0, lanes=1):
        x, words, data = real(lang, texts, salt, lanes)
        if salt == 0:
            same = real(lang, [b"gamma delta"], 0)[0]
            x = np.where(x == same[1], same[0], x)
        return x, words, data

    calls = []
    counts = collocations.counts
    monkeypatch.setattr(collocations, "counts", lambda d, least, salt: calls.append(salt) or counts(d, least, salt))
    monkeypatch.setattr(collocations, "hashed", colliding)
    same_rows(collocations.mine(df).collect(), want)
    assert calls == [0, 1]


def test_phrase_edge_cases(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert collocations.mine(df).collect() == []
    assert collocations.mine(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).collect() == []
    ties = spark.createDataFrame([("b c. é f. a d", "en")] * 10, "text string, lang string")
    assert [r["phrase"] for r in collocations.mine(ties).orderBy("rank").collect()] == ["a d", "b c", "é f"]


def test_large_counts_stay_exact(spark):
    big = 900_000_000_000_000
    df = spark.createDataFrame([(big, big + 1, big + 3)], "a long, l long, r long")
    assert df.select(collocations._score("a", "l", "r").alias("s")).first()["s"] == 1000000 * big * big // ((big + 1) * (big + 3))


# --- decontamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_leaks(docs, items, size=10):
    windows = defaultdict(set)
    for item, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i : i + size])].add(item)
    out = []
    for doc, text in docs:
        w, hit, named = WORD.findall((text or "").translate(LOWER)), set(), set()
        for k in {len(p) for p in windows}:
            for i in range(len(w) - k + 1):
                if (p := tuple(w[i : i + k])) in windows:
                    hit |= set(range(i, i + k))
                    named |= windows[p]
        listed = sorted(str(i) for i in named if i is not None)
        out.append((doc, len(w), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit)))
    return out


def leaks(rows):
    words = lambda t: (t or "").split()
    items = [(i, " ".join(words(r[1])[5:27]).upper() + "?") for i, r in enumerate(rows) if len(words(r[1])) > 30][:25]
    items += [(100, "short item"), (101, ""), (102, None), (103, "..."), (104, "Straße ÉLAN"), (None, "null id words"), (9, "two rows"), (9, "of one item"), (105, "same same"), (106, "same same"), (107, "ß"), (108, "日本")]
    texts = ["x short-item y", "a Straße, élan b", "STRASSE ÉLAN straße éLAN", "null id words", "two rows of one item", "same same same", "so weiß ß ß", "日本日本 日本", "é 日本", "\x7fshort\x00item\x80", "short", "same " * 30_000]
    docs = [(r[0], r[1]) for r in rows] + [(1000 + i, t) for i, t in enumerate(texts)]
    return docs, items


@pytest.mark.parametrize(("automaton_bytes", "segment_words", "size"), [(1 << 20, 20_000, 10), (150, 5, 10), (400, 3, 2)])
def test_leaks_against_brute_force(spark, rows, monkeypatch, automaton_bytes, segment_words, size):
    docs, items = leaks(rows)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("items", F.lit("clash")).withColumn("words", F.lit(1))
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("first", F.lit("clash"))
    find = contamination.find
    monkeypatch.setattr(contamination, "find", lambda d, b, size: find(d, b, size=size, automaton_bytes=automaton_bytes, segment_words=segment_words))
    got = contamination.judge(df, benchmark, size).collect()
    same_rows(got, brute_leaks(docs, items, size))
    assert sum(r["contaminated"] for r in got) > 20


def test_leak_spans_are_those_of_the_original_text(spark):
    text = "日本: One,TWO;three\nfour -- five."
    df = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    found = contamination.find(df, spark.createDataFrame([(7, "two three"), (8, "FIVE")], "item_id long, text string"), keep=("lang",), size=2).first()
    assert [text[s["start"] : s["end"]] for s in found["spans"]] == ["TWO;three", "five"]
    assert found["items"] == ["7", "8"] and found["kept_lang"] == "en" and [tuple(s) for s in found["words"]] == [(2, 4), (5, 6)]


def test_clean_documents_stay_as_they_are(spark, docs, clashing, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    key = lambda r: str(tuple(r))
    assert sorted(contamination.remove(clashing, none).collect(), key=key) == sorted(clashing.collect(), key=key)
    assert contamination.judge(no_docs, none).collect() == []
    one = spark.createDataFrame([(1, "word word")], "item_id long, text string")
    assert 135 not in {r["doc_id"] for r in contamination.remove(docs, one).collect()}


# --- manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_tree(nodes, fanout):
    """The top, and for each leaf its siblings level by level as (left, right)."""
    steps = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run = nodes[a // fanout * fanout : (a // fanout + 1) * fanout]
            steps[i].append(("".join(run[: a % fanout]), "".join(run[a % fanout + 1 :])))
        at = [a // fanout for a in at]
        nodes = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
    return (nodes or [None])[0], steps


def brute_audit(rows, fanout=16):
    framed = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha(framed(r[0]) + framed(r[3]) + framed(r[2]) + framed(r[4]) + framed(text))
    sources = defaultdict(list)
    for r in rows:
        sources[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = [sorted(sources[s], key=lambda x: x[:3]) for s in order]
    built = [brute_tree([x[2] for x in t], fanout) for t in trees]
    root, above = brute_tree([top for top, _ in built], fanout)
    out = []
    for t, (subroot, steps), up in zip(trees, built, above, strict=True):
        for (_, _, own, r), low in zip(t, steps, strict=True):
            path = low + up
            node = leaf(r, (r[1] or "").translate(LOWER) if r[1] is not None else None) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else own
            for left, right in path:
                node = sha(left + node + right)
            out.append((r[0], own, subroot, root, sha("".join(a + b for a, b in path)), node, node == root))
    return out


def test_manifest_of_the_corpus(docs, rows, clashing):
    same_rows(merkle.audit(docs).collect(), brute_audit(rows))
    same_rows(merkle.audit(clashing).collect(), brute_audit(rows))


@pytest.mark.parametrize(("fanout", "stride"), [(16, 2), (2, 3), (3, 1), (2, 20)])
def test_manifest_of_other_shapes(spark, monkeypatch, fanout, stride):
    rows = [(i, f"Text {i}", "en", f"s{i % 7}" if i % 3 else "hot", 5) for i in range(300)] + [(i, None, None, f"z{i}", None) for i in range(40)] + [(5, "Text 5", "en", "s5", 5)] * 3
    df = spark.createDataFrame([(a, b, c, d, e) for a, b, c, d, e in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    if fanout ** stride > 1 << 16:
        df, rows = df.where("doc_id < 9"), [r for r in rows if r[0] < 9]
    build = merkle.build
    monkeypatch.setattr(merkle, "build", lambda leaves, carried: build(leaves, carried, fanout, stride))
    same_rows(merkle.audit(df).collect(), brute_audit(rows, fanout))


def test_manifest_writes_every_second_level(spark):
    rows = [(i, "a", 1) for i in range(5000)]
    leaves = spark.createDataFrame(rows, "doc_id long, source string, n int").select("source", "doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("digest"))
    manifest = merkle.build(leaves)
    assert [t.count() for t in manifest.levels] == [5000, 20, 1] and [t.count() for t in manifest.source_levels] == [1]
    proof = merkle.proofs(manifest).where("doc_id = 4999").first()
    assert len(proof["steps"]) == 4 and all(len(s["left"]) + len(s["right"]) <= 15 * 64 for s in proof["steps"])


def test_manifest_edge_cases(spark, no_docs):
    assert merkle.audit(no_docs).collect() == []
    one = [(5, "ABC", None, None, None)]
    df = spark.createDataFrame(one, "doc_id long, text string, lang string, source string, n_chars long")
    got = merkle.audit(df).collect()
    same_rows(got, brute_audit(one))
    assert got[0]["leaf"] == got[0]["subroot"] == got[0]["root"] and got[0]["proof_sha256"] == sha("")
    long = [(10**15 + i, "Ä" * 300_000, "en", "s", 300_000) for i in range(3)]
    same_rows(merkle.audit(spark.createDataFrame(long, df.schema)).collect(), brute_audit(long))
