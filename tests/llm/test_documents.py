"""Document operators against brute force, with the defined edge cases in the fixture."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from functools import lru_cache
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerline.llm import ctw, mixing, packing, pii, quality, resemblance, simhash, sstable, substring, tokens
from ledgerline.llm import words as words_module
from ledgerline.llm.words import Words

LAST = 1 << 62


def words(text):
    return (text or "").encode().split()


def sid(doc_id):
    return LAST if doc_id is None else doc_id


def remove_repeats(rows, window=50):
    first = {}
    for d, text, *_ in sorted(rows, key=lambda r: sid(r[0])):
        w = words(text)
        for q in range(len(w) - window + 1):
            first.setdefault(tuple(w[q : q + window]), sid(d))
    out = []
    for d, text, *_ in rows:
        w = words(text)
        gone = [False] * len(w)
        for q in range(len(w) - window + 1):
            if first[tuple(w[q : q + window])] < sid(d):
                gone[q : q + window] = [True] * window
        out.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


def ordered(found):
    return sorted(map(tuple, found), key=str)


def test_substring_dedup(docs, rows, clashing):
    want = ordered(remove_repeats(rows))
    assert sum(r[2] for r in want) > 300
    assert ordered(substring.remove_repeats(docs).collect()) == want
    assert ordered(substring.remove_repeats(clashing).collect()) == want


@pytest.mark.parametrize("window,seed", [(5, 2), (8, 8), (20, 3)])
def test_substring_dedup_other_windows(docs, rows, window, seed):
    assert ordered(substring.remove_repeats(docs, window, seed).collect()) == ordered(remove_repeats(rows, window))


def test_words_are_told_apart():
    """Words whose bytes give equal sums under any odd base modulo 2**64, and words that differ only past eight bytes."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    pairs = [(one, other), (one[:64], other[:64]), ("abcdefgh" * 2, "abcdefgh" * 3), ("abcdefgh1", "abcdefgh2"), ("a", "a\0"), ("é" * 64, "é" * 63 + "è")]
    for a, b in pairs:
        h = Words([a.encode(), f"{a} {b}\n{a}".encode()], 2).hashes
        for x in h:
            assert x[0] == x[1] == x[3] != x[2]


def test_substring_dedup_survives_look_alike_words(spark):
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    w = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join([*w[:30], one, *w[30:]])), (2, " ".join([*w[:30], other, *w[30:]])), (3, " ".join([*w[:30], other, *w[30:]]))]
    got = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered(substring.remove_repeats(got).collect()) == ordered(remove_repeats([(*r, None, None, None) for r in rows]))


def test_colliding_hashes_are_found_and_hashed_anew(spark, docs, rows, monkeypatch):
    """All windows share their hash at first: no span passes the comparison of words, and the next hashes are taken."""
    plain = substring._edges

    def blind(window, salt):
        work = plain(window, salt)

        def same(batches):
            for b in work(batches):
                yield b if salt else b.set_column(4, "edge", pa.array(np.zeros(len(b), np.int64)))

        return same

    monkeypatch.setattr(substring, "_edges", blind)
    assert ordered(substring.remove_repeats(docs).collect()) == ordered(remove_repeats(rows))


def test_paths_compact_and_name_their_source(spark):
    rng = random.Random(9)
    text = [f"t{rng.randrange(9999)}" for _ in range(700)]
    rows = [(1, " ".join(text[:400])), (2, " ".join(["x", *text[:400], "y"])), (3, " ".join(text[100:300])), (4, " ".join(text[350:700])), (5, " ".join(text[350:700]))]
    spans = substring.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    mine = {d: sorted((s.first, s.end, s.source, s.there) for s in spans if s.id == d) for d in range(1, 6)}
    assert mine[1] == [] and min(s[0] for s in mine[2]) == 1 and max(s[1] for s in mine[2]) == 401 and all(s[2] == 1 and s[3] == s[0] - 1 for s in mine[2])
    assert min(s[0] for s in mine[3]) == 0 and max(s[1] for s in mine[3]) == 200 and all(s[2] == 1 and s[3] == s[0] + 100 for s in mine[3])
    assert {s[2] for s in mine[4]} == {1} and {s[2] for s in mine[5]} == {1, 4}
    assert len(spans) <= 12, "long passages are few spans, not one a window"


@pytest.mark.parametrize("run", [substring.remove_repeats, simhash.near_duplicates, quality.judge, packing.pack, mixing.apportion, pii.find, ctw.score])
def test_very_long_texts(spark, run):
    rng = random.Random(10)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(120_000)) + " " + "z" * 60_000
    df = spark.createDataFrame([(1, long, "en", "a", len(long)), (2, long + " end", "en", "a", len(long) + 4), (3, "short one", "en", "a", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    got = run(df).collect()
    assert {r.doc_id for r in got} == {1, 2, 3}
    if run is substring.remove_repeats:
        assert {r.doc_id: (r.n_words, r.n_removed) for r in got} == {1: (120_001, 0), 2: (120_002, 120_001), 3: (2, 0)}


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


@pytest.mark.parametrize("tile,radius", [(2048, 4), (4, 4), (3, 14)])
def test_simhash(docs, rows, tile, radius):
    prints = [fingerprint(r[1]) for r in rows]
    part = components(prints, radius)
    least = {p: min((sid(r[0]) for r, q in zip(rows, part, strict=True) if q == p)) for p in part}
    want = ordered((r[0], f - (f >> 63 << 64), None if least[p] == LAST else least[p]) for r, f, p in zip(rows, prints, part, strict=True))
    assert ordered(simhash.near_duplicates(docs, radius, tile).collect()) == want


def test_rows_are_told_apart_by_all_their_columns(spark):
    rng = random.Random(1)
    texts = [" ".join(f"u{rng.random()}" for _ in range(40)) for _ in range(6)]
    unlike = spark.createDataFrame([(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[4]), (8, texts[4]), (9, texts[5])], "doc_id long, text string")
    assert sorted(r.text for r in resemblance.keep_one(unlike).collect()) == sorted(texts), "null and repeated doc_ids of unlike texts all stay, equal rows once"
    assert unlike.select(simhash.row_key(unlike).alias("k")).distinct().count() == 6


def alike_components(rows):
    sets = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {"no words"})
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(rows))]


def one_of_each(kept, rows, part):
    least = {p: min(sid(r[0]) for r, q in zip(rows, part, strict=True) if q == p) for p in part}
    assert ordered((r[0],) for r in kept) == ordered((None if d == LAST else d,) for d in least.values())
    by_text = {(r[0], r[1]): p for r, p in zip(rows, part, strict=True)}
    assert {by_text[r[0], r[1]] for r in kept} == set(part)


@pytest.mark.parametrize("tile", [2048, 2])
def test_near_dedup_against_brute_force(spark, rows, tile):
    """Chains of texts a few words apart: most links of 0.8 are far beyond four bits of a fingerprint."""
    rng = random.Random(5)
    more = []
    for g in range(40):
        w = [f"t{rng.randrange(500)}" for _ in range(rng.randint(40, 200))]
        for k in range(5):
            more.append((1000 + 10 * g + k, " ".join(w), "en", "a", 0))
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(9999)}"
    both = rows + more
    part = alike_components(both)
    assert 10 < len(more) - len(set(part[len(rows) :])) < 150
    found = spark.createDataFrame(both, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = resemblance.keep_one(found, tile=tile).collect()
    one_of_each(kept, both, part)
    assert len(corpus_pipeline.near_dedup(spark, found, "").collect()) == len(kept)


def test_near_dedup_columns(clashing, no_docs):
    assert resemblance.keep_one(clashing).columns == clashing.columns
    assert resemblance.keep_one(no_docs).collect() == []


def measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    marked = {k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def test_quality_measures(docs, rows):
    got = quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    want = []
    for r in rows:
        m = measures(r[1])
        want.append((r[0], *m, m[0] < 20 or 100 * m[4] > 30 * m[0]))
    assert ordered(g[:-1] for g in got) == ordered(want)
    assert not any(g["base_failed"] and g["kept"] for g in got)


def test_quality_sketch_is_order_free_and_adapts(spark):
    clean = [(i, " ".join(f"v{(i * 7 + k) % 97}" for k in range(60)), "en", "a", 0) for i in range(80)]
    bad = [(1000 + i, " ".join(f"v{k}%%%" for k in range(60)), "en", "a", 0) for i in range(9)]
    noisy = [(2000 + i, " ".join(f"v{k}%%%" for k in range(60)), "en", "symbols", 0) for i in range(80)]
    df = spark.createDataFrame(clean + bad + noisy, "doc_id long, text string, lang string, source string, n_chars long")
    one, two = ({r.doc_id: r.kept for r in quality.judge(d).collect()} for d in (df, df.repartition(7)))
    assert one == two
    assert all(one[r[0]] for r in clean) and not any(one[r[0]] for r in bad)
    assert all(one[r[0]] for r in noisy), "where symbols are the rule, the fence follows"


def bucket(v):
    return v - v % (1 << max(0, v.bit_length() - 5))


def judged_by_hand(rows, prior=25.0):
    """Sketches as counters, shrunk level by level, over the documents that pass the base rules."""
    more = []
    for d, text, lang, source, _ in rows:
        n_words, chars, symbols, dup, repeats = measures(text)
        w, lines = (text or "").encode().split(), [x for x in (text or "").split("\n") if x.strip(" \t\v\f\r")]
        capitals, stutters = sum(c.isupper() for c in text or ""), sum(a == b for a, b in zip(w, w[1:], strict=False))
        parts = {"symbol": (symbols, chars, 0.8), "capital": (capitals, chars, 0.98), "line": (dup, len(lines), 0.98), "stutter": (stutters, n_words, 0.9), "repeat": (repeats, n_words, 0.99)}
        more.append((d, lang, source, n_words < 20 or 100 * repeats > 30 * n_words, parts))
    good = [m for m in more if not m[3]]

    def sketch(some, metric):
        return Counter(bucket(1000 * m[4][metric][0] // max(1, m[4][metric][1])) for m in some)

    def shrink(own, parent):
        total = sum(parent.values())
        return Counter({b: own[b] + prior * n / total for b, n in parent.items()})

    def at(counts, q):
        upto, total = 0.0, sum(counts.values())
        for b in sorted(counts):
            upto += counts[b]
            if upto >= total * q - 1e-9:
                return b

    out = []
    for d, lang, source, failed, parts in more:
        kept = not failed
        for metric, (n, whole, trusted) in parts.items():
            alike = [m for m in good if m[1] == lang]
            own = [m for m in alike if m[2] == source]
            if own:
                counts = shrink(sketch(own, metric), shrink(sketch(alike, metric), sketch(good, metric)))
                top, tail = at(counts, trusted), at(counts, 0.98)
                expected = (top + (1 << max(0, top.bit_length() - 5)) + top - at(counts, 0.5) + 0.1 * (max(tail, top) - top)) * whole / 1000
                kept &= n <= expected + 3 * math.sqrt(expected + 1)
        out.append((d, failed, kept))
    return out


def test_quality_against_brute_force(spark, docs, rows):
    rng = random.Random(8)
    more = []
    for i in range(300):
        lang, source = rng.choice(["en", "de"]), rng.choice(["a", "b", "c", "d"])
        w = [rng.choice(["Alpha", "beta", "GAMMA", "x#", "y", "tail\n"]) if rng.random() < {"a": 0.02, "b": 0.3}.get(source, 0.1) else f"v{rng.randrange(500)}" for _ in range(rng.randint(15, 90))]
        more.append((1000 + i, " ".join(w) + (" #$%" * 30 if rng.random() < 0.06 else ""), lang, source, 0))
    both = rows + more
    got = quality.judge(spark.createDataFrame(both, docs.schema).repartition(3)).select("doc_id", "base_failed", "kept").collect()
    want = judged_by_hand(both)
    assert 5 < sum(not k and not f for _, f, k in want) < 200
    assert ordered(map(tuple, got)) == ordered(want)
    limits = quality.fences(quality.measures(spark.createDataFrame(both, docs.schema))).where("metric = 'capital_ratio'").select("fence").distinct().count()
    assert limits > 2, "thresholds differ between groups"


def test_quality_counts_follow_the_length(spark, docs):
    plain = [(i, " ".join(f"w{i * 200 + k}" for k in range(150)), "en", "a", 0) for i in range(60)]
    junk = [(100 + i, " ".join(f"x{i * 90 + k}#|" for k in range(60)), "en", "ab"[i % 2], 0) for i in range(6)]
    long = [(200, " ".join(f"y{k}" for k in range(3000)) + " & & & &", "en", "a", 0), (201, " ".join(f"z{k}" for k in range(25)) + " #### |||| &&&&", "en", "a", 0)]
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(plain + junk + long, docs.schema)).collect()}
    assert kept[200] and not kept[201] and all(kept[i] for i in range(60)) and not any(kept[100 + i] for i in range(6))


def test_quality_keep_good(docs, clashing):
    kept = quality.keep_good(clashing)
    assert kept.columns == clashing.columns
    assert ordered((r.doc_id, r.text) for r in kept.collect()) == ordered((r.doc_id, r.kept_text) for r in quality.judge(docs, keep=("text",)).where("kept").collect())


@lru_cache
def plain_library(name):
    """The library's object as the file gives it, apart from the one in the encoder."""
    return Tokenizer.from_file(tokens.vocabulary(name))


def library_ids(name, text):
    return plain_library(name).encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library(rows):
    extra = ["", " ", "\n", " a", "a ", "  a  b ", "a\n\n b", "x\ty  z", "ÀÉ é ", "don't we'll 12345", "<|endoftext|> hi", "a <|endoftext|> b", "x<|startoftext|>y", "<|ENDOFTEXT|>", "KK İ x .. ", ".a ,b c.,.", "가 ½ a b", "\x1c a", "a" * 5000]
    for name, blanks in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        encoder = tokens.Encoder(tokens.vocabulary(name), blanks)
        for text in [r[1] or "" for r in rows] + extra:
            assert encoder.encode(text).tolist() == library_ids(name, text), text[:40]


def test_encoder_survives_a_full_table(monkeypatch, rows):
    monkeypatch.setattr(tokens, "KEPT_WORDS", 50)
    encoder = tokens.Encoder(tokens.vocabulary("word_bpe_49k.json"), False)
    for r in rows * 3:
        assert encoder.encode(r[1] or "").tolist() == library_ids("word_bpe_49k.json", r[1])
        assert len(encoder.place) <= 50 + 1000


def test_encoder_of_many_texts(monkeypatch, rows):
    monkeypatch.setattr(tokens, "CHUNK", 700)
    signs = ["", ".", ",", "$$$", "!?", "'", "'s", ".'s", "\u20ac.", "\u0301.", "...\u0338"]
    heads = ["alpha", "Stra\u00dfe", "\u00e9lan", "\u65e5\u672c", "x1", "7", "'", "", "\u0130", "\u0958", "\ufb1d", "e\u0301", "\u1100\u1161"]
    mixed = [f"{h}{s}{b}{h}{s}{e}" for h in heads for s in signs for b in (" ", "\n", "  ", "\n ", " \n") for e in ("", " ", "\n")]
    texts = [r[1] or "" for r in rows] + mixed + ["\t a", "a\x1cb c", "a <|endoftext|>."]
    for name, blanks in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        got = tokens.Encoder(tokens.vocabulary(name), blanks).encode_all(texts)
        assert [(t, g.tolist()) for t, g in zip(texts, got, strict=True)] == [(t, library_ids(name, t)) for t in texts]


def test_encoder_keeps_letters_apart_from_signs():
    letters, signs = [a + b for a in "bcdfg" for b in "aeiou"], [".", ",", "$$$", "%%%", "!!", "&&", ";"]
    encoder = tokens.Encoder(tokens.vocabulary("word_bpe_49k.json"), False)
    encoder.encode(" ".join(x + y for x in letters for y in signs))
    assert len(encoder.place) == len(letters) + len(signs), "not one entry a pair"


def test_slices_by_size():
    batch = pa.record_batch({"doc_id": list(range(7)), "text": ["a" * 40, None, "b" * 70, "c" * 500, "", "d" * 30, "\u00e9" * 30]})
    got = [b.column("doc_id").to_pylist() for b in words_module.sized(iter([batch, batch.slice(2, 0), batch.slice(5)]), 100)]
    assert got == [[0, 1], [2], [3], [4, 5, 6], [5, 6]]


@pytest.fixture
def asked(monkeypatch):
    """How many texts went to the encoder at each call."""
    calls, whole = [], tokens.Encoder.encode_all
    monkeypatch.setattr(tokens.Encoder, "encode_all", lambda self, texts: calls.append(len(texts)) or whole(self, texts))
    return calls


MANY = pa.record_batch({"doc_id": list(range(2000)), "text": [f"same words, number {i % 7}." for i in range(2000)]})


def test_packing_encodes_many_texts_at_once(monkeypatch, asked):
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    cut = packing._cut(packing.default_tokenizer(), False, 1, 2048, 2)
    rows = [r for b in cut(iter([MANY])) for r in b.to_pylist()]
    assert asked == [2000]
    assert [np.frombuffer(r["ids"], "<u2").tolist() for r in rows] == [[*library_ids("word_bpe_49k.json", t), 1] for t in MANY.column("text").to_pylist()]


def test_shards_encode_many_texts_at_once(asked):
    content = b"".join(r + b"\n" for b in sstable._records(sstable.default_tokenizer(), 0, 2)(iter([MANY])) for r in b.column("record").to_pylist())
    assert asked == [2000]
    want = [(i, [*library_ids("byte_bpe_50k.json", t), 0]) for i, t in enumerate(MANY.column("text").to_pylist())]
    assert [(d, ids.tolist()) for d, ids in sstable.Shard.of(content).scan()] == want


def text_mark(text):
    """The order of rows with one doc_id: Spark's xxhash64, where null gives the seed."""
    h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (h >> 63 << 64)


@pytest.mark.parametrize("shard_bytes", [1 << 26, 3000])
def test_token_shards(spark, docs, rows, shard_bytes):
    path = sstable.shard_path(spark)
    sstable.write_shards(docs, path, sstable.default_tokenizer(), shard_bytes=shard_bytes)
    at, want = 0, []
    for d, text, *_ in sorted(rows, key=lambda r: (sid(r[0]), text_mark(r[1]))):
        ids = [*library_ids("byte_bpe_50k.json", text), 0]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert ordered(sstable.read_digests(spark, path).collect()) == ordered(want)
    found = sstable.lookup(spark, path, [7, 133, 99999, -5, 139, None]).collect()
    assert Counter(r.doc_id for r in found) == {7: 1, 133: 1, 139: 3, None: 2}
    assert {tuple(r.ids) for r in found if r.doc_id == 133} == {(*library_ids("byte_bpe_50k.json", "one"), 0)}


def test_wide_ids_keep_their_value(spark, docs, rows):
    path = sstable.shard_path(spark)
    sstable.write_shards(docs, path, sstable.default_tokenizer(), end=70_000, width=4)
    assert sstable.lookup(spark, path, [133]).first().ids == [*library_ids("byte_bpe_50k.json", "one"), 70_000]
    assert tokens.id_bytes(sstable.default_tokenizer()) == 2


def test_shard_blocks_and_bloom():
    writer, blocks = sstable.ShardWriter(2), []
    ids = {k: np.arange(k % 300, dtype=np.uint32) for k in range(0, 4000, 2)}
    for k, v in ids.items():
        blocks.append(writer.add(sstable.key_of(k - 2000), v))
    content = b"".join(b + b"\n" for b in [*filter(None, blocks), *writer.finish()])
    asked = []
    shard = sstable.Shard(lambda at, size: asked.append(size) or content[at : at + size], len(content))
    assert len(shard.blocks()[0]) > 5 and shard.documents == len(ids) and (shard.first, shard.last) == (sstable.key_of(-2000), sstable.key_of(1998))
    assert [d for d, _ in shard.scan()] == [k - 2000 for k in ids]
    assert all(np.array_equal(shard.get(k - 2000)[0], v) for k, v in ids.items())
    assert not any(shard.get(k - 1999) for k in ids)
    asked.clear()
    shard.get(0)
    assert sum(asked) < len(content) / 3, "a lookup reads ranges, not the shard"


def test_packing(docs, rows):
    got = packing.pack(docs).collect()
    want = Counter((r[0], tuple([*library_ids("word_bpe_49k.json", r[1]), 1])) for r in rows)
    by_doc, by_sequence = {}, {}
    for p in got:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, ids))
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    if True:
        single = {k: v for k, v in by_doc.items() if len([1 for d, i in want.elements() if (d, len(i)) == k]) == 1}
        for (d, n), parts in single.items():
            whole = [i for _, ids in sorted(parts) for i in ids]
            assert want[(d, tuple(whole))] == 1 and len(whole) == n
    assert sum(p.length for p in got) == sum(len(i) for _, i in want.elements())
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0


def test_packing_plan_places_everything_once():
    rng = np.random.default_rng(1)
    histogram = np.zeros(2048, np.int64)
    np.add.at(histogram, np.minimum(2047, 1 + rng.exponential(400, 60_000).astype(int)), 1)
    plan = packing.Plan(histogram)
    assert plan.combined > 1000, "the solver finds combinations"
    filled = Counter()
    for length in np.flatnonzero(histogram):
        for rank in range(0, histogram[length]):
            pieces = plan.place(int(length), rank)
            assert sum(n for _, n, *_ in pieces) == length
            for _, n, sequence, _ in pieces:
                filled[sequence] += n
    assert max(filled.values()) == 2048
    assert sum(1 for v in filled.values() if v & (v - 1)) == 0


def mixed_targets(sizes):
    names = sorted({s for s in sizes if s is not None}, key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(capped.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s] + 1e-9]
        if not over:
            return {**capped, **{s: level * weight[s] for s in free}}
        capped.update({s: 2.0 * sizes[s] for s in over})


def highest_quotients(votes, most, blocks):
    """Sainte-Laguë by definition: one block at a time to the highest votes / (2 k + 1); ties by key."""
    won = Counter()
    for _ in range(blocks):
        best = max((k for k in votes if won[k] < most[k]), key=lambda k: (votes[k] / (2 * won[k] + 1), *(-x for x in k)))
        won[best] += 1
    return won


def test_sainte_lague_by_definition(spark):
    rng = random.Random(4)
    for blocks in (0, 1, 2, 17, 300):
        parties = {(s, h): rng.choice([0.5, 3.0, 3.0, 3.0, 40.0, rng.uniform(1, 900)]) for s in range(5) for h in range(4)}
        most = {k: rng.choice([1, 40, 1000]) for k in parties}
        if blocks == 300:
            most = dict.fromkeys(parties, 1000)
        df = spark.createDataFrame([(s, h, v, most[s, h]) for (s, h), v in parties.items()], "source long, shard long, votes double, most long")
        got = {(r.source, r.shard): r.quota for r in mixing.sainte_lague(df, blocks).collect()}
        assert got == {k: highest_quotients(parties, most, blocks)[k] for k in parties}


@pytest.mark.parametrize("shard_words", [mixing.SHARD_WORDS, 900])
def test_mixing(docs, rows, shard_words):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    targets = mixed_targets(sizes)
    got = mixing.apportion(docs, shard_words=shard_words).collect()
    again = mixing.apportion(docs.repartition(5), shard_words=shard_words).collect()
    assert ordered((g.doc_id, g["size"], g.taken) for g in got) == ordered((g.doc_id, g["size"], g.taken) for g in again)
    shards, quota, taken = Counter(), {}, Counter()
    for g in got:
        assert 0 <= g.taken <= 2 * g["size"] and math.isclose(g.target, targets[g.source]) and g.source_size == sizes[g.source]
        taken[g.source] += g.taken
        shards[g.source, g.shard] += g["size"]
        quota[g.source, g.shard] = g.quota
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    votes = {(names.index(s), h): targets[s] * n / sizes[s] for (s, h), n in shards.items() if n}
    most = {(names.index(s), h): 2 * -(-n // 16) for (s, h), n in shards.items() if n}
    want = highest_quotients(votes, most, math.floor(sum(votes.values()) / 16 + 0.5))
    assert {(names.index(s), h): q for (s, h), q in quota.items() if q} == {k: q for k, q in want.items() if q}
    assert all(abs(taken[s] - targets[s]) <= 24 * sum(1 for k in shards if k[0] == s) for s in targets)


def test_mixed_documents_match_the_plan(docs):
    plan = Counter()
    for g in mixing.apportion(docs).collect():
        plan[g.doc_id] += g.taken
    got = Counter()
    for r in mixing.mix(docs).collect():
        got[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text)
    assert {k: v for k, v in plan.items() if v} == dict(got)


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_spans(text):
    def ok(kind, s):
        digits = re.sub(r"[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1]))
            return 12 <= len(digits) <= 19 and total % 10 == 0
        return kind != "phone" or 9 <= len(digits) <= 15

    found = [(m.start(), i, k, m.end()) for i, (k, p) in enumerate(BASE) for m in re.finditer(p, text or "") if ok(k, m[0])]
    return [(k, s, e) for s, _, k, e in sorted(found)]


@pytest.mark.parametrize("text", ["a@b.c d@e", "x.y+z@m-1.example.com.", "@@a@b.co@c.de", "1.2.3.4.5 300.1.1.1 0001.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (017) 555-7713 +12 +1-2-3", "9" * 40 + " ñ 1.1.1.1", "a.b@c..d@e.f", None, ""])
def test_exact_spans(text):
    assert pii.exact_spans(text or "") == base_spans(text)


def test_pii_bootstraps_contexts(spark):
    rows = [(i, f"some text w{i} write to user{i}@mail.example.org now") for i in range(6)]
    rows += [(10 + i, f"my card number is {n} thanks") for i, n in enumerate(("4111111111111111", "5500005555555559", "340000000000009", "30000000000004"))]
    rows += [(20, "my card number is 9807915762804490 thanks"), (21, "the year 2024-01-01 was w12345 fine"), (22, None), (23, ""), (20, "my card number is 9807915762804490 thanks")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.find(df).select("doc_id", "spans", "found").collect()
    found = [(r.doc_id, s.start, s.end) for r in got for s in r.found]
    assert found == [(20, 18, 34)] * 2, "the failed number stands where cards stand"
    assert all([(s.kind, s.start, s.end) for s in r.spans] in [base_spans(t) for d, t in rows if d == r.doc_id] for r in got)
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[20] == "my card number is [FOUND] thanks" and clean[0] == "some text w0 write to [EMAIL] now" and clean[22] is None


def test_pii_secrets_and_leads(spark):
    rows = [(i, f"w{i} login pin=AKIA{'ABCDEFGH'[i]}{'Q' * 13}7{i} and more") for i in range(5)] + [(10, "w login pin=ZZZZABCDEFGHIJKLMN42 and more")]
    rows += [(20 + i, f'the token = "0641917ea4e9feb{i}" x') for i in range(4)] + [(30, "loose 1641917ea4e9feb9 here"), (31, "password=b7db7aa4a5 y"), (32, "password=short tokens are fine"), (33, "a" * 200 + " " + "b" * 200 + "1")]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.found] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == [("found", 13, 33)] and got[20] == [("found", 13, 29)] and got[32] == got[33] == []
    assert got[10] == [("found", 12, 32)], "an unseen identifier behind a learned lead"
    assert got[30] == [("found", 6, 22)], "an unseen identifier of a learned form"
    assert got[31] == [], "a seed that no scored pattern carries is no span"
    long = "x" * 90
    assert pii.patterns(f"{long}1 {long}2 1a1", 184, 187) != pii.patterns(f"{long}1 {long}3b 1a1", 185, 188), "contexts are whole"
    assert [pii.assigned_to(t, t.index("9")) for t in ('api_key : "9', "a.key='9", "=9", "x = \n9", "k:v=9")] == ["api_key:", "key=", "", "", "v="]


def found_by_hand(texts):
    """The whole result of the method on the distinct texts, with sets and plain loops."""
    links, seeds = {}, set()
    for t in texts:
        spans = pii.exact_spans(t)
        for _, _, pattern, instance, seed, _ in pii.occurrences(t, spans, pii.secret_spans(t, spans)):
            links.setdefault(pattern, set()).add(instance)
            if seed:
                seeds.add(instance)
    score = {i: float(i in seeds) for some in links.values() for i in some}
    for _ in range(3):
        rated = {p: math.fsum(score[i] for i in some) / len(some) for p, some in links.items() if len(some) >= 3}
        good = {p: s for p, s in rated.items() if s >= 0.6}
        doubt = dict.fromkeys(score, 1.0)
        for p, s in good.items():
            for i in links[p]:
                doubt[i] *= 1 - s
        score = {i: max(float(i in seeds), 1 - doubt[i]) for i in score}
    out = {}
    for t in texts:
        spans = pii.exact_spans(t)
        places = {("found", s, e) for s, e, p, _, _, exact in pii.occurrences(t, spans, pii.secret_spans(t, spans)) if not exact and good.get(p, 0) >= 0.8}
        out[t] = sorted([*spans, *places], key=lambda s: (s[1], pii.KINDS.index(s[0]), s[2]))
    return out


def test_pii_whole_result_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(5000 + i, f'deploy with token = "{i:020x}a9" and key AKIA{"QRSTUVWXYZ"[i]}{"7" * 15} or {i:020x}b1 alone') for i in range(10)] + [(6000, None), (6001, "")]
    got = pii.find(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).select("doc_id", pii.joined(F.concat("spans", "found")).alias("spans")).collect()
    want = found_by_hand([t or "" for _, t in docs])
    assert {r.doc_id: r.spans for r in got} == {d: ",".join(":".join(map(str, s)) for s in want[t or ""]) for d, t in docs}
    assert sum("found" in r.spans for r in got) >= 10


def test_context_tree_scores(docs, rows):
    train = Counter()
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0
    toks = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    for r in rows:
        if not held(r[0]):
            train.update(toks(r[1]))
    n, v = sum(train.values()), len(train)
    want = ordered((r[0], held(r[0]), len(toks(r[1])), sum(train[t] > 0 for t in toks(r[1])), n, round(sum(math.log10((train[t] + 0.1) / (n + 0.1 * (v + 1))) for t in toks(r[1])), 6)) for r in rows)
    for head in (1 << 18, 10):
        got = ctw.score(docs, head=head).collect()
        assert ordered((g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 6)) for g in got) == want


def code_lengths_by_recursion(rows, depth):
    """Log10 of each text's chance by the recursion of the definition, one node at a time."""
    line = lambda t: b"\n" * depth + b" ".join((t or "").encode().lower().split()) + b"\n"
    counts, deeper = Counter(), {}
    for d, text in rows:
        if zlib.crc32(b"" if d is None else str(d).encode()) % 10:
            x = line(text)
            for i in range(depth, len(x)):
                for k in range(8):
                    node = 1 << k | x[i] >> (8 - k)
                    for c in range(depth + 1):
                        counts[x[i - c : i], node, x[i] >> (7 - k) & 1] += 1
                        if c:
                            deeper.setdefault((x[i - c + 1 : i], node), set()).add(x[i - c : i])

    def estimate(context, node):
        a, b = counts[context, node, 0], counts[context, node, 1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @lru_cache(None)
    def weighted(context, node):
        own = estimate(context, node)
        if len(context) == depth:
            return own
        below = sum(weighted(k, node) for k in deeper[context, node])
        return max(own, below) + math.log1p(math.exp(-abs(own - below))) - math.log(2)

    def chance(context, size, node, bit):
        near = context[depth - size :]
        a, b = counts[near, node, 0], counts[near, node, 1]
        if a + b == 0:
            return None
        own, below = ((b if bit else a) + 0.5) / (a + b + 1), chance(context, size + 1, node, bit) if size < depth else None
        w = 1.0 if below is None else math.exp(estimate(near, node) - math.log(2) - weighted(near, node))
        return w * own + (1 - w) * (below or 0.0)

    out = []
    for d, text in rows:
        x = line(text)
        bits = [chance(x[i - depth : i], 0, 1 << k | x[i] >> (8 - k), x[i] >> (7 - k) & 1) for i in range(depth, len(x)) for k in range(8)]
        out.append((d, sum(math.log10(0.5 if p is None else p) for p in bits)))
    return out


@pytest.mark.parametrize("depth,cut,head", [(5, 3, 1 << 19), (5, 3, 40), (3, 3, 0), (4, 1, 100), (2, 2, 5)])
def test_context_tree_against_recursion(spark, monkeypatch, depth, cut, head):
    monkeypatch.setattr(ctw, "STEP", 50)
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the", "Cat", "sat", "ñandú", "日本", "a", "on"]) for _ in range(rng.randint(0, 30)))) for i in range(50)] + [(None, None), (7, "x" * 300), (7, "x" * 300), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ordered((r.doc_id, r.score) for r in ctw.score(df, depth=depth, cut=cut, head=head).collect())
    want = ordered(code_lengths_by_recursion(rows, depth))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert max(abs(g[1] - w[1]) for g, w in zip(got, want, strict=True)) < 1e-4


def test_context_tree_is_a_distribution(spark):
    text = ("the cat sat on the mat\n" * 20).encode()
    keys, counts = np.unique(ctw._strings([text], 3)[0], return_counts=True)
    every = [int.from_bytes(c, "big") << 8 | b for c in (b"the", b"zzz", b"\n\n\n", b" ca") for b in range(256)]
    rows = [(int(k), int(n)) for k, n in zip(keys, counts, strict=True)] + [(k, 0) for k in every]
    df = spark.createDataFrame(rows, "key long, n long").groupBy("key").sum("n").withColumnRenamed("sum(n)", "n")
    logs = {r.key: r.log for r in ctw.code_lengths(df, depth=3).collect()}
    for at in range(0, len(every), 256):
        assert math.isclose(sum(10 ** logs[k] for k in every[at : at + 256]), 1, rel_tol=1e-5)
    assert np.allclose(ctw.kt_log(np.array([0.0, 2, 1]), np.array([0.0, 0, 1])), np.log([1, 3 / 8, 1 / 8]))


def test_held_out_beats_the_unigram_base(spark):
    import duckdb

    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    got = ctw.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").groupBy().sum("score", "base_score").first()
    assert got[0] > got[1]


@pytest.mark.parametrize("run", [substring.remove_repeats, simhash.near_duplicates, resemblance.keep_one, quality.judge, quality.keep_good, packing.pack, mixing.apportion, mixing.mix, pii.find, pii.redact, ctw.score])
def test_empty_tables(no_docs, run):
    assert run(no_docs).collect() == []


def test_empty_shards(spark, no_docs):
    path = sstable.shard_path(spark)
    sstable.write_shards(no_docs, path, sstable.default_tokenizer())
    assert sstable.read_digests(spark, path).collect() == []


@pytest.mark.parametrize("run", [quality.judge, packing.pack, mixing.apportion, mixing.mix, pii.find, pii.redact, ctw.score, simhash.near_duplicates])
def test_clashing_columns_and_repeated_rows(docs, clashing, run):
    assert run(clashing).count() == run(docs).count()


def test_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
