"""Phrase collocations from a weighted De Bruijn graph of words, exact, per language.

A word of a language is the 64-bit hash ``x`` of both.  Nodes are two words that stand together in a piece, edges three.

1. Edges: every word begins one edge ``(x1, x2, x3)``; where its piece ends early, the missing words are 0.  Edges are counted
   in each task and then over the corpus.  They are dealt by their first node; nodes that a bounded sample shows to be hot are
   dealt by ``x3`` as well, which changes no result.
2. Flow: the edges out of a node, with those that end there, are its count; the nodes out of a word, with the words that end
   a piece, are the word's.  So all counts of one and two words come from the edges, and only counts of ``least`` and more leave.
3. Compaction: a node is unary when one edge brings all of its count and one takes all of it.  Edges that meet in a unary
   node are linked, and linked edges become one path by pointer doubling; its inner nodes have the path's weight.  There are
   no cycles: a piece that ran into one would have begun in one of its nodes, which then has no sole edge in.
4. Candidates: the nodes, and the edges read off the paths; two words inside a frequent enough edge are dropped.
5. Names: words are looked up by hash among the distinct words of the corpus.  Should two words of any candidate ever share a
   hash, all is done again with other hashes, so that no result rests on a hash.

Products are decimals of 38 digits: a count may have 15 digits.

Defined cases: null text is empty and a null language is ``und``; a text without words adds nothing; repeated rows count each;
phrases that tie in score and count follow in the byte order of UTF-8; a very long text is hashed in one piece, by one task;
null doc_ids are rows like any other; an empty table gives an empty result; columns other than text and lang are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.words import Words, mixed, raw, slices
from ledgerline.plans.scratch import materialize, release

LEAST = 10
TOP = 2000
#: A phrase goes if a longer one around it has this many hundredths of its count.
SHARE = 50
CHUNK = 8_000_000
SAMPLE = 20_000
MOST_HOT = 4096
WAYS = 64
#: Edges in one row of a path.
STRETCH = 4096
TRIES = 5
#: A-Z in lower case, signs that end a piece as line ends.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?" or 10 <= b <= 13 else b for b in range(256))
_SALTS = (0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list[bytes]]]:
    """Normalised texts by language, ``CHUNK`` bytes and more at a time."""
    held, size = {}, 0
    for batch in slices(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), raw(batch), strict=True):
            held.setdefault("und" if lang is None else lang, []).append(text.translate(_PLAIN))
            size += len(text)
            if size >= CHUNK:
                yield held
                held, size = {}, 0
    yield held


def hashed(lang: str, texts: list[bytes], salt: int = 0, lanes: int = 1) -> tuple[np.ndarray, Words, bytes]:
    """The hash of each word, the words and the text they stand in."""
    data = b"\n".join(texts)
    words = Words([data], 2 if salt else lanes)
    x = words.hashes[0] + words.hashes[1] * np.uint64(_SALTS[salt]) if salt else words.hashes[0]
    x = mixed(x + np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))))
    x[x == 0] = 1
    return x.view(np.int64), words, data


def edges_in(x: np.ndarray, words: Words, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``x1, x2, x3`` and count of the distinct edges of a text, sorted."""
    n = len(x)
    text = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero((text >= 10) & (text <= 13))
    goes_on = np.zeros(n + 1, bool)
    goes_on[: n - 1] = np.searchsorted(ends, words.starts[1:]) == np.searchsorted(ends, words.ends[:-1])
    x2 = np.where(goes_on[:n], np.append(x[1:], 0), 0)
    x3 = np.where(goes_on[:n] & goes_on[1:], np.append(x[2:], [0, 0])[:n], 0)
    order = np.lexsort((x3, x2, x))
    x1, x2, x3 = x[order], x2[order], x3[order]
    new = np.flatnonzero(np.concatenate(([True], (x1[1:] != x1[:-1]) | (x2[1:] != x2[:-1]) | (x3[1:] != x3[:-1]))))
    return x1[new], x2[new], x3[new], np.diff(np.append(new, n))


def _node(x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
    return mixed(x1.view(np.uint64) * np.uint64(3) + x2.view(np.uint64))


def _edges(salt: int, hot: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            for lang, texts in chunk.items():
                x, words, data = hashed(lang, texts, salt)
                if not len(x):
                    continue
                x1, x2, x3, n = edges_in(x, words, data)
                way = np.where(np.isin(_node(x1, x2), hot), (mixed(x3.view(np.uint64)) % np.uint64(WAYS)).astype(np.int32) + 1, 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (x1, x2, x3, way, n.astype(np.int64))], names=["x1", "x2", "x3", "way", "n"])

    return work


def _names(salt: int):
    """Distinct words of each chunk as ``x, name`` (word, line end, language), and ``0, language`` with the number of words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            for lang, texts in chunk.items():
                x, words, data = hashed(lang, texts, salt, 2)
                # words that share x differ in their other hash, so both names are seen
                order = np.lexsort((words.hashes[1], x))
                other = words.hashes[1][order]
                new = np.concatenate(([True], (x[order][1:] != x[order][:-1]) | (other[1:] != other[:-1])))[: len(x)]
                at = order[new]
                found = x[at]
                tail = b"\n" + lang.encode("utf-8", "surrogatepass")
                names = [data[s:e] + tail for s, e in zip(words.starts[at].tolist(), words.ends[at].tolist(), strict=True)]
                columns = [pa.array(np.append(found, 0)), pa.array([*names, tail], pa.binary()), pa.array(np.append(np.zeros(len(found), np.int64), len(x)))]
                yield pa.RecordBatch.from_arrays(columns, names=["x", "name", "n"])

    return work


_EDGE = "x1 long, x2 long, x3 long, way int, n long"


def _hot_nodes(texts: DataFrame, parts: int, salt: int) -> np.ndarray:
    """Nodes of a bounded sample that would fill an eighth of a partition and more; at most ``MOST_HOT``."""
    rows = texts.count()
    some = texts.sample(min(1.0, SAMPLE / rows), seed=7) if rows else texts
    nodes = some.mapInArrow(_edges(salt, np.zeros(0, np.uint64)), _EDGE).groupBy("x1", "x2").agg(F.sum("n").alias("n"))
    nodes = materialize(nodes.where("n >= 8"), "collocation-sample")
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = nodes.where(F.col("n") * 8 * parts >= total).orderBy(F.desc("n")).limit(MOST_HOT).collect()
    release(nodes)
    return _node(*np.array([(r["x1"], r["x2"]) for r in found], np.int64).reshape(-1, 2).T.copy())


def counts(documents: DataFrame, least: int = LEAST, salt: int = 0) -> DataFrame:
    """``x1, x2, x3, c``: words (x2 and x3 are 0), nodes (x3 is 0) and edges that occur ``least`` times and more."""
    texts = documents.select("text", "lang")
    parts = 4 * max(1, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    edges = texts.mapInArrow(_edges(salt, _hot_nodes(texts, parts, salt)), _EDGE)
    counted = edges.repartition(parts, "x1", "x2", "way").groupBy("x1", "x2", "way", "x3").agg(F.sum("n").alias("n"))
    # all edges of a node, or of a hot node's way, are in one partition now: its flow needs no further shuffle
    itself, flow = F.struct("x3", "n"), F.struct(F.lit(0).cast("long").alias("x3"), F.col("n"))
    flows = counted.select("x1", "x2", "way", F.inline(F.when((F.col("n") >= least) & (F.col("x3") != 0), F.array(flow, itself)).otherwise(F.array(flow))))
    nodes = flows.groupBy("x1", "x2", "way", "x3").agg(F.sum("n").alias("n"))
    itself, flow = F.struct("x2", "n"), F.struct(F.lit(0).cast("long").alias("x2"), F.col("n"))
    leaves = (F.col("x2") != 0) & ((F.col("n") >= least) | (F.col("way") > 0))
    both = F.when(F.col("x3") != 0, F.array(itself)).when(leaves, F.array(flow, itself)).otherwise(F.array(flow))
    found = nodes.select("x1", "x3", F.inline(both)).groupBy("x1", "x2", "x3").agg(F.sum("n").alias("c"))
    return materialize(found.where(F.col("c") >= least), "collocation-counts")


def _doubled(edges: DataFrame) -> DataFrame:
    """``id, root, rank`` of every edge; ``edges`` has ``id`` and ``prev``, null where a path begins."""
    now = materialize(edges.where("prev IS NOT NULL").select("id", "prev", F.lit(1).cast("long").alias("rank"), F.lit(True).alias("moved")), "collocation-paths")
    while not now.where("moved").isEmpty():
        far = now.select(F.col("id").alias("prev"), F.col("prev").alias("root"), F.col("rank").alias("more"))
        step = now.join(far, "prev", "left").select("id", F.coalesce("root", "prev").alias("prev"), (F.col("rank") + F.coalesce("more", F.lit(0))).alias("rank"), F.col("root").isNotNull().alias("moved"))
        before, now = now, materialize(step, "collocation-paths")
        release(before)
    heads = edges.where("prev IS NULL").select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("rank"))
    return heads.unionByName(now.select("id", F.col("prev").alias("root"), "rank"))


def paths(counted: DataFrame) -> DataFrame:
    """``words, c``: the compacted graph; ``words`` are the hashes along a stretch of a path, ``c`` is its weight."""
    nodes = counted.where("x2 <> 0 AND x3 = 0").select("x1", "x2", F.col("c").alias("flow"))
    edges = counted.where("x3 <> 0")
    into = edges.select(F.col("x1").alias("x0"), F.col("x2").alias("x1"), F.col("x3").alias("x2"), F.col("c").alias("flow"))
    sole_in = nodes.join(into, ["x1", "x2", "flow"]).select("x1", "x2", "x0", F.col("flow").alias("c"))
    before = F.when(F.col("x0").isNotNull(), F.struct(F.col("x0").alias("x1"), F.col("x1").alias("x2"), F.col("x2").alias("x3")))
    linked = edges.join(sole_in, ["x1", "x2", "c"], "left").select(F.struct("x1", "x2", "x3").alias("id"), before.alias("prev"), "c")
    linked = materialize(linked, "collocation-edges")
    placed = _doubled(linked.select("id", "prev")).join(linked.select("id", "c"), "id")
    placed = placed.groupBy("root", F.expr(f"rank div {STRETCH}").alias("stretch"), "c").agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("along"))
    first = F.element_at("along", 1)["id"]
    return materialize(placed.select(F.concat(F.array(first["x1"], first["x2"]), F.transform("along", lambda e: e["id"]["x3"])).alias("words"), "c"), "collocation-compacted")


def candidates(counted: DataFrame, compacted: DataFrame, share: int = SHARE) -> DataFrame:
    """``x1, x2, x3, a, head, tail``: phrases that stay, with the counts of the first and last two words of those of three."""
    nodes = counted.where("x2 <> 0 AND x3 = 0").select("x1", "x2", F.col("c").alias("a"))
    ends = compacted.withColumn("last", F.size("words") - 2)
    for name, at in (("first", F.lit(0)), ("final", F.col("last"))):
        flow = nodes.select(F.col("x1").alias(f"{name}1"), F.col("x2").alias(f"{name}2"), F.col("a").alias(name))
        ends = ends.withColumn(f"{name}1", F.get("words", at)).withColumn(f"{name}2", F.get("words", at + 1)).join(flow, [f"{name}1", f"{name}2"])
    ends = materialize(ends.select("words", "c", "last", "first", "final"), "collocation-ends")
    at = F.explode(F.sequence(F.lit(0), F.col("last") - 1)).alias("at")
    triples = ends.select("words", "c", "last", "first", "final", at)
    # nodes inside a path have its weight, only its ends were looked up
    triples = triples.select(
        F.get("words", F.col("at")).alias("x1"), F.get("words", F.col("at") + 1).alias("x2"), F.get("words", F.col("at") + 2).alias("x3"), F.col("c").alias("a"),
        F.when(F.col("at") == 0, F.col("first")).otherwise(F.col("c")).alias("head"), F.when(F.col("at") == F.col("last") - 1, F.col("final")).otherwise(F.col("c")).alias("tail"),
    )
    around = ends.select("words", "c", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("at")).groupBy(F.get("words", F.col("at")).alias("x1"), F.get("words", F.col("at") + 1).alias("x2")).agg(F.max("c").alias("longer"))
    kept = nodes.join(around, ["x1", "x2"], "left").where(f"longer IS NULL OR 100 * longer < {share} * a")
    none = F.lit(None).cast("long")
    return triples.unionByName(kept.select("x1", "x2", none.alias("x3"), "a", none.alias("head"), none.alias("tail")))


def _score(a: str, left: str, right: str):
    big = lambda c: f"CAST({c} AS DECIMAL(18,0))"
    return F.expr(f"(CAST(1000000 AS DECIMAL(7,0)) * ({big(a)} * {big(a)})) div ({big(left)} * {big(right)})")


def top_phrases(scored: DataFrame, top: int) -> DataFrame:
    """``rank`` of the first ``top`` rows of each language; salted first, so that no task holds a language."""
    parts = max(1, int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for ways in (parts, round(parts**0.5)):
        if ways > 1:
            few = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase", F.lit(ways)), F.lit(ways))).orderBy(*order)
            scored = scored.withColumn("rank", F.row_number().over(few)).where(F.col("rank") <= top).drop("rank")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def mine(documents: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the collocations of each language."""
    for salt in range(TRIES):
        counted = counts(documents, least, salt)
        found = materialize(candidates(counted, paths(counted), share), "collocation-candidates")
        named = documents.select("text", "lang").mapInArrow(_names(salt), "x long, name binary, n long").groupBy("x", "name").agg(F.sum("n").alias("n"))
        named = materialize(named, "collocation-names")
        known = counted.where("x2 = 0").select(F.col("x1").alias("x"), F.col("c").alias("f")).join(named.where("x <> 0").select("x", "name"), "x")
        known = materialize(known, "collocation-words")
        used = found.select(F.explode(F.array("x1", "x2", "x3")).alias("x")).where("x IS NOT NULL").distinct()
        if known.groupBy("x").agg(F.count("*").alias("names")).where("names > 1").join(used, "x", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError("hashes of different words kept colliding")
    rows = found
    for k in (1, 2, 3):
        rows = rows.join(known.select(F.col("x").alias(f"x{k}"), F.col("f").alias(f"f{k}"), F.col("name").cast("string").alias(f"name{k}")), f"x{k}", "left" if k == 3 else "inner")
    word = lambda k: F.substring_index(F.col(f"name{k}"), "\n", 1)
    lang = F.expr("substring(name1, length(substring_index(name1, '\\n', 1)) + 2)")
    two = F.col("x3").isNull()
    rows = rows.select(
        lang.alias("lang"), F.concat_ws(" ", word(1), word(2), F.when(~two, word(3))).alias("phrase"), "a",
        F.col("f1").alias("l1"), F.when(two, F.col("f2")).otherwise(F.col("tail")).alias("r1"), F.col("head").alias("l2"), F.col("f3").alias("r2"),
    )
    rows = rows.withColumn("s1", _score("a", "l1", "r1")).withColumn("s2", _score("a", "l2", "r2"))
    second = F.coalesce(F.col("s2") < F.col("s1"), F.lit(False))
    pick = lambda one, other: F.when(second, F.col(other)).otherwise(F.col(one))
    rows = rows.select("lang", "phrase", "a", pick("l1", "l2").alias("l"), pick("r1", "r2").alias("r"), pick("s1", "s2").alias("score"))
    sizes = named.where("x = 0").select(F.expr("substring(CAST(name AS STRING), 2)").alias("lang"), "n")
    return top_phrases(rows, top).join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


MINE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
f AS (
  SELECT lang, p, count(*) AS a FROM (
    SELECT lang, w[i] AS p FROM starts
    UNION ALL SELECT lang, w[i] || ' ' || w[i + 1] AS p FROM starts WHERE i + 1 <= len(w)
    UNION ALL SELECT lang, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS p FROM starts WHERE i + 2 <= len(w))
  GROUP BY lang, p HAVING count(*) >= 10),
split AS (SELECT *, string_split(p, ' ') AS w FROM f),
cut AS (
  SELECT lang, p, a, k, array_to_string(w[:k], ' ') AS head, array_to_string(w[k + 1 :], ' ') AS tail FROM (SELECT *, unnest(range(1, len(w))) AS k FROM split WHERE len(w) > 1)),
scored AS (
  SELECT c.lang, c.p, c.a, c.k, l.a AS l, r.a AS r, ((1000000::HUGEINT * c.a * c.a) // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM cut AS c JOIN f AS l ON l.lang = c.lang AND l.p = c.head JOIN f AS r ON r.lang = c.lang AND r.p = c.tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
around AS (
  SELECT lang, p, max(a) AS longer FROM (
    SELECT lang, w[1] || ' ' || w[2] AS p, a FROM split WHERE len(w) = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3] AS p, a FROM split WHERE len(w) = 3)
  GROUP BY lang, p),
kept AS (SELECT best.* FROM best LEFT JOIN around USING (lang, p) WHERE longer IS NULL OR 100 * longer < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM kept)
SELECT lang, rank, p AS phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""
