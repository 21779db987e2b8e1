"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items scans every text once.

Texts and items are normalised alike: A-Z in lower case, all other ASCII but digits and letters is a gap.  The
normalisation keeps each byte in its place, so a word found in it has its offsets in the original text.  A pattern is a
window of ``size`` consecutive words of an item, with a gap at both ends; an item of fewer words is one pattern.

The items are cut into segments that overlap by a window less one word, and the segments are dealt into automata by a
running total of bytes.  As long as their normalised text is below ``AUTOMATON_BYTES`` there is one automaton: its segments
are sent to the workers, and each worker builds it once.  A larger table of items takes one scan for each automaton; the
hits of the scans are joined by two digests of the text.

Defined cases: null text has no words; an item without words matches nothing; a null item_id marks words, but is neither
counted nor listed; rows that share an item_id are one item; repeated documents are judged alike; a window of several items
counts for each; a very long text is scanned whole, by one task that holds it; null doc_ids are rows like any other; an
empty table of documents gives an empty result, an empty table of items no hits; other columns are carried or ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.words import raw, slices
from ledgerline.plans.offsets import running_start
from ledgerline.plans.scratch import materialize

SIZE = 10
#: Normalised text of the items of one automaton; it takes some 300 bytes for each of these.
AUTOMATON_BYTES = 1 << 20
SEGMENT_WORDS = 20_000
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_FOUND = "n_words bigint, n_hit bigint, spans array<struct<start:int,end:int>>, words array<struct<start:int,end:int>>, items array<string>"


def normalised(text: bytes) -> bytes:
    """The text with a blank for every byte that is in no word; as long as the text."""
    return text.translate(_PLAIN)


def windows(words: list[bytes], size: int = SIZE) -> Iterator[bytes]:
    """The windows of an item, each with a gap before and after."""
    for i in range(max(1, len(words) - size + 1) if words else 0):
        yield b" " + b" ".join(words[i : i + size]) + b" "


class Scanner:
    """The automaton over the windows of some items, and the items of each window."""

    def __init__(self, items: list[tuple[str | None, bytes]], size: int = SIZE):
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.items: list[set[str | None]] = []
        self.lengths: list[int] = []
        known: dict[bytes, int] = {}
        for item, text in items:
            words = text.split()
            for window in windows(words, size):
                at = known.setdefault(window, len(known))
                if at == len(self.items):
                    self.items.append(set())
                    self.lengths.append(min(size, len(words)))
                    self.automaton.add_word(window.decode("utf-8", "surrogatepass"), at)
                self.items[at].add(item)
        if known:
            self.automaton.make_automaton()
        self.any = bool(known)

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie in a window, and the items of the windows."""
        hit = np.zeros(len(words) + 1, np.int64)
        if not self.any or not words:
            return hit[:0], set()
        text = (b" " + b" ".join(words) + b" ").decode("utf-8", "surrogatepass")
        found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64)
        if not len(found):
            return hit[:0], set()
        ends, kinds = found[::2], found[1::2]
        gaps = np.cumsum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") == 32)
        after = gaps[ends] - 1
        np.add.at(hit, after - np.array(self.lengths)[kinds], 1)
        np.add.at(hit, after, -1)
        items = set().union(*(self.items[k] for k in np.unique(kinds).tolist()))
        return np.cumsum(hit[:-1]) > 0, items - {None}


def stretches(hit: np.ndarray) -> np.ndarray:
    """First and end of each stretch of true values."""
    edge = np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1)


def offsets(text: bytes, runs: np.ndarray) -> np.ndarray:
    """Runs of words as code points of the original text, end exclusive."""
    plain = np.frombuffer(normalised(text), np.uint8) != 32
    edge = np.diff(np.concatenate(([False], plain, [False])).astype(np.int8))
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return np.stack([chars[np.flatnonzero(edge == 1)[runs[:, 0]]], chars[np.flatnonzero(edge == -1)[runs[:, 1] - 1]]], axis=1)


def _pairs(rows: list[np.ndarray]) -> pa.Array:
    sizes = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    flat = np.concatenate(rows).astype(np.int32) if rows else np.zeros((0, 2), np.int32)
    return pa.ListArray.from_arrays(sizes, pa.StructArray.from_arrays([flat[:, 0], flat[:, 1]], ["start", "end"])).cast(_SPANS)


def _answered(batch: pa.RecordBatch, found: list[tuple[int, np.ndarray, list[str]]]) -> pa.RecordBatch:
    """The batch without its text, with what was found: words, stretches of hit words, items."""
    texts = raw(batch)
    spans = [offsets(t, runs) if len(runs) else runs for t, (_, runs, _) in zip(texts, found, strict=True)]
    rest = [i for i, name in enumerate(batch.schema.names) if name not in ("text", "words", "items")]
    columns = [
        pa.array([n for n, _, _ in found], pa.int64()), pa.array([int((r[:, 1] - r[:, 0]).sum()) for _, r, _ in found], pa.int64()), _pairs(spans), _pairs([r for _, r, _ in found]), pa.array([i for _, _, i in found], pa.list_(pa.string())),
    ]
    return pa.RecordBatch.from_arrays([batch.column(i) for i in rest] + columns, names=[batch.schema.names[i] for i in rest] + ["n_words", "n_hit", "spans", "words", "items"])


_built: dict[str, Scanner] = {}


def _scanned(sent: Broadcast, key: str, size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _built:  # a worker is used again: one automaton at a time
            _built.clear()
            _built[key] = Scanner(sent.value, size)
        scanner = _built[key]
        for batch in slices(batches):
            found = []
            for text in raw(batch):
                words = normalised(text).split()
                hit, items = scanner.scan(words)
                found.append((len(words), stretches(hit), sorted(items)))
            yield _answered(batch, found)

    return work


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What several scans have found in a text, as one."""
    for batch in slices(batches):
        found = []
        for text, runs, items in zip(raw(batch), batch.column("words").to_pylist(), batch.column("items").to_pylist(), strict=True):
            n = len(normalised(text).split())
            hit = np.zeros(n + 1, np.int64)
            for r in runs or []:
                hit[r["start"]] += 1
                hit[r["end"]] -= 1
            found.append((n, stretches(np.cumsum(hit[:-1]) > 0), sorted(items or [])))
        yield _answered(batch, found)


def _segments(batches: Iterator[pa.RecordBatch], size: int, words_each: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = []
        for item, text in zip(batch.column("item_id").to_pylist(), raw(batch), strict=True):
            words = normalised(text).split()
            rows += [(item, i, b" ".join(words[i : i + words_each + size - 1])) for i in range(0, max(1, len(words) - size + 1), words_each) if words]
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary()), strict=True)], names=["item", "first", "words"])


def segments(benchmark: DataFrame, size: int = SIZE, words_each: int = SEGMENT_WORDS) -> DataFrame:
    """``item, first, words``: normalised stretches of the items; every window of an item lies in one of them."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    return rows.mapInArrow(lambda batches: _segments(batches, size, words_each), "item string, first long, words binary")


def find(documents: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = (), size: int = SIZE, automaton_bytes: int = AUTOMATON_BYTES, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """One row a document: ``doc_id``, ``kept_*``, ``n_words``, ``n_hit``, ``spans`` (code points of the original text), ``words`` (the same in words) and ``items``."""
    spark = documents.sparkSession
    kinds = "".join(f", kept_{c} {documents.schema[c].dataType.simpleString()}" for c in keep)
    rows = documents.select("doc_id", "text", *[F.col(c).alias(f"kept_{c}") for c in keep])
    kind = documents.schema["doc_id"].dataType.simpleString()
    cut = materialize(segments(benchmark, size, segment_words).withColumn("bytes", F.octet_length("words").cast("long")), "benchmark-segments")
    total = cut.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]

    def scanner(some: DataFrame):
        held = [(r["item"], bytes(r["words"])) for r in some.select("item", "words").collect()]  # at most automaton_bytes and one segment
        return _scanned(spark.sparkContext.broadcast(held), uuid.uuid4().hex, size)

    if total <= automaton_bytes:
        return rows.mapInArrow(scanner(cut), f"doc_id {kind}{kinds}, {_FOUND}")
    dealt = running_start(cut, [F.col("item"), F.col("first")], "bytes", "start", "benchmark-order")
    dealt = materialize(dealt.withColumn("automaton", (F.col("start") / automaton_bytes).cast("long")), "benchmark-dealt")
    marks = [F.xxhash64("text").alias("mark"), F.xxhash64(F.lit("other"), "text").alias("mark2")]
    parts = []
    for number in range(-(-total // automaton_bytes)):
        hits = documents.select("text", *marks).mapInArrow(scanner(dealt.where(F.col("automaton") == number)), f"mark long, mark2 long, {_FOUND}")
        parts.append(materialize(hits.where("n_hit > 0").select("mark", "mark2", "words", "items").dropDuplicates(["mark", "mark2"]), "benchmark-hits"))
    hits = parts[0]
    for more in parts[1:]:
        hits = hits.unionByName(more)
    hits = hits.groupBy("mark", "mark2").agg(F.flatten(F.collect_list("words")).alias("words"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))  # a row a scan
    joined = rows.select("*", *marks).join(materialize(hits, "benchmark-joined"), ["mark", "mark2"], "left").drop("mark", "mark2")
    return joined.mapInArrow(_merged, f"doc_id {kind}{kinds}, {_FOUND}")


def judge(documents: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every document."""
    found = find(documents, benchmark, size=size)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def remove(documents: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """The documents that hold no window of the benchmark, with their own columns."""
    others = tuple(c for c in documents.columns if c != "doc_id")
    clean = find(documents, benchmark, keep=others, size=size).where("n_hit = 0")
    return clean.select(*[F.col(c) if c == "doc_id" else F.col(f"kept_{c}").alias(c) for c in documents.columns])


JUDGE_SQL = r"""
WITH norm AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
item AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
cut AS (SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS words FROM cut),
sizes AS (SELECT DISTINCT size FROM windows),
starts AS (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM norm, sizes),
places AS (SELECT r, i, size, array_to_string(w[i : i + size - 1], ' ') AS words FROM starts),
hits AS (SELECT r, i, size, item_id FROM places JOIN windows USING (size, words)),
marked AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + size)) AS j FROM hits) GROUP BY r),
named AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM norm LEFT JOIN marked USING (r) LEFT JOIN named USING (r)
"""
