"""Substring dedup: a compacted De Bruijn graph of word k-mers finds the passages that earlier documents hold too.

The k-mers of ``window`` words are the edges of the graph.  Only edges that can repeat are written: each document is cut
where the least-hashed ``seed`` words inside the window change, which gives runs of windows with one seed; equal windows
choose equal seeds, so windows whose seed lies in one document alone are left out.

1. Runs: ``seed, digest, document, first window, windows``.  A grouped minimum keeps the seeds of two or more documents.
   Where all runs of a seed have one digest, the run is a path that never branches and stays one edge.
2. Edges: such runs, and all windows of the other seeds, each with the edge that follows it in its document.  Edges of two or
   more documents stay; the least document that holds one, and the place there, are its source coordinates.
3. Compaction: the distinct pairs of an edge and its follower give in and out degrees by grouped counts.  Joins keep the
   pairs where both are one and the source coordinates run on; edges so linked are one path, named by its first place.
4. Occurrences of one path at one distance from its source are one long span ``(document, first word, end, source, there)``.
5. Verification: the words of every span are digested in its document and at the source coordinates (BLAKE2, 128 bits).
   Should hashes of edges ever have collided, digests differ, and all is done again with other hashes.

Texts are dealt by document once, into buckets, so that the joins with runs and spans move no text.

Defined cases: null text has no words; a document shorter than the window loses nothing; a null doc_id comes after all
others; rows with one doc_id never remove each other's words; where several rows of the least doc_id hold a window, or one
holds it several times, any of these places is the source; a very long text is hashed in one piece and opened only where
its seeds repeat; an empty table gives an empty result; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.words import Words, mixed, pieces, raw, slices, spread
from ledgerline.plans.scratch import bucketed, materialize

WINDOW = 50
SEED = 16
TRIES = 5
LAST = (1 << 63) - 1


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                table = np.full(n, base, np.uint64)
                table[0] = 1
                setattr(self, name, np.cumprod(table, dtype=np.uint64))


_POWERS = Powers(0xC2B2AE3D27D4EB4F)


class Ranges:
    """Hashes of any ranges of words in constant time each; ``salt`` gives other hashes."""

    def __init__(self, words: Words, salt: int):
        values = mixed(words.hashes[0] + np.uint64(salt))
        _POWERS.need(len(values) + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * _POWERS.up[: len(values)], dtype=np.uint64)))

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * _POWERS.down[starts] + (ends - starts).astype(np.uint64))


def runs(words: Words, window: int, seed: int, salt: int = 0) -> tuple[np.ndarray, ...]:
    """document, first window, windows, seed hash and digest of each run of windows with one seed."""
    n = words.total - seed + 1
    span = window - seed + 1
    if words.total < window:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    at = np.arange(n, dtype=np.int64)
    ranges = Ranges(words, salt)
    seeds = ranges.hashes(at, at + seed)
    low = (seeds & np.uint64(~((1 << 28) - 1) & (1 << 64) - 1)) | at.astype(np.uint64)
    width = 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    least = (low & np.uint64((1 << 28) - 1)).astype(np.int64)  # of the windows 0 .. total - window
    doc = np.repeat(np.arange(len(words.count)), words.count)
    inside = doc[: len(least)] == doc[window - 1 : window - 1 + len(least)]
    begins = inside & (np.concatenate(([True], least[1:] != least[:-1])) | np.concatenate(([True], ~inside[:-1])) | np.concatenate(([True], doc[1 : len(least)] != doc[: len(least) - 1])))
    first = np.flatnonzero(begins)
    if not len(first):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    # windows of a run: up to the next start or the last window of the document
    last = words.first[doc[first]] + words.count[doc[first]] - window
    upto = np.minimum(np.append(first[1:], len(least)) - 1, last)
    digest = mixed(ranges.hashes(first, upto + window) + ((least[first] - first) * 131072 + (upto - first)).astype(np.uint64))
    return doc[first], first - words.first[doc[first]], upto - first + 1, seeds[least[first]].view(np.int64), digest.view(np.int64)


def _runs(window: int, seed: int, salt: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            docs = raw(batch)
            ids, marks = batch.column("id").to_numpy(), batch.column("mark").to_numpy()
            for lo, hi in pieces(docs):
                doc, first, n, seeds, digest = runs(Words(docs[lo:hi]), window, seed, salt)
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo + doc], pa.int64()), pa.array(marks[lo + doc], pa.int64()), pa.array(first, pa.int32()), pa.array(n, pa.int32()), pa.array(seeds, pa.int64()), pa.array(digest, pa.int64())], names=["id", "mark", "first", "n", "seed", "digest"])

    return work


def _edges(window: int, salt: int):
    """Edges of the repeated runs of each document: straight runs as they are, the others window by window."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            docs = raw(batch)
            ids, marks = batch.column("id").to_numpy(), batch.column("mark").to_numpy()
            lists = batch.column("runs")
            flat, bounds = lists.values, np.asarray(lists.offsets)
            first, n, digest, straight = (np.asarray(flat.field(c)) for c in ("first", "n", "digest", "straight"))
            for lo, hi in pieces(docs):
                words = Words(docs[lo:hi])
                some = slice(bounds[lo], bounds[hi])
                doc = np.repeat(np.arange(hi - lo), np.diff(bounds[lo : hi + 1]))
                times = np.where(straight[some], 1, n[some])
                at = spread(first[some].astype(np.int64), times)
                size = np.repeat(np.where(straight[some], n[some], 1), times)
                doc, whole = np.repeat(doc, times), np.repeat(straight[some], times)
                start = at + words.first[doc]
                keys = Ranges(words, salt).hashes(start, start + window).view(np.int64)
                keys = np.where(whole, np.repeat(digest[some], times), keys)
                order = np.lexsort((at, doc))
                doc, at, size, keys = doc[order], at[order], size[order], keys[order]
                follows = np.zeros(len(at), bool)
                follows[:-1] = (doc[1:] == doc[:-1]) & (at[1:] == at[:-1] + size[:-1])
                after = pa.array(np.append(keys[1:], 0)[: len(keys)], pa.int64(), mask=~follows)
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo + doc], pa.int64()), pa.array(marks[lo + doc], pa.int64()), pa.array(at, pa.int32()), pa.array(size, pa.int32()), pa.array(keys), after], names=["id", "mark", "first", "n", "edge", "after"])

    return work


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of the words of each wanted range."""
    for batch in slices(batches):
        rows = []
        for doc_id, mark, text, wanted in zip(batch.column("id").to_pylist(), batch.column("mark").to_pylist(), raw(batch), batch.column("wanted").to_pylist(), strict=True):
            words = text.split()
            rows += [(doc_id, mark, r["first"], r["end"], blake2b(b" ".join(words[r["first"] : r["end"]]), digest_size=16).digest()) for r in wanted]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["id", "mark", "first", "end", "digest"])


def _dealt(documents: DataFrame) -> DataFrame:
    """doc_id with null last, a digest of the text that tells rows of one doc_id apart, and the text, in buckets of both."""
    parts = max(1, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64("text").alias("mark"), "text")
    return bucketed(rows.repartition(parts, "id", "mark"), "substring-texts", ["id", "mark"], parts)


def edges_of(texts: DataFrame, window: int, seed: int, salt: int = 0) -> DataFrame:
    """``edge, after, id, mark, first, n, source``: the edges of two or more documents wherever they occur."""
    found = materialize(texts.mapInArrow(_runs(window, seed, salt), "id long, mark long, first int, n int, seed long, digest long"), "substring-runs")
    seeds = found.groupBy("seed").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min("digest").alias("d0"), F.max("digest").alias("d1")).where("low < high")
    seeds = materialize(seeds.select("seed", (F.col("d0") == F.col("d1")).alias("straight")), "substring-seeds")
    shared = found.join(seeds, "seed").groupBy("id", "mark").agg(F.collect_list(F.struct("first", "n", "digest", "straight")).alias("runs"))
    # rows that repeat a whole row hold each run several times
    shared = texts.join(shared, ["id", "mark"]).select("id", "mark", "text", F.array_distinct("runs").alias("runs"))
    edges = materialize(shared.mapInArrow(_edges(window, salt), "id long, mark long, first int, n int, edge long, after long"), "substring-edges")
    twice = edges.groupBy("edge").agg(F.min("id").alias("source"), F.max("id").alias("high")).where("source < high").select("edge", "source")
    return materialize(edges.join(materialize(twice, "substring-twice"), "edge"), "substring-repeated")


def paths_of(edges: DataFrame) -> DataFrame:
    """``edge, source, source_mark, there, path``: source coordinates of each edge, and the first place of its path."""
    pick = F.xxhash64("mark", "first")
    nodes = edges.where(F.col("id") == F.col("source")).groupBy("edge", "source", "n").agg(F.min_by("mark", pick).alias("source_mark"), F.min_by("first", pick).alias("there"))
    nodes = materialize(nodes, "substring-nodes")
    pairs = edges.where("after IS NOT NULL").select("edge", "after").distinct().join(nodes.select(F.col("edge").alias("after")), "after", "left_semi")
    pairs = materialize(pairs, "substring-pairs")
    out, into = pairs.groupBy("edge").agg(F.count("*").alias("out_degree")), pairs.groupBy("after").agg(F.count("*").alias("in_degree"))
    links = pairs.join(out.where("out_degree = 1"), "edge").join(into.where("in_degree = 1"), "after").select("edge", "after")
    one = nodes.select("edge", "source", "source_mark", (F.col("there") + F.col("n")).alias("there"))
    links = links.join(one, "edge").select(F.col("after").alias("edge"), "source", "source_mark", "there").withColumn("linked", F.lit(True))
    nodes = nodes.join(links, ["edge", "source", "source_mark", "there"], "left")
    along = Window.partitionBy("source", "source_mark").orderBy("there", "edge").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return nodes.withColumn("path", F.max(F.when(F.col("linked").isNull(), F.col("there"))).over(along)).select("edge", "source", "source_mark", "there", "path")


def long_spans(edges: DataFrame, paths: DataFrame, window: int) -> DataFrame:
    """``id, mark, first, end, source, source_mark, there``: occurrences of a path after each other are one span."""
    found = edges.where(F.col("id") > F.col("source")).select("edge", "id", "mark", "first", "n").join(materialize(paths, "substring-paths"), "edge")
    found = found.withColumn("away", F.col("first") - F.col("there"))
    keys = ["id", "mark", "source", "source_mark", "path", "away"]
    order = Window.partitionBy(*keys).orderBy("first")
    begins = F.when(F.col("first") <= F.lag(F.col("first") + F.col("n")).over(order), 0).otherwise(1)
    found = found.withColumn("begins", begins).withColumn("island", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = found.groupBy(*keys, "island").agg(F.min("first").alias("first"), F.max(F.col("first") + F.col("n") - 1 + window).cast("int").alias("end"))
    return spans.select("id", "mark", "first", "end", "source", "source_mark", (F.col("first") - F.col("away")).cast("int").alias("there"))


def _verified(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """The spans with ``same``: whether the words at the source coordinates are those of the span."""
    last = (F.col("there") + F.col("end") - F.col("first")).cast("int")
    there = spans.select(F.col("source").alias("id"), F.col("source_mark").alias("mark"), F.col("there").alias("first"), last.alias("end"))
    wanted = spans.select("id", "mark", "first", "end").unionByName(there).groupBy("id", "mark").agg(F.collect_set(F.struct("first", "end")).alias("wanted"))
    digests = texts.join(wanted, ["id", "mark"]).mapInArrow(_digested, "id long, mark long, first int, end int, digest binary")
    digests = materialize(digests.distinct(), "substring-digests")
    source = digests.select(F.col("id").alias("source"), F.col("mark").alias("source_mark"), F.col("first").alias("there"), F.col("end").alias("last"), F.col("digest").alias("other"))
    both = spans.withColumn("last", last).join(digests, ["id", "mark", "first", "end"]).join(source, ["source", "source_mark", "there", "last"])
    return both.select("id", "mark", "first", "end", "source", "source_mark", "there", (F.col("digest") == F.col("other")).alias("same"))


def repeated_spans(documents: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``id, mark, first, end, source, source_mark, there``: words ``first .. end - 1`` that stand in the earlier document too."""
    return _repeated(_dealt(documents), window, seed)


def _repeated(texts: DataFrame, window: int, seed: int) -> DataFrame:
    for salt in range(TRIES):
        edges = edges_of(texts, window, seed, salt)
        spans = materialize(long_spans(edges, paths_of(edges), window), "substring-spans")
        spans = materialize(_verified(texts, spans), "substring-verified")
        if spans.where("NOT same").isEmpty():
            return spans.drop("same")
    raise RuntimeError("hashes of different windows kept colliding")


def cover(spans: list[tuple[int, int]], n: int) -> np.ndarray:
    """Which of ``n`` words the spans cover."""
    marks = np.zeros(n + 1, np.int64)
    for first, end in spans:
        marks[first] += 1
        marks[end] -= 1
    return np.cumsum(marks[:n]) > 0


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        n_words, n_removed, kept = [], [], []
        for text, spans in zip(raw(batch), batch.column("spans").to_pylist(), strict=True):
            words = text.split()
            n_words.append(len(words))
            if spans:
                gone = cover([(s["first"], s["end"]) for s in spans], len(words))
                n_removed.append(int(gone.sum()))
                words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            else:
                n_removed.append(0)
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string(), safe=False)], names=["id", "n_words", "n_removed", "kept"])


def remove_repeats(documents: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text``: the words that stay, joined by one space."""
    texts = _dealt(documents)
    spans = _repeated(texts, window, seed).groupBy("id", "mark").agg(F.collect_set(F.struct("first", "end")).alias("spans"))
    rows = texts.join(spans, ["id", "mark"], "left").select("id", "text", "spans")
    rows = rows.mapInArrow(_removed, "id long, n_words long, n_removed long, kept string")
    return rows.select(F.when(F.col("id") != LAST, F.col("id")).alias("doc_id"), "n_words", "n_removed", F.col("kept").alias("kept_text"))
