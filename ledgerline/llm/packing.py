"""Pack token ids into windows: non-negative least squares over shallow length combinations, then greedy residuals.

Documents are cut at whole windows; each full window is a sequence.  The tails' lengths form a histogram of at most
``window`` entries.  Combinations of two or three lengths that fill a window are the columns of a sparse matrix, and
``x >= 0`` minimising ``|A x - histogram|`` says how often to use each; rounded down, they are sequences without
padding.  The residuals are packed greedily: the longest first into the open sequence, cut where it is full, so that every
sequence but the last is; the last, shorter stretch is cut at powers of two.  Only the histogram visits the driver.  A
tail's rank among those of its length comes from its rank inside its partition plus the partition's offset, so no length is
gathered in one task; the pieces lie in buckets by partition, and the offsets alone are moved to them.

Defined cases: null and empty texts hold the end id alone; repeated rows and null doc_ids are packed each for itself; tails
of one length are placed in the order of the input's partitions and rows; a very long text is encoded by one task and cut
into whole windows; an empty table gives an empty result; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.tokens import encoder, id_bytes, vocabulary
from ledgerline.llm.words import sized, slices, texts
from ledgerline.plans.scratch import bucketed, materialize

WINDOW = 2048
END = 1
PARTNERS = (64, 128, 256, 384, 512, 768)
ROUNDS = 40


def combinations_of(window: int) -> np.ndarray:
    """Rows of three lengths (0: none) that fill the window: all pairs, and triples with an equal or a round partner."""
    found = {(0, a, window - a) for a in range(1, window // 2 + 1)}
    for a in range(1, window):
        for b in (a, (window - a) // 2, *PARTNERS):
            if 0 < b and a + b < window:
                found.add(tuple(sorted((a, b, window - a - b))))
    return np.array(sorted(found), np.int64)


def solve(histogram: np.ndarray, combos: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative ``x`` that brings ``A x`` near the histogram, by coordinate descent.

    A column holds how often its combination uses each length; it has at most three entries.
    """
    left = histogram.astype(float).tolist()
    left[0] = 0.0
    columns = [[(length, c.count(length)) for length in sorted(set(c)) if length] for c in combos.tolist()]
    columns = [(j, entries, sum(n * n for _, n in entries)) for j, entries in enumerate(columns) if all(left[length] > 0 for length, _ in entries)]
    x = np.zeros(len(combos)).tolist()
    for _ in range(rounds):
        moved = 0.0
        for j, entries, norm in columns:
            step = max(-x[j], sum(n * left[length] for length, n in entries) / norm)
            if step:
                x[j] += step
                for length, n in entries:
                    left[length] -= n * step
                moved = max(moved, abs(step))
        if moved < 0.01:
            break
    return np.array(x)


class Plan:
    """Where the tail of length ``l`` and rank ``r`` goes, for every length and rank."""

    def __init__(self, histogram: np.ndarray, window: int = WINDOW):
        combos = combinations_of(window)
        times = np.floor(solve(histogram, combos) + 1e-9).astype(np.int64)
        free = histogram.copy()
        slots: list[list[tuple[int, int, int]]] = [[] for _ in range(window)]
        used = np.zeros(window, np.int64)
        base = 0
        for j in np.argsort(-times, kind="stable"):
            lengths = [int(v) for v in combos[j] if v]
            n = min(int(times[j]), *(int(free[v] // lengths.count(v)) for v in lengths)) if times[j] else 0
            if n <= 0:
                continue
            offset = 0
            for v in lengths:
                slots[v].append((int(used[v]), base, offset))
                used[v] += n
                free[v] -= n
                offset += v
            base += n
        self.window, self.used = window, used
        self.slots = [np.array(s, np.int64).reshape(-1, 3) for s in slots]
        self.combined = base
        lengths = np.arange(window)
        total = (free * lengths)[::-1]
        self.stream_base = (np.cumsum(total) - total)[::-1]
        self.total = int(total.sum())
        rest, at, powers = self.total % window, self.total - self.total % window, []
        while rest:
            powers.append(at)
            at += 1 << (rest.bit_length() - 1)
            rest -= 1 << (rest.bit_length() - 1)
        self.last, self.powers = self.total - self.total % window, powers
        self.sequences = base + self.total // window + len(powers)

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """Pieces ``(first id, ids, sequence, offset)`` of the tail."""
        if rank < self.used[length]:
            slots = self.slots[length]
            first, base, offset = slots[np.searchsorted(slots[:, 0], rank, side="right") - 1].tolist()
            return [(0, length, base + rank - first, offset)]
        at = int(self.stream_base[length]) + (rank - int(self.used[length])) * length
        done, pieces = 0, []
        while done < length:
            if at < self.last:
                begin, sequence = at - at % self.window, at // self.window
                end = begin + self.window
            else:
                k = int(np.searchsorted(self.powers, at, side="right")) - 1
                begin, sequence = self.powers[k], self.last // self.window + k
                end = self.powers[k + 1] if k + 1 < len(self.powers) else self.total
            n = min(length - done, end - at)
            pieces.append((done, n, self.combined + sequence, at - begin))
            done, at = done + n, at + n
        return pieces


def _cut(path: str, blanks: bool, end: int, window: int, width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path, blanks).encode_all, TaskContext.get().partitionId()
        ranks = np.zeros(window + 1, np.int64)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
        names = ["doc_id", "doc_tokens", "start", "length", "rank", "part", "ids"]
        for batch in sized(batches):
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(texts(batch)), strict=True):
                ids = np.append(ids, np.uint32(end)).astype(f"<u{width}")
                for at in range(0, len(ids), window):
                    piece = ids[at : at + window]
                    rows.append((doc_id, len(ids), at, len(piece), int(ranks[len(piece)]), part, piece.tobytes()))
                    ranks[len(piece)] += 1
            for lo in range(0, len(rows), 4096):
                columns = list(zip(*rows[lo : lo + 4096], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return work


def _placed(plan: Plan | None, width: int):
    """Places tails by ``plan``; without one, rows are full windows with a sequence of their own."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        for batch in slices(batches, 1024):
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "start", "length", "doc_tokens", "rank", "ids")]
            rows = []
            for doc_id, start, length, doc_tokens, rank, ids in zip(*columns, strict=True):
                ids = np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()
                for first, n, sequence, offset in plan.place(length, rank) if plan else [(0, length, rank, 0)]:
                    rows.append((doc_id, start + first, n, doc_tokens, sequence, offset, ids[4 * first : 4 * (first + n)]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return work


PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(documents: DataFrame, tokenizer: str | None = None, blanks: bool = False, end: int = END, window: int = WINDOW) -> DataFrame:
    """One row a piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids`` (unsigned 32-bit, little endian)."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tokenizer = tokenizer or default_tokenizer()
    width = id_bytes(tokenizer)
    schema = "doc_id long, doc_tokens long, start long, length int, rank long, part int, ids binary"
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pieces = bucketed(rows.mapInArrow(_cut(tokenizer, blanks, end, window, width), schema), "pack-pieces", ["part"], parts)
    counts = materialize(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "pack-counts")
    histogram = np.zeros(window, np.int64)
    for row in counts.where(F.col("length") < window).groupBy("length").agg(F.sum("n").alias("n")).collect():  # under `window` rows
        histogram[row["length"]] = row["n"]
    plan = Plan(histogram, window)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.where(F.col("length") < window).select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # one row a partition, with an array by length: the pieces stay in their buckets and only these rows move
    offsets = offsets.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("length", "before"))).alias("known"))
    by_length = F.transform(F.sequence(F.lit(1), F.lit(window - 1)), lambda length: F.coalesce(F.try_element_at("known", length), F.lit(0)))
    offsets = materialize(offsets.select("part", by_length.alias("befores")), "pack-offsets").hint("shuffle_hash")
    tails = pieces.where(F.col("length") < window).join(offsets, "part").withColumn("rank", F.col("rank") + F.element_at("befores", F.col("length")))
    columns = ("doc_id", "start", F.col("length").cast("long").alias("length"), "doc_tokens", "rank", "ids")
    full = pieces.where(F.col("length") == window).withColumn("rank", F.lit(plan.sequences) + F.shiftleft(F.col("part").cast("long"), 33) + F.col("rank"))
    return tails.select(*columns).mapInArrow(_placed(plan, width), PIECES).unionByName(full.select(*columns).mapInArrow(_placed(None, width), PIECES))


def default_tokenizer() -> str:
    return vocabulary("word_bpe_49k.json")
