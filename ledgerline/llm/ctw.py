"""Context-tree weighting over bytes: each byte is eight binary decisions, each decision has a context tree.

Counts of byte strings of ``DEPTH + 1`` are gathered from all training documents.  For the decision ``node`` (the bits
of the byte so far) in a context of ``d`` bytes, ``KT(a, b)`` is the Krichevsky-Trofimov probability of its zeros and
ones, and the weighted probability is ``P = KT/2 + (product over the contexts one byte longer)/2``, down to ``DEPTH``.
With counts fixed, the chance of a bit is the mixture of the depths' estimates ``(n + 1/2) / (a + b + 1)`` with the
weights ``KT / 2P``; a context never seen takes no part.  A text's code length is the sum over its bits.

The tree is distributed and whole.  Strings are dealt by the ``CUT`` context bytes nearest to the coded byte, so that
each subtree below depth ``CUT`` lies in one partition (at most ``256 ** (DEPTH - CUT)`` contexts, whatever the input);
its weighted probabilities are summed into the nodes of depth ``CUT - 1``, and only the tree above them, at most 65,793
contexts, visits the driver.  The same pass folds the chances of each string's bits up to the cut, and the upper tree
ends the fold: a table with the code length of every string of every document.  A document's score is the sum over its
strings: the ``HEAD`` commonest are looked up in memory, all others by a join.  Neither bound changes a result.

Text: ASCII capitals folded, words joined by one blank, then one line end as the end mark.

Defined cases: null text is the end mark alone; a null doc_id has remainder 0 and is held out; repeated rows count and
are scored each; strings that tie in their count are treated alike; a very long text is scored whole, by one task that
holds it; without training documents every bit costs one bit; an empty table gives an empty result; columns other than
doc_id and text are not looked at.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.quality import bucket_floor
from ledgerline.llm.words import raw, slices
from ledgerline.plans.scratch import materialize

DEPTH = 5
#: Context bytes by which the tree is dealt out.
CUT = 3
#: Strings and words looked up in memory; all others are found through a join.
HEAD = 1 << 19
#: Strings of one step through a partition of the tree.
STEP = 200_000
CHUNK = 2_000_000
END = b"\n"
FOLDS = 10


def _signed(h: int) -> int:
    return h - (h >> 63 << 64)


def token_key(word: bytes) -> int:
    return _signed(xxhash.xxh64_intdigest(word))


def _strings(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings of ``depth + 1`` bytes that end at each byte of the texts, and where each text's begin.

    Every text is preceded by ``depth`` end marks, so that its first bytes have a context too.
    """
    pad = END * depth
    line = np.frombuffer(b"".join(pad + t for t in texts), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    keys = line.copy()
    for back in range(1, depth + 1):
        keys[back:] |= line[:-back] << np.uint64(8 * back)
    ends = np.cumsum(sizes + depth)
    keep = np.ones(len(line), bool)
    keep[((ends - sizes - depth)[:, None] + np.arange(depth)[None, :]).ravel()] = False
    return keys[keep], np.cumsum(sizes) - sizes


def _pieces(texts: list[list[bytes]]) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, words in enumerate(texts):
        size += 8 * len(words)
        if size >= CHUNK:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _counted(depth: int):
    kinds = (pa.int32(), pa.int64(), pa.int64())

    def rows(kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind), kinds[0]), pa.array(keys, kinds[1]), pa.array(counts, kinds[2])], names=["kind", "key", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words of training documents (kind 0), and strings of all documents with their count in training (kind 1)."""
        words_seen: Counter = Counter()
        keys, counts, held, docs = [], [], 0, 0

        def words_out() -> pa.RecordBatch:
            n = len(words_seen)
            return rows(0, np.fromiter(map(token_key, words_seen), np.int64, n), np.fromiter(words_seen.values(), np.int64, n))

        def strings_out() -> tuple[np.ndarray, np.ndarray]:
            found, back = np.unique(np.concatenate(keys), return_inverse=True)
            return found, np.bincount(back, np.concatenate(counts)).astype(np.int64)

        for batch in slices(batches, 1024):
            split = [t.lower().split() for t in raw(batch)]
            learn = np.asarray(batch.column("learn"))
            docs += int(learn.sum())
            for lo, hi in _pieces(split):
                for words, taught in zip(split[lo:hi], learn[lo:hi].tolist(), strict=True):
                    if taught:
                        words_seen.update(words)
                if len(words_seen) > 500_000:
                    yield words_out()
                    words_seen.clear()
                strings, starts = _strings([b" ".join(w) + END for w in split[lo:hi]], depth)
                taught = np.repeat(learn[lo:hi], np.diff(np.append(starts, len(strings)))).astype(float)
                k, back = np.unique(strings, return_inverse=True)
                keys.append(k)
                counts.append(np.bincount(back, taught))
                held += len(k)
                if held > 3_000_000:
                    k, n = strings_out()
                    keys, counts, held = [k], [n], 0
                    if len(k) > 2_000_000:
                        yield rows(1, k.view(np.int64), n)
                        keys, counts = [], []
        if docs:
            words_seen[END] += docs
        if words_seen:
            yield words_out()
        if keys:
            yield rows(1, *(x.view(np.int64) for x in strings_out()))

    return work


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps up; error below 1e-12 for positive x."""
    y = x + 8.0
    low = np.ones_like(x)
    for i in range(8):
        low = low * (x + i)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(low)


def kt_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - np.log(np.pi)


class Level:
    """The nodes of one depth: sorted keys ``context << 8 | bits``, counts, log of ``P``, the weight of the own estimate."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        """``below``: for each node the sum of the logs of ``P`` one byte deeper; None at the last depth."""
        self.keys, self.zeros, self.ones = keys, zeros, ones
        own = kt_log(zeros, ones)
        if below is None:
            self.logs, self.weights = own, np.ones(len(keys))
        else:
            self.logs = np.logaddexp(own, below) - np.log(2)
            self.weights = np.exp(own - np.log(2) - self.logs)

    def shorter(self, depth: int) -> tuple[np.ndarray, ...]:
        """Keys, zeros, ones and sums of logs of the nodes of ``depth``, one byte shorter than these."""
        mask = np.uint64((1 << 8 * depth) - 1)
        found, back = np.unique((self.keys >> np.uint64(8) & mask) << np.uint64(8) | self.keys & np.uint64(255), return_inverse=True)
        return found, *(np.bincount(back, x, len(found)) for x in (self.zeros, self.ones, self.logs))

    def fold(self, strings: np.ndarray, chances: np.ndarray, depth: int) -> None:
        """Mixes this depth's estimates into ``chances`` of each string's bits; NaN where no deeper context was seen."""
        if not len(self.keys):
            return
        context, byte = strings >> np.uint64(8) & np.uint64((1 << 8 * depth) - 1), strings & np.uint64(255)
        for j in range(8):
            wanted = context << np.uint64(8) | np.uint64(1 << j) | byte >> np.uint64(8 - j)
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            found = self.keys[at] == wanted
            bit = (byte >> np.uint64(7 - j) & np.uint64(1)).astype(bool)
            zeros, ones = self.zeros[at], self.ones[at]
            estimate = (np.where(bit, ones, zeros) + 0.5) / (zeros + ones + 1.0)
            mixed = np.where(np.isnan(chances[:, j]), estimate, self.weights[at] * estimate + (1 - self.weights[at]) * chances[:, j])
            chances[:, j] = np.where(found, mixed, chances[:, j])


def leaves(strings: np.ndarray, n: np.ndarray) -> Level:
    """The nodes of the last depth, from sorted strings and their counts."""
    keys, zeros, ones = [], [], []
    for j in range(8):
        node = np.uint64(1 << j) | (strings & np.uint64(255)) >> np.uint64(8 - j)
        found, back = np.unique(strings >> np.uint64(8) << np.uint64(8) | node, return_inverse=True)
        bit = (strings >> np.uint64(7 - j) & np.uint64(1)).astype(float)
        keys.append(found)
        zeros.append(np.bincount(back, n * (1 - bit), len(found)))
        ones.append(np.bincount(back, n * bit, len(found)))
    order = np.argsort(np.concatenate(keys), kind="stable")
    return Level(*(np.concatenate(x)[order] for x in (keys, zeros, ones)), None)


def log10_of(chances: np.ndarray) -> np.ndarray:
    """Log10 of the product of a string's bit chances; a bit without any context costs one bit."""
    return np.log10(np.where(np.isnan(chances), 0.5, chances)).sum(axis=1)


_TREE = "key long, n long, chances binary, node long, zeros double, ones double, logs double"


def _subtrees(depth: int, cut: int):
    """From strings in the order of their nearest ``cut`` context bytes: each string's chances down from the cut, and what
    the subtrees add to the nodes of depth ``cut - 1``."""
    mask = np.uint64((1 << 8 * cut) - 1 << 8)

    def grown(strings: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(strings)
        strings, n = strings[order], n[order]
        chances = np.full((len(strings), 8), np.nan)
        node = zeros = ones = logs = np.zeros(0)
        taught = n > 0
        if taught.any():
            level = leaves(strings[taught], n[taught].astype(float))
            for d in range(depth, cut - 1, -1):
                level.fold(strings, chances, d)
                keys, zeros, ones, logs = level.shorter(d - 1)
                if d > cut:
                    level = Level(keys, zeros, ones, logs)
            node = keys.view(np.int64)
        k, m = len(strings), len(node)
        none = [None] * m
        return pa.RecordBatch.from_arrays(
            [
                pa.array(strings.view(np.int64).tolist() + none, pa.int64()), pa.array(n.tolist() + none, pa.int64()), pa.array([c.tobytes() for c in chances.astype("<f4")] + none, pa.binary()),
                pa.array([None] * k + node.tolist(), pa.int64()), *(pa.array([None] * k + x.tolist(), pa.float64()) for x in (zeros, ones, logs)),
            ],
            names=["key", "n", "chances", "node", "zeros", "ones", "logs"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            strings = np.concatenate((strings, np.asarray(batch.column("key")).view(np.uint64)))
            n = np.concatenate((n, np.asarray(batch.column("n"))))
            while len(strings) > STEP:
                ends = np.flatnonzero((strings[1:] & mask) != (strings[:-1] & mask)) + 1
                if not len(ends):
                    break
                at = int(ends[min(len(ends) - 1, np.searchsorted(ends, STEP))])
                yield grown(strings[:at], n[:at])
                strings, n = strings[at:], n[at:]
        if len(strings):
            yield grown(strings, n)

    return work


class Upper:
    """The tree above the cut."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, logs: np.ndarray, depth: int):
        self.levels = [Level(keys, zeros, ones, logs)]
        for d in range(depth - 1, -1, -1):
            self.levels.append(Level(*self.levels[-1].shorter(d)))

    def log10(self, strings: np.ndarray, chances: np.ndarray) -> np.ndarray:
        for i, level in enumerate(self.levels):
            level.fold(strings, chances, len(self.levels) - 1 - i)
        return log10_of(chances)


def _coded(sent):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = sent.value
        for batch in batches:
            chances = np.frombuffer(b"".join(batch.column("chances").to_pylist()), "<f4").reshape(len(batch), 8).astype(float)
            logs = upper.log10(np.asarray(batch.column("key")).view(np.uint64), chances)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), pa.array(logs)], names=["key", "n", "log"])

    return work


class Table:
    """Open addressing over sorted strings, for many lookups at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, ~np.uint64(0))
        self.values = np.zeros(1 << bits)
        left, slot = np.arange(len(keys)), self._slots(keys)
        while len(left):
            free = self.keys[slot] == ~np.uint64(0)
            self.keys[slot[free]] = keys[left[free]]
            won = self.keys[slot] == keys[left]
            self.values[slot[won]] = values[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, 0 for keys that are not there, and the places of those."""
        slot = self._slots(keys)
        found = self.keys[slot]
        out = self.values[slot].astype(np.float64)
        left, absent = np.flatnonzero(found != keys), []
        while len(left):
            there = self.keys[slot[left]]
            none = there == ~np.uint64(0)
            absent.append(left[none])
            hit = there == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~none & ~hit]
            slot[left] = (slot[left] + 1) & self.mask
        absent = np.concatenate(absent) if absent else left
        out[absent] = 0.0
        return out, absent


_SENT: dict = {}


def _tallied(owner: np.ndarray, keys: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each owner's distinct keys and how often it has them, and the bounds of the owners' lists."""
    order = np.lexsort((keys, owner))
    owner, keys = owner[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return keys[first], np.diff(np.append(first, len(keys))), np.searchsorted(owner[first], np.arange(owners + 1))


_RARE = pa.struct([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])


def _rare_lists(found: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], owners: int) -> pa.Array:
    """One list an owner of the rows ``kind, key, n`` of several kinds."""
    owner = np.concatenate([np.repeat(np.arange(owners), np.diff(at)) for _, _, _, at in found])
    order = np.argsort(owner, kind="stable")
    kind = np.concatenate([np.full(len(k), i) for i, k, _, _ in found])[order]
    keys, n = (np.concatenate([f[c] for f in found])[order] for c in (1, 2))
    offsets = np.searchsorted(owner[order], np.arange(owners + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(kind, pa.int32()), pa.array(keys, pa.int64()), pa.array(n, pa.int64())], fields=list(_RARE)))


def _scored(sent, name: str, depth: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _SENT:
            _SENT.clear()
            head, logs, strings, codes = sent.value
            _SENT[name] = head, logs, Table(strings, codes)
        head, logs, table = _SENT[name]
        for batch in slices(batches, 1024):
            split = [t.lower().split() for t in raw(batch)]
            flat: list[list] = [[], [], [], []]
            rare = []
            for lo, hi in _pieces(split):
                some = split[lo:hi]
                lengths = np.fromiter(map(len, some), np.int64, len(some))
                number: dict[bytes, int] = {}
                ids = np.fromiter((number.setdefault(w, len(number)) for words in some for w in words), np.int64)
                keys = np.fromiter(map(token_key, number), np.int64, len(number))
                at = np.minimum(np.searchsorted(head, keys), max(0, len(head) - 1))
                known = head[at] == keys if len(head) else np.zeros(len(keys), bool)
                doc = np.repeat(np.arange(len(some)), lengths)
                here = known[ids]
                flat[0].append(lengths)
                flat[1].append(np.bincount(doc[here], minlength=len(some)))
                flat[2].append(np.bincount(doc[here], logs[at[ids[here]]], len(some)))
                strings, starts = _strings([b" ".join(w) + END for w in some], depth)
                codes, absent = table.get(strings)
                flat[3].append(np.add.reduceat(codes, starts))
                away = np.searchsorted(starts, absent, side="right") - 1
                rare.append(_rare_lists([(0, *_tallied(doc[~here], keys[ids[~here]], len(some))), (1, *_tallied(away, strings[absent].view(np.int64), len(some)))], len(some)))
            lists = pa.concat_arrays(rare) if rare else pa.array([], pa.list_(_RARE))
            columns = [np.concatenate([np.zeros(0), *f]) for f in flat]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(columns[0].astype(np.int64)), pa.array(columns[1].astype(np.int64)), pa.array(columns[2]), pa.array(columns[3]), lists], names=["doc_id", "held_out", "words", "head_known", "head_log", "head_code", "rare"])

    return work


def commonest(counts: DataFrame, most: int) -> DataFrame:
    """The rows of the highest ``n``, at most ``most``: those from a bucket of counts on, so that nothing is ranked."""
    sizes = counts.groupBy(bucket_floor(F.col("n")).alias("least")).agg(F.count("*").alias("rows")).collect()  # under 1000 buckets
    least, taken = (1 << 63) - 1, 0
    for r in sorted(sizes, reverse=True):
        taken += r["rows"]
        if taken > most:
            break
        least = r["least"]
    return counts.where(F.col("n") >= least)


def code_lengths(counts: DataFrame, depth: int = DEPTH, cut: int = CUT) -> DataFrame:
    """``key, n, log``: log10 of the chance of each string's last byte after those before it, from ``key, n``."""
    cut = min(cut, depth)
    near = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * cut) - 1))
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = counts.select("key", "n", near.alias("near")).repartition(parts, "near").sortWithinPartitions("near").select("key", "n")
    tree = materialize(dealt.mapInArrow(_subtrees(depth, cut), _TREE), "ctw-tree")
    nodes = tree.where("node IS NOT NULL").groupBy("node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "logs")])
    found = nodes.toArrow()  # nodes of at most 256 ** (cut - 1) contexts
    keys, zeros, ones, logs = (np.asarray(found.column(c).combine_chunks()) for c in ("node", "zeros", "ones", "logs"))
    order = np.argsort(keys.view(np.uint64))
    upper = Upper(keys.view(np.uint64)[order], zeros[order], ones[order], logs[order], cut - 1)
    sent = counts.sparkSession.sparkContext.broadcast(upper)
    return materialize(tree.where("key IS NOT NULL").select("key", "n", "chances").mapInArrow(_coded(sent), "key long, n long, log double"), "ctw-codes")


def score(documents: DataFrame, folds: int = FOLDS, depth: int = DEPTH, head: int = HEAD, cut: int = CUT) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row.

    The model learns from the documents whose ``crc32(doc_id) % folds`` is not 0 and scores all of them.
    """
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds
    rows = documents.select("doc_id", (fold == 0).alias("held_out"), "text")
    counts = rows.select((~F.col("held_out")).alias("learn"), "text").mapInArrow(_counted(depth), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "ctw-counts")
    words, codes = counts.where("kind = 0").select("key", "n"), code_lengths(counts.where("kind = 1").select("key", "n"), depth, cut)
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    common, strings = commonest(words, head).toArrow(), commonest(codes, head).select("key", "log").toArrow()  # at most `head` rows each
    keys, n, known, logs = (np.asarray(t.column(c).combine_chunks()) for t, c in ((common, "key"), (common, "n"), (strings, "key"), (strings, "log")))
    order = np.argsort(keys, kind="stable")
    ends = words.where(F.col("key") == token_key(END)).select("n").first()
    end_count = ends["n"] if ends else 0
    sent = rows.sparkSession.sparkContext.broadcast((keys[order], np.log10(n[order] + 0.1), known.view(np.uint64), logs))
    kind = documents.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(_scored(sent, uuid.uuid4().hex, depth), f"doc_id {kind}, held_out boolean, words long, head_known long, head_log double, head_code double, rare array<struct<kind:int,key:bigint,n:bigint>>")
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "ctw-scored")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.*").withColumnRenamed("n", "times")
    facts = words.select(F.lit(0).alias("kind"), "key", F.log10(F.col("n") + 0.1).alias("log")).unionByName(codes.select(F.lit(1).alias("kind"), "key", "log"))
    rare = rare.join(facts, ["kind", "key"], "left").withColumn("known", F.col("log").isNotNull()).withColumn("log", F.col("times") * F.coalesce("log", F.log10(F.lit(0.1))))
    rare = rare.groupBy("row").agg(
        F.sum(F.when(F.expr("kind = 0 AND known"), F.col("times")).otherwise(0)).alias("rare_known"), F.sum(F.when(F.expr("kind = 0"), F.col("log"))).alias("rare_log"), F.sum(F.when(F.expr("kind = 1"), F.col("log"))).alias("rare_code")
    )
    out = scored.drop("rare").join(rare, "row", "left")
    n_tokens = F.col("words") + 1
    base = F.col("head_log") + F.coalesce("rare_log", F.lit(0.0)) + float(np.log10(end_count + 0.1)) - n_tokens * float(np.log10(total + 0.1 * (distinct + 1)))
    n_known = F.col("head_known") + F.coalesce("rare_known", F.lit(0)) + (1 if end_count else 0)
    return out.select("doc_id", "held_out", n_tokens.alias("n_tokens"), n_known.alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("head_code") + F.coalesce("rare_code", F.lit(0.0))).alias("score"))
