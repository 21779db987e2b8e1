"""SimHash near-duplicates of resemblance 0.8: tiles from min-hash keys, fingerprints compared by exclusive-or and bit
counts, whole shingle sets verified.

Equal shingle sets are one node with a 64-bit SimHash fingerprint of its set.  Texts of Jaccard resemblance 0.8 differ in
10 bits on average, too many for buckets of agreeing bit blocks, so tiles come from min-hash keys: a node has ``BANDS``
keys of ``ROWS`` least hashes each; two nodes of resemblance ``s`` share a key with chance ``1 - (1 - s ** ROWS) ** BANDS``,
so at 0.8 a pair is missed with chance 2e-7.  The nodes of a key form a tile (cut by a hash above ``tile`` nodes).

1. Each tile is covered by centres: the node nearest to the majority of the fingerprints still uncovered is held against all
   nodes of its tile within ``RADIUS`` bits, and so is a key's least node.  That gives a few pairs a node, not all pairs, and
   unites families whose members resemble their origin more than each other.
2. The tiles that still hold several components are covered again, and so on while that unites any.
3. What is left is compared pair by pair: by exclusive-or and bit counts within the radius, with those slices skipped whose
   bit counts differ by more, pairs of cuts dealt out, and then by the number of least hashes shared (a byte of each).
   Nothing rests on the choice of the centres.  Sets of at most ``SHORT`` shingles, whose fingerprints and least hashes may
   differ by more (4 and 5 shingles of resemblance 0.8 in over 26 bits with chance 1.3e-5), are held against each other
   without either test.

A longer pair of resemblance 0.8 fails either test with chance below 1e-6; whole shingle sets decide on every pair that leaves a
tile.

Defined cases: ASCII capitals are folded; a text of fewer words than a shingle is one shingle; null and wordless texts
have the empty set and are copies of each other; shingles are told apart by 64 bits; a very long text is one node with its
whole set; of rows that tie in doc_id the one of least row hash stays; equal rows are one; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.simhash import TIE, row_key, rows_of
from ledgerline.llm.words import Words, mixed, pieces, raw, slices
from ledgerline.plans.components import connected_components
from ledgerline.plans.scratch import hold, holding, materialize, release

SHINGLE = 5
ALIKE = 0.8
BANDS, ROWS = 40, 5
TILE = 2048
RADIUS = 26
CENTRES = 8
SHORT = 64

_rng = np.random.default_rng(11)
_FACTORS = _rng.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32)


def shingles(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of all runs of ``shingle`` words."""
    out = []
    for lo, hi in pieces(texts):
        words = Words([t.lower() for t in texts[lo:hi]])
        h = words.hashes[0]
        runs = np.zeros(max(0, len(h) - shingle + 1), np.uint64)
        for k in range(shingle):
            runs = runs * np.uint64(0xC2B2AE3D27D4EB4F) + h[k : k + len(runs)]
        runs = mixed(runs)
        for first, n in zip(words.first.tolist(), words.count.tolist(), strict=True):
            if n >= shingle:
                out.append(np.unique(runs[first : first + n - shingle + 1]))
            else:  # one shingle of all words, told apart from longer ones by its number of words
                run = np.zeros(1 if n else 0, np.uint64)
                for k in range(n):
                    run = run * np.uint64(0xC2B2AE3D27D4EB4F) + h[first + k]
                out.append(mixed(run + np.uint64(n)))
    return out


def fingerprint(grams: np.ndarray) -> int:
    """Majority vote of the bits of the set's hashes, as a signed integer."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(grams), 1 << 16):
        ones += np.unpackbits(grams[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(grams), bitorder="little").view("<i8")[0])


def bands(grams: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The ``BANDS`` keys of a shingle set, and a byte of each least hash."""
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    folded = (grams ^ (grams >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(folded), 1024):
        part = folded[at : at + 1024]
        np.minimum(low, (_FACTORS[:, None] * part[None, :] + _SHIFTS[:, None]).min(axis=1), out=low)
    keys = low.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(keys[b].tobytes(), b) for b in range(BANDS)], np.uint64).view(np.int64), low.astype(np.uint8).tobytes()


def _node(grams: np.ndarray) -> int:
    digest = xxhash.xxh64_intdigest(grams.tobytes())
    return digest - (digest >> 63 << 64)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = shingles(raw(batch))
        found = [bands(g) for g in sets]
        keys = np.concatenate([k for k, _ in found] or [np.zeros(0, np.int64)])
        lists = pa.ListArray.from_arrays(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32), pa.array(keys))
        arrays = [batch.column("tie"), batch.column("doc_id"), pa.array([_node(g) for g in sets], pa.int64()), pa.array([len(g) for g in sets], pa.int64()), pa.array([fingerprint(g) for g in sets], pa.int64()), pa.array([b for _, b in found], pa.binary()), lists]
        yield pa.RecordBatch.from_arrays(arrays, names=["tie", "doc_id", "node", "grams", "fp", "least_bytes", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = shingles(raw(batch))
        yield pa.RecordBatch.from_arrays([pa.array([_node(g) for g in sets], pa.int64()), pa.array([g.tobytes() for g in sets], pa.binary())], names=["node", "set"])


def _alike(alike: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            near = []
            for one, two in zip(batch.column("one"), batch.column("two"), strict=True):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (one, two))
                near.append(_resemble(a, b, alike))
            yield batch.select(["src", "dst"]).filter(pa.array(near, pa.bool_()))

    return work


def _verified(pairs: DataFrame, sets: DataFrame, alike: float, name: str) -> DataFrame:
    one, two = (sets.select(F.col("node").alias(end), F.col("set").alias(side)) for end, side in (("src", "one"), ("dst", "two")))
    return materialize(pairs.join(one, "src").join(two, "dst").select("src", "dst", "one", "two").mapInArrow(_alike(alike), "src long, dst long"), name)


def _read_tile(tile: pa.Array) -> list[np.ndarray]:
    node, grams, part = (np.asarray(tile.field(c)) for c in ("node", "grams", "part"))
    return [node, grams, part, np.asarray(tile.field("fp")).view(np.uint64)]


def _cover(radius: int, alike: float):
    """Pairs of each tile's centres with its other components: at most ``CENTRES`` and one a node."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for tile, least in zip(batch.column("tile"), batch.column("least").to_pylist(), strict=True):
                node, grams, part, fp = _read_tile(tile.values)
                fit = lambda c: (part != part[c]) & (grams >= alike * grams[c]) & (grams[c] >= alike * grams)  # noqa: B023, E731
                left = np.ones(len(node), bool)
                centres = np.flatnonzero(node == least).tolist()
                while left.any() and len(centres) <= CENTRES:
                    bits = np.unpackbits(fp[left].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    middle = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(bits), bitorder="little").view("<u8")[0]
                    far = np.where(left, np.bitwise_count(fp ^ middle), 65)
                    c = int(np.lexsort((node, far))[0])
                    centres.append(c)
                    left &= np.bitwise_count(fp ^ fp[c]) > radius
                    left[c] = False
                for c in dict.fromkeys(centres):
                    other = np.flatnonzero(fit(c) & (np.bitwise_count(fp ^ fp[c]) <= radius))
                    src.append(np.minimum(node[other], node[c]))
                    dst.append(np.maximum(node[other], node[c]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src), pa.int64()), pa.array(np.concatenate(dst), pa.int64())], names=["src", "dst"])

    return work


def agreeing(alike: float) -> int:
    """How many least hashes sets of resemblance ``alike`` share at least: 5.3 standard deviations below the mean."""
    n = BANDS * ROWS
    return int(n * alike - 5.3 * (n * alike * (1 - alike)) ** 0.5)


def _resemble(a: np.ndarray, b: np.ndarray, alike: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= alike * (len(a) + len(b) - both)


def _short_pairs(one: list, two: list, alone: bool, alike: float) -> pa.RecordBatch:
    """Links between the short sets of a tile, or of two: every pair of fitting sizes is decided by its whole sets."""
    src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    (n1, g1, p1, *_, s1), (n2, g2, p2, *_, s2) = one, two
    other = np.flatnonzero(g2 <= SHORT)
    other = other[np.argsort(g2[other], kind="stable")]
    sizes = g2[other]
    for i in np.flatnonzero(g1 <= SHORT).tolist():
        fit = other[np.searchsorted(sizes, alike * g1[i] - 1e-9) : np.searchsorted(sizes, g1[i] / alike + 1e-9, "right")]
        fit = fit[(p2[fit] != p1[i]) & (n2[fit] > n1[i] if alone else True)]
        fit = np.array([j for j in fit.tolist() if _resemble(s1[i], s2[j], alike)], np.int64)
        src.append(np.minimum(n2[fit], n1[i]))
        dst.append(np.maximum(n2[fit], n1[i]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(src), pa.int64()), pa.array(np.concatenate(dst), pa.int64())], names=["src", "dst"])


def _near_pairs(radius: int, alike: float):
    """Links of a tile, or between two: pairs of different components, of fitting sizes, within the radius, that share enough
    least hashes, and whose whole sets resemble each other.  What is compared stays in the tile; only links leave it."""
    enough = agreeing(alike)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tiles, alone in zip(batch.column("tiles"), batch.column("alone").to_pylist(), strict=True):
                sides = []
                for side in tiles.values:
                    node, grams, part, fp = _read_tile(side.values)
                    some = np.frombuffer(b"".join(side.values.field("least_bytes").to_pylist()), np.uint8).reshape(len(node), BANDS * ROWS)
                    order = np.argsort(np.bitwise_count(fp), kind="stable")
                    whole = side.values.field("set")
                    sides.append([*(x[order] for x in (node, grams, part, fp, np.bitwise_count(fp).astype(np.int16), some)), [np.frombuffer(whole[i].as_buffer(), np.uint64) for i in order.tolist()]])
                if not alone and len(sides) < 2:
                    continue
                (n1, g1, p1, f1, c1, b1, s1), (n2, g2, p2, f2, c2, b2, s2) = sides[0], sides[-1]
                yield _short_pairs(sides[0], sides[-1], alone, alike)
                for at in range(0, len(n1), 256):
                    few = slice(at, at + 256)
                    lo, hi = np.searchsorted(c2, [c1[few][0] - radius, c1[few][-1] + radius + 1])
                    near = np.bitwise_count(f1[few, None] ^ f2[None, lo:hi]) <= radius
                    near &= (g1[few, None] > SHORT) | (g2[None, lo:hi] > SHORT)
                    near &= (p1[few, None] != p2[None, lo:hi]) & (g1[few, None] >= alike * g2[None, lo:hi]) & (g2[None, lo:hi] >= alike * g1[few, None])
                    r, c = np.nonzero(near)
                    if alone:
                        once = n1[few][r] < n2[lo:hi][c]
                        r, c = r[once], c[once]
                    shared = [np.zeros(0, bool)]
                    for k in range(0, len(r), 16384):
                        shared.append((b1[few][r[k : k + 16384]] == b2[lo:hi][c[k : k + 16384]]).sum(axis=1) >= enough)
                    r, c = r[np.concatenate(shared)], c[np.concatenate(shared)]
                    same = [_resemble(s1[few.start + i], s2[lo + j], alike) for i, j in zip(r.tolist(), c.tolist(), strict=True)]
                    r, c = r[np.array(same, bool)], c[np.array(same, bool)]
                    src, dst = n1[few][r], n2[lo:hi][c]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(src, dst), pa.int64()), pa.array(np.maximum(src, dst), pa.int64())], names=["src", "dst"])

    return work


def alike_links(documents: DataFrame, nodes: DataFrame, alike: float = ALIKE, tile: int = TILE, radius: int = RADIUS) -> DataFrame:
    """``src, dst``: links of resemblance ``alike`` and more that span every component of ``nodes``."""
    keys = nodes.where("grams > 0").select("node", "grams", "fp", "tie", F.explode("bands").alias("key"))
    counts = materialize(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1"), "alike-keys")
    keys = materialize(keys.join(counts, "key"), "alike-buckets")
    wanted = keys.select("tie").distinct()
    rows = documents.select("text", row_key(documents).alias("tie"))
    sets = rows.join(wanted, "tie", "left_semi").dropDuplicates(["tie"]).select("text").mapInArrow(_sets, "node long, set binary")
    sets = materialize(sets, "alike-sets")
    cuts = F.ceil(F.col("n") / tile)
    keys = keys.select("key", "n", "least", "node", "grams", "fp", cuts.alias("cuts"), F.pmod(F.xxhash64("node"), cuts).alias("cut"), F.col("node").alias("part"))
    member = F.struct("node", "grams", "part", "fp")
    links, least = None, F.min(F.when(F.col("node") == F.col("least"), F.col("node"))).alias("least")
    while True:
        tiles = keys.groupBy("key", "cut").agg(F.collect_list(member).alias("tile"), least)
        pairs = materialize(tiles.select("tile", "least").mapInArrow(_cover(radius, alike), "src long, dst long").distinct(), "alike-centres")
        found = _verified(pairs, sets, alike, "alike-stars")
        if found.isEmpty():
            break
        links = found if links is None else materialize(links.unionByName(found), "alike-links")
        parts = connected_components(links, name="alike-star-parts")
        keys = keys.drop("part").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
        open_keys = keys.groupBy("key").agg((F.min("part") < F.max("part")).alias("mixed")).where("mixed").select("key")
        keys = materialize(keys.join(open_keys, "key", "left_semi"), "alike-mixed")
    few = max(1, tile // 8)  # tiles that hold whole sets are smaller
    cuts = F.ceil(F.col("n") / few)
    keys = keys.withColumns({"cuts": cuts, "cut": F.pmod(F.xxhash64("node"), cuts)}).join(nodes.select("node", "least_bytes"), "node").join(sets, "node")
    tiles = keys.groupBy("key", "cuts", "cut").agg(F.collect_list(F.struct("node", "grams", "part", "fp", "least_bytes", "set")).alias("tile"))
    dealt = tiles.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
    dealt = dealt.groupBy("key", F.least("cut", "with").alias("i"), F.greatest("cut", "with").alias("j")).agg(F.collect_list("tile").alias("tiles"))
    rest = dealt.select("tiles", (F.col("i") == F.col("j")).alias("alone")).mapInArrow(_near_pairs(radius, alike), "src long, dst long")
    rest = materialize(rest.distinct(), "alike-rest")
    return rest if links is None else links.unionByName(rest)


def _firsts(documents: DataFrame, alike: float, tile: int) -> DataFrame:
    """``root, first``: the first row of each distinct set, under the component it is in."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", "text", row_key(documents).alias("tie"))
    marked = materialize(rows.mapInArrow(_marked, f"tie {TIE}, doc_id {kind}, node long, grams long, fp long, least_bytes binary, bands array<long>"), "alike-marks")
    first = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "tie")
    nodes = marked.groupBy("node").agg(F.min(first).alias("first"), F.first("grams").alias("grams"), F.first("fp").alias("fp"), F.first("least_bytes").alias("least_bytes"), F.first("bands").alias("bands"))
    nodes = materialize(nodes.select("node", "first", "grams", "fp", "least_bytes", "bands", F.col("first.tie").alias("tie")), "alike-nodes")
    parts = connected_components(alike_links(documents, nodes, alike, tile), name="alike-parts")
    return nodes.join(parts, "node", "left").select(F.coalesce("component", "node").alias("root"), "first")


def keep_one(documents: DataFrame, alike: float = ALIKE, tile: int = TILE) -> DataFrame:
    """One row of each component of alike documents stays: that of the smallest doc_id, nulls last.

    Only the keys of the rows that stay are left in the shared folder.
    """
    with holding() as written:
        firsts = _firsts(documents, alike, tile)
        ties = materialize(firsts.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.tie").alias("tie")), "alike-kept")
    release(hold(documents.limit(0), [w for w in written if w not in ties._scratch]))
    return rows_of(documents, ties)
