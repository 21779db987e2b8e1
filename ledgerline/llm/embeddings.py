"""Near-duplicate vectors by an inverted multi-index.

Equal vectors are one node with a weight.  Codebooks for the two halves of the unit vectors are fitted on a bounded
sample; their product is the grid of cells, and every vector is indexed in its cell.  A vector visits the cells in the
order of the multi-sequence algorithm (ascending sum of its distances to the two half centroids).  How many cells it
visits is calibrated until ``TARGET`` of the partners of the probes are met: the partners are the links found in the
sample by brute force and vectors made at exactly the wanted cosine from each probe in a random direction, so that the
number does not rest on there being links in the sample.  No number of visits is a limit: where the target asks for it,
all cells are visited.  A link is verified by cosine in double precision.  It is found if either end visits the other's
cell; a member knows its own visits, so each link is counted once for each end.  Cells are cut into tiles by a hash,
pairs of tiles are dealt out, and each returns link counts and a spanning forest, never all pairs.

Vectors of one length are compared with each other only, and each length has an index of its own: the sample is drawn length
by length, in proportion but ``LEAST_SAMPLE`` at least.  A length of no more vectors than that in all is a single cell.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; magnitudes
up to the ends of the double range are scaled before they are squared; null vec_ids come after all others; repeated rows
are vectors of their own, linked with each other; a pair at exactly the cosine is linked; very long vectors are held
whole; an empty table gives an empty result; columns other than vec_id and embedding (labels too) are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.simhash import forest
from ledgerline.plans.components import connected_components
from ledgerline.plans.scratch import materialize

COSINE = 0.9
TARGET = 0.99
#: Bounds of the sample: vectors that fit the codebooks, and those of them that calibrate the visits.
SAMPLE, PROBES, LEAST_SAMPLE = 20_000, 1_000, 256
CELL, MOST_CENTROIDS = 16, 1024
TILE = 1024
LAST = (1 << 63) - 1


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that no square leaves the double range
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors, one, two = [], [], []
        for v in batch.column("embedding"):
            # a null component becomes NaN here
            v = np.array([np.nan if x is None else x for x in v.as_py()], np.float64) if v.is_valid else np.zeros(0)
            top = np.abs(v).max() if len(v) and np.isfinite(v).all() else 0.0
            data = (v + 0.0).tobytes() if top > 0 else None
            vectors.append(data)
            for out, seed in ((one, 0), (two, 1)):
                digest = xxhash.xxh64_intdigest(data, seed) if data else 0
                out.append(digest - (digest >> 63 << 64))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(vectors, pa.binary())], names=["id", "d1", "d2", "vec"])


def _kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd's centroids; an empty cluster takes a point of its own."""
    rng = np.random.default_rng(seed)
    centroids = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        near = _distances(points, centroids).argmin(axis=1)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, points)
        full = counts > 0
        centroids[full] = sums[full] / counts[full, None]
        centroids[~full] = points[rng.integers(0, len(points), int((~full).sum()))]
    return centroids


def _distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (points * points).sum(1)[:, None] - 2 * points @ centroids.T + (centroids * centroids).sum(1)[None]


class MultiIndex:
    """Codebooks of the two halves and the number of cells a vector visits."""

    def __init__(self, sample: np.ndarray, nodes: int, cosine: float, target: float):
        self.half = sample.shape[1] // 2
        k = int(np.clip(round((nodes / CELL) ** 0.5), 1, min(MOST_CENTROIDS, len(sample))))
        self.books = [_kmeans(sample[:, : self.half], k), _kmeans(sample[:, self.half :], k, seed=8)]
        self.k, self.visits = k, 1
        self.visits = self._calibrate(sample, cosine, target)

    def distances(self, vectors: np.ndarray) -> list[np.ndarray]:
        return [_distances(vectors[:, : self.half], self.books[0]), _distances(vectors[:, self.half :], self.books[1])]

    def traverse(self, vectors: np.ndarray, visits: int) -> np.ndarray:
        """The first ``visits`` cells of each vector in multi-sequence order; the first is its own cell.

        The cell of the i-th and j-th nearest centroids has ``i * j`` cells at or before it, so only those with
        ``i * j <= visits`` can be among the first.
        """
        one, two = self.distances(vectors)
        orders = [np.argsort(d, axis=1, kind="stable") for d in (one, two)]
        sides = [np.take_along_axis(d, o, 1) for d, o in zip((one, two), orders, strict=True)]
        pairs = np.array([(i, j) for i in range(min(self.k, visits)) for j in range(min(self.k, visits // (i + 1)))])
        sums = sides[0][:, pairs[:, 0]] + sides[1][:, pairs[:, 1]]
        first = np.argsort(sums, axis=1, kind="stable")[:, :visits]
        rows = np.arange(len(vectors))[:, None]
        return orders[0][rows, pairs[first, 0]] * self.k + orders[1][rows, pairs[first, 1]]

    def _calibrate(self, sample: np.ndarray, cosine: float, target: float) -> int:
        probes = sample[: min(PROBES, len(sample))]
        rows, columns = np.nonzero(probes @ sample.T >= cosine)
        keep = rows != columns
        real = probes[rows[keep]], sample[columns[keep]]
        if len(real[0]) > 8 * PROBES:  # as many of them as keep the lists of visits small
            some = np.random.default_rng(4).permutation(len(real[0]))[: 8 * PROBES]
            real = real[0][some], real[1][some]
        most = 16
        while True:
            most = min(self.k * self.k, 2 * most)
            wanted = [self._visits(a, b, most, target) for a, b in (real, self._made(probes, cosine)) if len(a)]
            if max(wanted) < most or most == self.k * self.k:
                return int(max(wanted, default=0)) + 1

    @staticmethod
    def _made(probes: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
        """The probes, and for each a partner at the given cosine in a random direction."""
        rng = np.random.default_rng(5)
        away = rng.standard_normal(probes.shape)
        away -= (away * probes).sum(1, keepdims=True) * probes
        size = np.sqrt((away * away).sum(1, keepdims=True))
        lean = np.where(size > 1e-9, away / np.maximum(size, 1e-9), 0.0)
        return probes, unit(cosine * probes + np.sqrt(max(0.0, 1 - cosine * cosine)) * lean)

    def _visits(self, one: np.ndarray, two: np.ndarray, most: int, target: float) -> int:
        """The place up to which ``target`` of the pairs meet, in the visits of either end; ``most`` if they do not."""
        ranks = np.full(len(one), most)
        for lo in range(0, len(one), 512):
            a, b = one[lo : lo + 512], two[lo : lo + 512]
            for asker, other in ((a, b), (b, a)):
                hit = self.traverse(asker, most) == self.traverse(other, 1)[:, :1]
                ranks[lo : lo + 512] = np.minimum(ranks[lo : lo + 512], np.where(hit.any(1), hit.argmax(1), most))
        return int(np.sort(ranks)[min(len(ranks) - 1, int(np.ceil(target * len(ranks))))])


def _indexed(indexes: dict[int, MultiIndex]):
    """Visited cells of each vector, its own first; a length without an index has the one cell 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column("vec").to_pylist()
            sizes = np.array([len(v) for v in vecs])
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                for lo in range(0, len(at), 2048):
                    rows = at[lo : lo + 2048]
                    cells = np.zeros((len(rows), 1), np.int32)
                    if size in indexes:
                        vectors = unit(np.frombuffer(b"".join(vecs[i] for i in rows), np.float64).reshape(-1, size // 8))
                        cells = indexes[size].traverse(vectors, indexes[size].visits).astype(np.int32)
                    part = batch.take(pa.array(rows))
                    visits = pa.ListArray.from_arrays(np.arange(0, cells.size + 1, cells.shape[1], dtype=np.int32), pa.array(cells.ravel()))
                    yield pa.RecordBatch.from_arrays([part.column("id"), part.column("weight"), part.column("vec"), visits], names=["id", "weight", "vec", "visits"])

    return work


def _compared(cosine: float):
    def work(table: pa.Table) -> pa.Table:
        asks = np.asarray(table.column("asks"))
        ids, weights = np.asarray(table.column("id")), np.asarray(table.column("weight"))
        vecs = table.column("vec").to_pylist()
        vectors = unit(np.frombuffer(b"".join(vecs), np.float64).reshape(len(vecs), -1))
        q, m = np.flatnonzero(asks), np.flatnonzero(~asks)
        counts = np.zeros(len(ids), np.int64)
        rows, columns = [], []
        if len(q) and len(m):
            visits = np.stack([np.asarray(v) for v in table.column("visits").take(pa.array(m)).to_pylist()])
            homes = np.array([v[0] for v in table.column("visits").take(pa.array(q)).to_pylist()])
            for lo in range(0, len(q), 512):
                part = q[lo : lo + 512]
                near = vectors[part] @ vectors[m].T >= cosine
                near &= ids[part][:, None] != ids[m][None, :]
                counts[part] += near @ weights[m]
                r, c = np.nonzero(near)
                # the member counts this link here unless it visits the asker's cell itself
                silent = ~(visits[c] == homes[lo + r][:, None]).any(axis=1) if len(r) else np.zeros(0, bool)
                np.add.at(counts, m[c[silent]], weights[part[r[silent]]])
                rows.append(part[r])
                columns.append(m[c])
        low = np.unique(ids, return_inverse=True)
        node = root = np.zeros(0, np.int64)
        if rows:
            node, root = forest(low[1][np.concatenate(rows)], low[1][np.concatenate(columns)], len(low[0]))
            node, root = low[0][node], low[0][root]
        linked = np.flatnonzero(counts)
        return pa.table({"id": pa.array(np.concatenate((ids[linked], node)), pa.int64()), "links": pa.array(np.concatenate((counts[linked], np.zeros(len(node), np.int64))), pa.int64()), "root": pa.array([None] * len(linked) + root.tolist(), pa.int64())})

    return work


def _sampled(nodes: DataFrame) -> tuple[dict[int, int], dict[int, list[bytes]]]:
    """Vectors of each length, and a sample of each that has more than ``LEAST_SAMPLE``: those of least digest."""
    sized = nodes.select("d1", "d2", "vec", F.length("vec").alias("bytes"))
    counts = {r["bytes"]: r["n"] for r in sized.groupBy("bytes").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    wanted = {size: max(LEAST_SAMPLE, SAMPLE * n // total) for size, n in counts.items() if n > LEAST_SAMPLE}
    if not wanted:
        return counts, {}
    # digests are uniform: this share of them holds the wanted number with all but certainty
    shares = [(size, min(1.0, (q + 8 * q**0.5 + 64) / counts[size])) for size, q in wanted.items()]
    limits = nodes.sparkSession.createDataFrame(shares, "bytes int, share double")
    near = sized.join(limits, "bytes").where((F.col("d1").cast("double") + 2.0**63) / 2.0**64 <= F.col("share"))
    found: dict[int, list[tuple]] = {}
    for r in near.select("bytes", "d1", "d2", "vec").collect():
        found.setdefault(r["bytes"], []).append((r["d1"], r["d2"], r["vec"]))
    return counts, {size: [v for _, _, v in sorted(some)[: wanted[size]]] for size, some in found.items()}


def _fitted(nodes: DataFrame, cosine: float, target: float) -> dict[int, MultiIndex]:
    """An index for each vector length that has more than ``LEAST_SAMPLE`` vectors."""
    counts, samples = _sampled(nodes)
    return {size: MultiIndex(unit(np.frombuffer(b"".join(some), np.float64).reshape(len(some), -1)), counts[size], cosine, target) for size, some in samples.items()}


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, target: float = TARGET, tile: int = TILE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    rows = embeddings.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(LAST)).alias("id"), "embedding")
    rows = materialize(rows.mapInArrow(_checked, "id long, d1 long, d2 long, vec binary"), "vectors")
    nodes = rows.where("vec IS NOT NULL").groupBy("d1", "d2").agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.first("vec").alias("vec"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")  # vec_ids may be null or repeated
    named = nodes.select("d1", "d2", "id", "node", "weight", F.lit(0).cast("long").alias("links"), F.col("node").alias("component"))
    if not nodes.isEmpty():
        indexes = _fitted(nodes, cosine, target)
        placed = nodes.select(F.col("node").alias("id"), "weight", "vec").mapInArrow(_indexed(indexes), "id long, weight long, vec binary, visits array<int>")
        placed = materialize(placed.withColumn("bytes", F.length("vec")), "vector-cells")
        members = placed.select("bytes", "id", "weight", "vec", "visits", F.col("visits")[0].alias("cell"))
        askers = placed.select("bytes", "id", "weight", "vec", F.slice("visits", 1, 1).alias("visits"), F.explode("visits").alias("cell"))
        cuts = placed.select("bytes", F.explode("visits").alias("cell"), F.lit(1).alias("ask"), F.lit(0).alias("own")).unionByName(placed.select("bytes", F.col("visits")[0].alias("cell"), F.lit(0).alias("ask"), F.lit(1).alias("own")))
        cuts = cuts.groupBy("bytes", "cell").agg(F.ceil(F.sum("ask") / tile).alias("ask_cuts"), F.ceil(F.sum("own") / tile).alias("own_cuts")).where("own_cuts > 0")
        cuts = materialize(cuts, "vector-cuts")
        deal = F.xxhash64("id")
        members = members.join(cuts, ["bytes", "cell"]).withColumn("own", F.pmod(deal, "own_cuts")).withColumn("ask", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ask_cuts") - 1)))
        askers = askers.join(cuts, ["bytes", "cell"]).withColumn("ask", F.pmod(deal, "ask_cuts")).withColumn("own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("own_cuts") - 1)))
        columns = ["bytes", "cell", "own", "ask", "id", "weight", "vec", "visits"]
        both = members.select(*columns, F.lit(False).alias("asks")).unionByName(askers.select(*columns, F.lit(True).alias("asks")))
        found = both.groupBy("bytes", "cell", "own", "ask").applyInArrow(_compared(cosine), "id long, links long, root long")
        found = materialize(found, "vector-links")
        parts = connected_components(found.where("root IS NOT NULL").select(F.col("id").alias("src"), F.col("root").alias("dst")), name="vector-parts")
        links = found.groupBy(F.col("id").alias("node")).agg(F.sum("links").alias("found_links"))
        named = nodes.select("d1", "d2", "id", "node", "weight").join(links, "node", "left").join(parts, "node", "left")
        named = named.select("d1", "d2", "id", "node", "weight", F.coalesce("found_links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("part"))
        named = materialize(named, "vector-parted")
        least = named.groupBy("part").agg(F.min("id").alias("component"))
        named = named.join(least, "part").drop("part")
    named = materialize(named.drop("id", "node"), "vector-named")
    out = rows.alias("r").join(named.withColumn("linkable", F.lit(True)).alias("n"), ["d1", "d2"], "left")
    own = F.coalesce("linkable", F.lit(False)) & F.col("vec").isNotNull()
    out = out.select("id", F.when(own, F.col("weight") - 1 + F.col("links")).otherwise(0).cast("long").alias("n_links"), F.when(own, F.col("component")).otherwise(F.col("id")).alias("component_id"))
    named_id = F.when(F.col("id") != LAST, F.col("id"))
    return out.select(named_id.alias("vec_id"), "n_links", F.when(F.col("component_id") != LAST, F.col("component_id")).alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept"))
