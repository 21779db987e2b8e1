"""SimHash near-duplicates: tiles of fingerprints compared exactly with numpy exclusive-or and bit counts.

Equal fingerprints are one node.  Two fingerprints within the radius ``r`` agree on at least ``a`` of ``r + a`` bit
blocks, so every choice of ``a`` blocks is a bucket key and each pair meets in some bucket; ``a`` grows with the number
of fingerprints so that buckets keep their size.  A bucket is one tile.  A bucket above ``TILE`` fingerprints is cut
by bit count and a hash into many tiles, and each pair of tiles whose bit counts lie within the radius is a row of its
own, so no bucket lands in one task.  A compared pair of tiles returns a spanning forest of its links, never all pairs.

Defined cases: null and wordless texts have fingerprint zero and are linked like any other; null doc_ids never name a
component while another id can; a bit that half of the hashes set is 0; repeated rows share their component; a very long
text is hashed in steps, by one task that holds it; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.words import raw, slices
from ledgerline.plans.components import connected_components
from ledgerline.plans.scratch import materialize

BITS = 64
SHINGLE = 4
RADIUS = 4
TILE = 2048


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = 42) -> int:
    """Majority vote of the bits of all shingle hashes, repeats included; ASCII capitals are folded."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        few = [digest(line[s:e], seed) for s, e in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)]
        ones += np.unpackbits(np.array(few, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = np.array([fingerprint(t) for t in raw(batch)], np.uint64).view(np.int64)
        rest = [i for i, name in enumerate(batch.schema.names) if name != "text"]
        yield pa.RecordBatch.from_arrays([batch.column(i) for i in rest] + [pa.array(found)], names=[batch.schema.names[i] for i in rest] + ["fp"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed 64-bit integer."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(_fingerprints, f"doc_id {kind}, fp long")


def _blocks(count: int) -> list[tuple[int, int]]:
    cuts = [BITS * i // count for i in range(count + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def agreeing_blocks(nodes: int, radius: int, wanted: int = 64) -> int:
    """The least number of agreeing blocks whose key is long enough for buckets of ``wanted`` fingerprints."""
    agree = 1
    while agree < 4 and nodes >> (BITS * agree // (radius + agree)) > wanted:
        agree += 1
    return agree


def forest(rows: np.ndarray, columns: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Each linked node with the smallest node of its component, by label propagation over the given links."""
    label = np.arange(nodes)
    while True:
        low = np.minimum(label[rows], label[columns])
        new = label.copy()
        np.minimum.at(new, rows, low)
        np.minimum.at(new, columns, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(nodes))
    return moved, label[moved]


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the radius inside ``left``, or between ``left`` and ``right``, as a spanning forest."""
    left = left[np.argsort(np.bitwise_count(left), kind="stable")]
    right = left if right is None else right[np.argsort(np.bitwise_count(right), kind="stable")]
    same = right is left
    lc, rc = np.bitwise_count(left).astype(np.int16), np.bitwise_count(right).astype(np.int16)
    rows, columns = [], []
    step = 256
    for i in range(0, len(left), step):
        a = left[i : i + step]
        # only the columns whose bit count can lie within the radius
        lo, hi = np.searchsorted(rc, [lc[i] - radius, lc[min(i + step, len(left)) - 1] + radius + 1])
        lo = max(lo, i) if same else lo
        for j in range(lo, hi, step):
            near = np.bitwise_count(a[:, None] ^ right[None, j : min(hi, j + step)]) <= radius
            r, c = np.nonzero(near)
            rows.append(r + i)
            columns.append(c + j)
    if not rows:
        return left[:0], left[:0]
    rows, columns = np.concatenate(rows), np.concatenate(columns)
    if same:
        far = rows < columns
        node, root = forest(rows[far], columns[far], len(left))
        return left[node], left[root]
    both = np.concatenate((left, right))
    node, root = forest(rows, columns + len(left), len(both))
    return both[node], both[root]


def _linked(radius: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst = [], []
            for tiles, alone in zip(batch.column("tiles"), batch.column("alone").to_pylist(), strict=True):
                flat = tiles.values
                parts = [np.asarray(flat[k].values).view(np.uint64) for k in range(len(flat))]
                if len(parts) == 1 and alone:
                    s, d = tile_links(parts[0], None, radius)
                elif len(parts) == 2:
                    s, d = tile_links(parts[0], parts[1], radius)
                else:
                    continue
                src.append(s)
                dst.append(d)
            none = np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *src]).view(np.int64)), pa.array(np.concatenate([none, *dst]).view(np.int64))], names=["src", "dst"])

    return work


def links(nodes: DataFrame, count: int, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``src, dst``: for each bucket a spanning forest of the fingerprints within the radius of each other."""
    agree = agreeing_blocks(count, radius)
    blocks = _blocks(radius + agree)

    def key(choice: tuple[tuple[int, int], ...]):
        return F.xxhash64(*[F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << width) - 1)) for lo, width in choice])

    choices = list(combinations(blocks, agree))
    buckets = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), key(c).alias("key")) for i, c in enumerate(choices)]))
    rows = nodes.select("fp", F.bit_count("fp").alias("ones"), buckets.alias("b")).select("fp", "ones", "b.choice", "b.key")
    counts = rows.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1")
    counts = materialize(counts, "simhash-buckets")
    large = counts.where(F.col("n") > tile)
    hot = large.select("choice", "key", F.ceil(F.col("n") / tile).alias("cuts"))
    none = F.lit(0)
    tiles = rows.join(hot, ["choice", "key"], "left").withColumn("cut", F.coalesce(F.pmod(F.xxhash64("fp", F.lit(7)), F.col("cuts")), none))
    tiles = tiles.withColumn("ones", F.when(F.col("cuts").isNull(), none).otherwise(F.col("ones")))
    tiles = tiles.groupBy("choice", "key", "ones", "cut", "cuts").agg(F.collect_list("fp").alias("tile"))
    small = tiles.where("cuts IS NULL AND size(tile) > 1").select(F.array("tile").alias("tiles"), F.lit(True).alias("alone"))
    near = F.explode(F.sequence(F.col("ones") - radius, F.col("ones") + radius))
    cut_up = tiles.where("cuts IS NOT NULL").withColumn("with_ones", near).withColumn("with_cut", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
    me, other = F.struct(F.col("ones").alias("o"), F.col("cut").alias("c")), F.struct(F.col("with_ones").alias("o"), F.col("with_cut").alias("c"))
    pairs = cut_up.groupBy("choice", "key", F.least(me, other).alias("first"), F.greatest(me, other).alias("second")).agg(F.collect_list("tile").alias("tiles"))
    pairs = pairs.select("tiles", (F.col("first") == F.col("second")).alias("alone"))
    return small.unionByName(pairs).mapInArrow(_linked(radius), "src long, dst long")


def _rooted(prints: DataFrame, radius: int, tile: int) -> DataFrame:
    """``fp, least_id, root`` for each fingerprint: the root is the smallest fingerprint of its component."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-nodes")
    edges = links(nodes, nodes.count(), radius, tile)
    parts = connected_components(edges, name="simhash-parts")
    named = nodes.join(parts, nodes.fp == parts.node, "left").select("fp", "least_id", F.coalesce("component", "fp").alias("root"))
    return materialize(named, "simhash-named")


def near_duplicates(documents: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``doc_id, fp, component_id``: the smallest doc_id reachable through links of at most ``radius`` bits."""
    prints = materialize(fingerprints(documents), "simhash-prints")
    named = _rooted(prints, radius, tile)
    roots = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = materialize(named.join(roots, "root").select("fp", "component_id"), "simhash-components")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


TIE = "struct<a:bigint,b:bigint>"


def row_key(documents: DataFrame) -> Column:
    """Two hashes of all columns, 128 bits in all, nulls told apart: only equal rows share them."""
    columns = [F.col(f"`{c}`") for c in documents.columns]
    both = [*columns, *[c.isNull() for c in columns]]
    return F.struct(F.xxhash64(*both).alias("a"), F.xxhash64(F.lit("row"), *both).alias("b"))


def rows_of(documents: DataFrame, ties: DataFrame) -> DataFrame:
    """The rows whose key is in ``ties``; of equal rows one."""
    rows = documents.select(F.struct("*").alias("row"), row_key(documents).alias("tie"))
    return rows.join(ties, "tie", "left_semi").dropDuplicates(["tie"]).select("row.*")
