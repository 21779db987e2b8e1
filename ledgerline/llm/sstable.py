"""Token ids in sorted-string-table shards: files that a binary search can look a document up in.

A shard holds the documents of one key range in ascending order, about ``SHARD_BYTES`` of text.  Its records are written
by Spark's text sink, so they reach any file system Spark knows and a lost task leaves nothing half written; the sink ends
each record with one byte.  File names are in key order and each footer holds its shard's first and last key, so a lookup
reads the footers of a binary search over the files, then one index, one Bloom filter and one block, by ranges.

record   := data block | index | Bloom filter | footer, each followed by one byte 0x0A
block    := entries, about ``BLOCK`` bytes; entry := u8 shared key bytes, u8 further key bytes, u32 ids, key bytes, ids
key      := 0x00 and the doc_id, big endian with its sign bit flipped; 0x01 for null, so that it comes last
index    := per block: u8 key length, first key, u64 offset, u32 size
footer   := u64 index offset, u32 index size, u64 Bloom offset, u32 Bloom size, u64 documents, u64 ids, u8 id bytes,
            first and last key (9 bytes each, filled up with zeros), magic

Defined cases: null and empty texts hold the end id alone; rows of one doc_id are entries of their own, ordered by a hash
of the text, and may lie in several shards, so that no doc_id is one task; a null doc_id comes last; a very long text is
one entry of a longer block; an empty table gives an empty file and an empty result; other columns are not looked at.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.tokens import encoder, id_bytes, vocabulary
from ledgerline.llm.words import sized, texts
from ledgerline.plans.scratch import materialize, scratch_root, table_bytes

BLOCK = 1 << 16
SHARD_BYTES = 64 << 20
BITS_PER_KEY, PROBES = 10, 7
END = 0
MAGIC = b"LLSST002"
_ENTRY, _FOOTER, _AT = struct.Struct("<BBI"), struct.Struct("<QIQIQQB9s9s8s"), struct.Struct("<QI")


def key_of(doc_id: int | None) -> bytes:
    return b"\x01" if doc_id is None else b"\x00" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key == b"\x01" else int.from_bytes(key[1:], "big") - (1 << 63)


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh64_intdigest(key)
    step = (h >> 32) | 1
    return [(h + i * step) % bits for i in range(PROBES)]


class ShardWriter:
    """Turns entries in key order into the records of one shard."""

    def __init__(self, width: int):
        self.least = b""
        self.width, self.block, self.last, self.size = width, bytearray(), b"", 0
        self.index, self.hashes, self.documents, self.ids, self.opened = bytearray(), [], 0, 0, b""

    def add(self, key: bytes, ids: np.ndarray) -> bytes | None:
        """Takes one entry; returns a block when one is full."""
        done = self._close() if len(self.block) >= BLOCK else None
        if not self.block:
            self.opened = key
            self.least = self.least or key
        shared = 0
        while self.block and shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
            shared += 1
        self.block += _ENTRY.pack(shared, len(key) - shared, len(ids)) + key[shared:] + ids.astype(f"<u{self.width}").tobytes()
        self.last, self.documents, self.ids = key, self.documents + 1, self.ids + len(ids)
        self.hashes.append(key)
        return done

    def _close(self) -> bytes:
        block = bytes(self.block)
        self.index += bytes([len(self.opened)]) + self.opened + _AT.pack(self.size, len(block))
        self.size += len(block) + 1
        self.block = bytearray()
        return block

    def finish(self) -> list[bytes]:
        """The last block, index, Bloom filter and footer."""
        out = [self._close()] if self.block else []
        bloom = np.zeros(max(8, -(-len(self.hashes) * BITS_PER_KEY // 8)), np.uint8)
        at = np.array([p for k in self.hashes for p in _probes(k, len(bloom) * 8)], np.int64)
        np.bitwise_or.at(bloom, at >> 3, (1 << (at & 7)).astype(np.uint8))
        index, bloom = bytes(self.index), bloom.tobytes()
        foot = _FOOTER.pack(self.size, len(index), self.size + len(index) + 1, len(bloom), self.documents, self.ids, self.width, self.least, self.last, MAGIC)
        return [*out, index, bloom, foot]


class Shard:
    """One shard behind ``read(offset, size)``: scan in key order, or look one document up."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read = read
        foot = _FOOTER.unpack(read(size - _FOOTER.size - 1, _FOOTER.size))
        if foot[-1] != MAGIC:
            raise ValueError("not a shard")
        self.index_at, self.index_size, self.bloom_at, self.bloom_size, self.documents, self.ids, self.width = foot[:7]
        self.first, self.last = (k[:1] if k[:1] == b"\x01" else k for k in foot[7:9])

    @classmethod
    def of(cls, content: bytes) -> Shard:
        return cls(lambda at, size: content[at : at + size], len(content))

    def blocks(self) -> tuple[list[bytes], list[tuple[int, int]]]:
        """The sparse index: each block's first key, and where it lies."""
        index, at, keys, places = self.read(self.index_at, self.index_size), 0, [], []
        while at < len(index):
            n = index[at]
            keys.append(index[at + 1 : at + 1 + n])
            places.append(_AT.unpack_from(index, at + 1 + n))
            at += 1 + n + _AT.size
        return keys, places

    def _entries(self, at: int, size: int) -> Iterator[tuple[bytes, np.ndarray]]:
        block, at, key = self.read(at, size), 0, b""
        while at < size:
            shared, more, n = _ENTRY.unpack_from(block, at)
            at += _ENTRY.size
            key = key[:shared] + block[at : at + more]
            yield key, np.frombuffer(block, f"<u{self.width}", n, at + more)
            at += more + n * self.width

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for place in self.blocks()[1]:
            for key, ids in self._entries(*place):
                yield id_of(key), ids

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each entry of this document: Bloom filter, then the sparse index, then one block (or its ties)."""
        key = key_of(doc_id)
        bloom = self.read(self.bloom_at, self.bloom_size)
        if not all(bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, len(bloom) * 8)):
            return []
        keys, places = self.blocks()
        span = places[max(0, bisect.bisect_left(keys, key) - 1) : bisect.bisect_right(keys, key)]
        return [ids for place in span for k, ids in self._entries(*place) if k == key]


def _records(path: str, end: int, width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = encoder(path, True).encode_all, ShardWriter(width)
        for batch in sized(batches):
            out = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(texts(batch)), strict=True):
                out.append(shard.add(key_of(doc_id), np.append(ids, np.uint32(end))))
            yield pa.RecordBatch.from_arrays([pa.array([b for b in out if b is not None], pa.binary())], names=["record"])
        if shard.documents:
            yield pa.RecordBatch.from_arrays([pa.array(shard.finish(), pa.binary())], names=["record"])

    return work


def write_shards(documents: DataFrame, path: str, tokenizer: str, end: int = END, width: int | None = None, shard_bytes: int = SHARD_BYTES) -> None:
    """Writes the ids of all documents under ``path``, one shard to each key range; file names are in key order.

    ``width`` is the bytes of an id, by default as many as the tokenizer's ids need.
    """
    order = [F.col("doc_id").asc_nulls_last(), F.col("mark")]
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(parts, -(-table_bytes(rows, "text") // shard_bytes))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    records = rows.mapInArrow(_records(tokenizer, end, width or id_bytes(tokenizer)), "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def _number(file: str) -> int:
    return int(file.split("-")[1])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            content = content.as_py()
            if not content:
                continue
            number, before, rows = _number(path.rpartition("/")[2]), 0, []
            for doc_id, ids in Shard.of(content).scan():
                rows.append((number, doc_id, before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                before += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["shard", "doc_id", "before", "n_tokens", "ids_crc32"])


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every entry, read from the shards under ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    rows = materialize(files.mapInArrow(_digests, "shard int, doc_id long, before long, n_tokens long, ids_crc32 long"), "shard-digests")
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return rows.join(bases, "shard").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def _opened(spark: SparkSession, path: str) -> list[Callable[[], Shard]]:
    """The shards under ``path`` in key order, each opened when it is called; ranges are read through Spark's file systems."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [f for f in system.listStatus(where) if f.getPath().getName().startswith("part-") and f.getLen()]

    def shard(status) -> Shard:
        def read(at: int, size: int) -> bytes:
            stream = system.open(status.getPath())
            try:
                stream.seek(at)
                return bytes(stream.readNBytes(size))
            finally:
                stream.close()

        return Shard(read, status.getLen())

    return [partial(shard, f) for f in sorted(files, key=lambda f: _number(f.getPath().getName()))]


def lookup(spark: SparkSession, path: str, doc_ids: list[int | None]) -> DataFrame:
    """``doc_id, ids`` for a short list of documents, each found by binary search: shard, block, entry."""
    files, shards, found = _opened(spark, path), {}, []

    def at(i: int) -> Shard:
        if i not in shards:
            shards[i] = files[i]()
        return shards[i]

    for doc_id in doc_ids:
        key = key_of(doc_id)
        i = bisect.bisect_left(range(len(files)), key, key=lambda i: at(i).last)
        while i < len(files) and at(i).first <= key:
            found += [(doc_id, ids.astype(np.int64).tolist()) for ids in at(i).get(doc_id)]
            i += 1
    return spark.createDataFrame(found, "doc_id long, ids array<bigint>")


def shard_path(spark: SparkSession) -> str:
    """A new folder for shards in the session's shared folder."""
    return f"{scratch_root(spark)}/shards-{uuid.uuid4().hex}"


def default_tokenizer() -> str:
    return vocabulary("byte_bpe_50k.json")
