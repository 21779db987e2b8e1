"""Words and per-batch helpers used by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: A word is a run of bytes other than space and the controls 9 to 13; ``bytes.split`` cuts at these six bytes too.
WORD = r"[^\x20\x09-\x0D]+"


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Whole texts of a batch; null is the empty text."""
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def raw(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """As ``texts``, in UTF-8."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in short slices, so that a worker holds few texts as objects at a time."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)
    _give_back()


def sized(batches: Iterator[pa.RecordBatch], size: int = 1 << 22, column: str = "text") -> Iterator[pa.RecordBatch]:
    """As ``slices``, of at most ``size`` bytes of text each; a longer text is a slice of its own."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(batch):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
            yield batch.slice(at, end - at)
            at = end
    _give_back()


def _give_back() -> None:
    """Workers are reused, so what a task has freed goes back to the system when its rows end."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes of all ranges ``[start, start + length)``, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)



def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LANES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
#: Longer words are hashed one by one.
LONG_WORD = 128


class Words:
    """The words of some documents as hashes, with each document's first word and number of words.

    A word's hash passes its bytes eight at a time through the finaliser, so that it is no sum of its bytes.
    """

    def __init__(self, docs: list[bytes], hashes: int = 1):
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        data = b"\n".join(docs) + b"\n" + bytes(8)
        text = np.frombuffer(data, np.uint8)[:-8]
        blank = _BLANK[text]
        edge = np.diff(np.concatenate(([True], blank)).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        begins = np.cumsum(sizes + 1) - (sizes + 1)
        self.first = np.searchsorted(starts, begins)
        self.count = np.diff(np.append(self.first, len(starts)))
        self.total = len(starts)
        eight = np.ndarray((len(text),), "<u8", data, strides=(1,))
        lengths = ends - starts
        self.starts, self.ends = starts, ends
        self.hashes = [lengths.astype(np.uint64) * k for k in _LANES[:hashes]]
        at, left, short = np.flatnonzero(lengths <= LONG_WORD), 0, None
        while len(at):
            lane = eight[starts[at] + left]
            short = lengths[at] - left
            lane = np.where(short < 8, lane & ((np.uint64(1) << (np.uint64(8) * np.minimum(short, 7).astype(np.uint64))) - np.uint64(1)), lane)
            for h, k in zip(self.hashes, _LANES, strict=False):
                h[at] = mixed((h[at] ^ lane) * k + k)
            left += 8
            at = at[short > 8]
        for i in np.flatnonzero(lengths > LONG_WORD).tolist():
            word = data[starts[i] : ends[i]]
            for seed, h in enumerate(self.hashes):
                h[i] = xxhash.xxh64_intdigest(word, seed)


def pieces(docs: list[bytes], chunk: int = 500_000) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``chunk`` bytes together; a longer document is a range of its own."""
    at, size = 0, 0
    for i, d in enumerate(docs):
        if size and size + len(d) > chunk:
            yield at, i
            at, size = i, 0
        size += len(d)
    if at < len(docs):
        yield at, len(docs)
