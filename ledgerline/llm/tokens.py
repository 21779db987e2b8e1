"""Token ids of whole texts with a public tokenizer, memoised by word.

Both supported vocabularies cut a text at blanks before they look for merges, so a text's ids are those of its words in
order.  Many texts are split at once and their distinct words named by Arrow; the signs behind a word of letters are a
unit of their own for both vocabularies, so each distinct word (with the blank before it) and each distinct run of signs
goes through the tokenizers library once and is kept in a bounded table.  A text with any other white space than blanks
and line ends, or with an added token's string in it, is encoded as a whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ledgerline.llm.words import spread

#: Words kept per worker.  A full table stays as it is while it serves; after as many further words as it holds
#: times four it is emptied, so that it follows a change of language.
KEPT_WORDS = 600_000
#: Characters of the texts that are split at once.
CHUNK = 1 << 22
#: All white space of Unicode but blank and line end, with the four separators that Python also counts.
_ODD = [chr(c) for c in (*range(9, 10), *range(11, 14), *range(28, 32), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)]
_WITH_BLANKS = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: Put before blanks and line ends to split there; one of ``_ODD``, so no text that is split holds it.
_EDGE = chr(28)
#: Signs that may follow a word; not the apostrophe, which begins endings.
_STOPS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
#: Letters that end in a mark once they are composed and lower-cased; what follows belongs to the mark.
_ENDS_IN_MARK = "".join(c for c in map(chr, range(128, 0x30000)) if c.isalpha() and not unicodedata.normalize("NFC", c).lower().isalpha())

#: Byte-level vocabularies write printable bytes as they are and the others as the signs from 256 on, in order.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_SIGNS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_SIGNS = np.array([_BYTE_SIGNS.get(b, b) for b in range(256)], "<u2")


class Encoder:
    """Ids of texts by the tokenizer file ``path``; ``blanks`` says whether its tokens hold blanks."""

    def __init__(self, path: str, blanks: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # strings that the library takes for one token wherever they stand; a text that holds one is encoded as a whole
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.blanks = blanks
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.passed = 0
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _normal(self, units: list[str]) -> list[str]:
        """The units by the library's normalizer, which leaves the one blank between two of them."""
        if not all(units):
            return [self.library.normalizer.normalize_str(u) for u in units]
        normal = self.library.normalizer.normalize_str(" ".join(units)).split(" ")
        return normal if len(normal) == len(units) else [self.library.normalizer.normalize_str(u) for u in units]

    def _ids(self, units: list[str]) -> tuple[list[int], np.ndarray]:
        """Ids of all units, one after the other, and how many each has.  Letters with at most one blank before are one unit for the merges, which the library's
        model then gets alone, without the line end before; any other unit takes the whole way."""
        merge, ids, ends = self.library.model.tokenize, [], [0]
        if self.blanks:
            line_end = self.library.encode("\n", add_special_tokens=False).ids
            rests = [u[1:] if u[:1] == "\n" else u for u in units]
            letters = [(r[1:] if r[:1] == " " else r).isalpha() for r in rests]
        else:
            rests = self._normal(units)
            letters = [r.isalpha() for r in rests]
        joined = "\n".join([r for r, only in zip(rests, letters, strict=True) if only]).encode()
        signs = iter(_SIGNS[np.frombuffer(joined, np.uint8)].tobytes().decode("utf-16-le").split(chr(_BYTE_SIGNS[10])))
        for unit, rest, only in zip(units, rests, letters, strict=True):
            if not only:
                ids += self.library.encode(unit, add_special_tokens=False).ids
            else:
                if self.blanks and rest is not unit:
                    ids += line_end
                ids += [t.id for t in merge(next(signs))]
            ends.append(len(ids))
        return ids, np.diff(ends)

    def _learn(self, units: list[str]) -> np.ndarray:
        """Places of new units; those beyond ``KEPT_WORDS`` lie there until the next call."""
        ids, lengths = self._ids(units)
        n, total, ends = len(self.place), len(ids), self.used + np.cumsum(lengths)
        while len(self.flat) < self.used + total:
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while len(self.starts) < n + len(units):
            self.starts, self.lengths = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.lengths))
        self.flat[self.used : self.used + total] = ids
        self.lengths[n : n + len(units)] = lengths
        self.starts[n : n + len(units)] = ends - lengths
        kept = min(len(units), max(0, KEPT_WORDS - n))
        if kept:
            self.used = int(ends[kept - 1])
            self.place.update(zip(units[:kept], range(n, n + kept), strict=True))
        self.passed += len(units) - kept
        return np.arange(n, n + len(units))

    def _places(self, units: list[str]) -> np.ndarray:
        """The place of each of some distinct units."""
        if self.passed > 4 * KEPT_WORDS:
            self._clear()
        at = np.fromiter(map(self.place.get, units, repeat(-1)), np.int64, len(units))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            at[missing] = self._learn([units[i] for i in missing.tolist()])
        return at

    def _distinct(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some distinct words, one after the other, and how many each has."""
        letters = pc.ascii_rtrim(words, characters=_STOPS)
        alone = pc.utf8_is_alpha(pc.ascii_ltrim(letters, characters=" \n")).to_numpy(zero_copy_only=False)
        if not self.blanks:
            alone &= ~pc.match_substring_regex(letters, f"[{_ENDS_IN_MARK}]").to_numpy(zero_copy_only=False)
        cut = pc.binary_length(letters).to_numpy()
        _, bounds, data = words.buffers()
        bounds = np.frombuffer(bounds, np.int64)[words.offset : words.offset + len(words) + 1]
        # each word is two units of the same bytes: its letters and the signs behind, or all of it and nothing
        edges = np.repeat(bounds, 2)[:-1]
        edges[1::2] = np.where(alone, bounds[:-1] + cut, bounds[1:])
        units = pa.LargeStringArray.from_buffers(2 * len(words), pa.py_buffer(edges), data or pa.py_buffer(b"")).dictionary_encode()
        at = self._places(units.dictionary.to_numpy(zero_copy_only=False).tolist())[units.indices.to_numpy()]
        lengths = self.lengths[at]
        return self.flat[spread(self.starts[at], lengths)], lengths[::2] + lengths[1::2]

    def _encoded(self, lists: pa.ListArray) -> Iterator[np.ndarray]:
        """Ids of each list of words."""
        words = lists.flatten().dictionary_encode()
        ids, sizes = self._distinct(words.dictionary)
        codes = words.indices.to_numpy()
        lengths, starts = sizes[codes], (np.cumsum(sizes) - sizes)[codes]
        ids = ids[spread(starts, lengths)]
        ends = np.concatenate(([0], np.cumsum(lengths)))[lists.offsets.to_numpy()].tolist()
        return (ids[lo:hi] for lo, hi in zip(ends, ends[1:], strict=False))

    def _split(self, texts: list[str]) -> pa.ListArray:
        """Words of each text; where blanks belong to tokens, each word with the one before it."""
        found = pa.array(texts, pa.large_string())
        if not self.blanks:
            return pc.split_pattern(pc.replace_substring(found, "\n", " "), " ")
        for blank in " \n":
            found = pc.replace_substring(found, blank, _EDGE + blank)
        return pc.split_pattern(found, _EDGE)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        plain: list[int] = []
        apart: list[int] = []
        for i, text in enumerate(texts):
            if any(map(text.__contains__, _ODD)) or any(map(text.__contains__, self.added)):
                out[i] = np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
            elif self.blanks and (text[-1:] in (" ", "\n") or any(map(text.__contains__, ("  ", " \n", "\n ", "\n\n")))):
                apart.append(i)
            elif text:
                plain.append(i)
        for at in _chunks(plain, texts):
            for i, ids in zip(at, self._encoded(self._split([texts[i] for i in at])), strict=True):
                out[i] = ids
        # blanks in a row belong together
        for at in _chunks(apart, texts):
            lists = pa.array([_WITH_BLANKS.findall(texts[i]) for i in at], pa.list_(pa.large_string()))
            for i, ids in zip(at, self._encoded(lists), strict=True):
                out[i] = ids
        return out

    def encode(self, text: str) -> np.ndarray:
        """As ``encode_all``, for one text."""
        return self.encode_all([text])[0]


def _chunks(at: list[int], texts: list[str]) -> Iterator[list[int]]:
    """The texts at these places in runs of about ``CHUNK`` characters; a longer text is a run of its own."""
    run: list[int] = []
    size = 0
    for i in at:
        if run and size + len(texts[i]) > CHUNK:
            yield run
            run, size = [], 0
        run.append(i)
        size += len(texts[i])
    if run:
        yield run


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, blanks: bool) -> Encoder:
    """The worker's encoder for this file; workers are reused, and so are its words."""
    key = (path, blanks)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, blanks)
    return _ENCODERS[key]


def id_bytes(path: str) -> int:
    """Bytes that hold any id of this file."""
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()
    return 2 if max(ids, default=0) < 1 << 16 else 4


def vocabulary(name: str) -> str:
    """The place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
