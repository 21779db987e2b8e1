"""Format conversations with a compiled template, mark what is generated, and read the formatted text back.

A conversation is formatted by one task that holds one message at a time; its formatted text leaves in chunks of about
``CHUNK`` characters that end between pieces, so its length is bounded by no buffer.  Each chunk has its loss spans.

Defined cases: null text is empty; a null role is the empty role; a null conv_id is a conversation of its own; turns
with one number are ordered by role and text, repeated rows repeat; null turns come first; an empty table gives an
empty result; columns other than conv_id, turn, role and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.templates import compile_template, unescape
from ledgerline.plans.scratch import materialize

TEMPLATE = (
    "{% set open = '<|im_' + 'start|>' %}{% for m in messages %}{{ open }}{{ m.role | escape_line }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "<|im_end|>{% endfor %}"
)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
CHUNK = 1 << 16
CHUNKS = "conv_id long, chunk long, text string, loss array<struct<start:int,end:int>>"


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(n).to_pylist() for n in names], strict=True)


def _chunks(template: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "chunk", "text", "loss"])

        done, size = [], 0
        for conv, turns in groupby(_rows(batches, "conv_id", "role", "text"), key=lambda r: r[0]):
            number, text, at, loss = 0, [], 0, []
            for piece, counts in render({"role": role or "", "text": said or ""} for _, role, said in turns):
                if at and at + len(piece) > CHUNK:
                    done.append((conv, number, "".join(text), loss))
                    number, text, at, loss = number + 1, [], 0, []
                    size += CHUNK
                if counts:
                    loss.append({"start": at, "end": at + len(piece)})
                text.append(piece)
                at += len(piece)
                if size > 64 * CHUNK:
                    yield batch(done)
                    done, size = [], 0
            done.append((conv, number, "".join(text), loss))
            size += at
        if done:
            yield batch(done)

    return work


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """``conv_id, chunk, text, loss``: a conversation's formatted text is its chunks in order."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(_chunks(template), CHUNKS)


class Reader:
    """Reads the turns of one formatted conversation back, chunk by chunk, and digests them."""

    def __init__(self):
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.all, self.loss, self.rest = hashlib.sha256(), hashlib.sha256(), ""

    def feed(self, text: str, loss: list[dict]) -> None:
        self.chars += len(text)
        for span in loss:
            said = unescape(text[span["start"] : span["end"]])
            self.loss_chars += len(said)
            self.loss.update(said.encode("utf-8", "surrogatepass"))
        self.rest += text
        while (end := self.rest.find(CLOSE)) >= 0:
            turn, self.rest = self.rest[:end], self.rest[end + len(CLOSE) :]
            if not turn.startswith(OPEN):
                raise ValueError("a turn does not begin with its mark")
            role, _, said = turn[len(OPEN) :].partition("\n")
            self.turns += 1
            self.all.update(f"{unescape(role)}\n{unescape(said)}\n".encode("utf-8", "surrogatepass"))

    def row(self, conv) -> tuple:
        if self.rest:
            raise ValueError("a turn is not closed")
        return conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    done = []
    for conv, chunks in groupby(_rows(batches, "conv_id", "text", "loss"), key=lambda r: r[0]):
        reader = Reader()
        for _, text, loss in chunks:
            reader.feed(text, loss)
        done.append(reader.row(conv))
        if len(done) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
            done = []
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)


def read_back(chunks: DataFrame) -> DataFrame:
    """Digests of each conversation, from its formatted chunks alone."""
    rows = chunks.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").select("conv_id", "text", "loss")
    return rows.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and one more, -1, whose texts hold control strings."""
    said = "</s>[INST] ok [/INST]"
    probe = conversations.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


def formatted(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """The formatted conversations as a written table."""
    return materialize(format_conversations(conversations, template), "chat")
