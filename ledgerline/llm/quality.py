"""Quality rules whose thresholds adapt to each language and source through mergeable quantile sketches.

The sketch of a ratio is a log-linear histogram with integer bucket bounds (relative error 1/16): two sketches merge
by adding counts, so it is a plain grouped sum, computed partially before the shuffle and equal on every rerun.
A group's sketch is shrunk towards its language's and that one towards the sketch of all documents: ``prior`` documents
of the parent are merged in, whatever the group's size.  The fence of a ratio is ``q' + spread * (q - median) + reach *
(tail - q)``: ``q`` is the quantile up to which a group is trusted, ``q'`` the upper bound of its bucket, ``tail`` the quantile
of the group's far end, so that a ratio most documents lack is judged by how far the group's odd documents go.  A document is
rejected when its count lies above the fence times its length by more than ``noise`` standard deviations of counting, so that
neither a short document is judged by one sign nor a long one by a few.

Defined cases: null text has no words and fails; null languages and sources are groups of their own; equal ratios lie
in one bucket, and a document on its fence stays; repeated rows are judged alike and count each; a very long text is
measured whole, by one task that holds it; an empty table gives an empty result; other columns are carried or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.words import slices
from ledgerline.plans.scratch import materialize

SYMBOLS = "#*$%&|<>"
RUN = 8
#: For each ratio: its count, its whole, and the share of a group's documents that is trusted.
METRICS = {
    "symbol_ratio": ("n_symbols", "word_chars", 0.8), "capital_ratio": ("n_capitals", "word_chars", 0.98), "line_ratio": ("n_dup_lines", "n_lines", 0.98),
    "stutter_ratio": ("n_stutters", "n_words", 0.9), "repeat_ratio": ("n_repeat_words", "n_words", 0.99),
}
SPREAD = 1.0
#: The far end of a group, and the part of the way to it that a fence goes.
TAIL = 0.98
REACH = 0.1
NOISE = 3.0
PRIOR = 25.0
MIN_WORDS = 20
MAX_REPEAT = 30


def repeated_words(words: list[bytes], run: int = RUN) -> int:
    """Words inside a window of ``run`` words that occurs at least twice in ``words``."""
    n = len(words) - run + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    # a window's number is exact: pairs of numbers are renumbered, doubling the width each time
    width, keys = 1, ids
    while width < run:
        step = min(width, run - width)
        pairs = keys[: len(keys) - step] * np.int64(len(words) + 1) + keys[step:]
        keys = np.unique(pairs, return_inverse=True)[1]
        width += step
    twice = np.bincount(keys)[keys] > 1
    if not twice.any():
        return 0
    at = np.flatnonzero(twice)
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + run, -1)
    return int((np.cumsum(marks) > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    """The ``MEASURES`` of one whole text."""
    words = text.encode("utf-8", "surrogatepass").split()
    blanks = sum(map(text.count, " \t\n\v\f\r"))
    lines = [line for line in text.split("\n") if line.strip(" \t\v\f\r")]
    capitals = sum(map(str.isupper, text)) if text.lower() != text else 0
    return len(words), len(text) - blanks, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines), capitals, sum(map(eq, words, words[1:]))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_stutters")


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [measure(t or "") for t in batch.column("text").to_pylist()]
        columns = list(zip(*rows, strict=True)) or [[]] * len(MEASURES)
        rest = [i for i, name in enumerate(batch.schema.names) if name != "text"]
        yield pa.RecordBatch.from_arrays([batch.column(i) for i in rest] + [pa.array(c, pa.int64()) for c in columns], names=[batch.schema.names[i] for i in rest] + list(MEASURES))


def measures(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    rows = documents.select("doc_id", "lang", "source", "text", *[F.col(c).alias(f"kept_{c}") for c in keep])
    kept = "".join(f", kept_{c} {documents.schema[c].dataType.simpleString()}" for c in keep)
    kinds = ", ".join(f"{c} {documents.schema[c].dataType.simpleString()}" for c in ("doc_id", "lang", "source"))
    return rows.mapInArrow(_measured, f"{kinds}{kept}, " + ", ".join(f"{m} long" for m in MEASURES))


def _width(value: Column) -> Column:
    """Width of the value's bucket: one below 32, then 16 buckets to each power of two."""
    return F.pow(F.lit(2), F.greatest(F.lit(0), F.length(F.bin(value)) - 5)).cast("long")


def bucket_floor(value: Column) -> Column:
    """Lower bound of the value's bucket."""
    return value - F.pmod(value, _width(value))


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def _quantile(share: Column) -> Column:
    return F.min(F.when(F.col("upto") >= F.col("total") * share, F.col("bucket")))


def fences(measured: DataFrame, spread: float = SPREAD, prior: float = PRIOR) -> DataFrame:
    """``lang, source, metric, fence`` (in thousandths) from the shrunken sketch of each language and source,
    over the documents that pass the base rules."""
    judged = measured.where(~_base_failed())
    mille = {m: F.expr(f"(1000 * {part}) div greatest(1, {whole})") for m, (part, whole, _) in METRICS.items()}
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(METRICS[m][2]).alias("trusted"), v.alias("value")) for m, v in mille.items()]))
    sketch = judged.select("lang", "source", pairs.alias("p")).select("lang", "source", "p.metric", "p.trusted", bucket_floor(F.col("p.value")).alias("bucket"))
    fine = sketch.groupBy("lang", "source", "metric", "trusted", "bucket").agg(F.count("*").cast("double").alias("weight"))
    fine = materialize(fine, "quality-sketch")

    def shares(df: DataFrame, keys: list[str]) -> DataFrame:
        merged = df.groupBy(*keys, "metric", "bucket").agg(F.sum("weight").alias("weight"))
        return merged.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy(*keys, "metric"))).drop("weight")

    def shrunk(df: DataFrame, keys: list[str], parent: DataFrame, parent_keys: list[str]) -> DataFrame:
        groups = df.select(*keys, "metric", "trusted").distinct().alias("g")
        same = F.col("g.metric") == F.col("p.metric")
        for k in parent_keys:
            same &= F.col(f"g.{k}").eqNullSafe(F.col(f"p.{k}"))
        lent = groups.join(parent.alias("p"), same).select("g.*", "p.bucket", (prior * F.col("p.share")).alias("weight"))
        both = df.select(*keys, "metric", "trusted", "bucket", "weight").unionByName(lent)
        return both.groupBy(*keys, "metric", "trusted", "bucket").agg(F.sum("weight").alias("weight"))

    by_lang = fine.groupBy("lang", "metric", "trusted", "bucket").agg(F.sum("weight").alias("weight"))
    by_lang = shares(shrunk(by_lang, ["lang"], shares(fine, []), []), ["lang"])
    group = Window.partitionBy("lang", "source", "metric")
    merged = shrunk(fine, ["lang", "source"], by_lang, ["lang"])
    merged = merged.withColumn("upto", F.sum("weight").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("total", F.max("upto").over(group))
    found = merged.groupBy("lang", "source", "metric").agg(_quantile(F.lit(0.5)).alias("median"), _quantile(F.col("trusted")).alias("top"), _quantile(F.lit(TAIL)).alias("tail"))
    fence = F.col("top") + _width(F.col("top")) + spread * (F.col("top") - F.col("median")) + REACH * (F.greatest("tail", "top") - F.col("top"))
    return found.select("lang", "source", "metric", fence.alias("fence"))


def _judged(measured: DataFrame, limits: DataFrame, noise: float) -> DataFrame:
    wide = limits.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("metric", "fence"))).alias("limits"))
    rows = measured.alias("m").join(wide.alias("w"), F.col("m.lang").eqNullSafe(F.col("w.lang")) & F.col("m.source").eqNullSafe(F.col("w.source")), "left").select("m.*", "w.limits")

    def above(metric: str, part: str, whole: str) -> Column:
        expected = F.try_element_at("limits", F.lit(metric)) * F.col(whole) / 1000
        return F.when(F.col(part) > expected + noise * F.sqrt(expected + 1), F.lit(metric))

    broken = F.array_compact(F.array(*[above(m, part, whole) for m, (part, whole, _) in METRICS.items()]))
    rows = rows.withColumn("base_failed", _base_failed()).withColumn("broken", broken)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0)).drop("limits")


def judge(documents: DataFrame, keep: tuple[str, ...] = (), spread: float = SPREAD, noise: float = NOISE, prior: float = PRIOR) -> DataFrame:
    """One row a document: its measures, ``base_failed``, ``kept`` and ``broken``, the ratios above their fence."""
    measured = materialize(measures(documents, keep), "quality")
    return _judged(measured, fences(measured, spread, prior), noise)


def keep_good(documents: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns; measured twice, so that no text is written in between."""
    others = tuple(c for c in documents.columns if c not in ("doc_id", "lang", "source"))
    limits = materialize(fences(measures(documents)), "quality-fences")
    rows = _judged(measures(documents, others), limits, NOISE).where("kept")
    return rows.select(*[F.col(c) if c not in others else F.col(f"kept_{c}").alias(c) for c in documents.columns])
