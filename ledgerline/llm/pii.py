"""Personal data: exact patterns, and identifiers found by bootstrapped contextual extraction.

The spans of the exact patterns are seeds, and so are words of publicly known secret forms (keys with a fixed prefix, values
assigned to a name such as password or token); the latter are seeds alone and never spans by themselves.  Each seed and each
other word that holds a digit is an occurrence of an instance (its text) in lexical patterns: the two words before it with the
instance's shape, the name it is assigned to with its form, its first signs with its form, and for long mixed words the form
alone.  Patterns and instances form a bipartite graph; each round scores a pattern by the mean score of its distinct
instances and an instance by the noisy-or of its good patterns, with seeds fixed at one.  What stands in patterns that end
above ``CONFIDENT`` with enough distinct instances becomes a span of the kind ``found``, a secret seed or not.

Defined cases: null text is empty; repeated rows are scanned each for itself but count once as evidence; patterns that tie
at a bound are taken; contexts and shapes are read whole, however long their words; a very long text is scanned whole, by
one task that holds it; null doc_ids are rows like any other; an empty table gives an empty result; other columns are
carried or ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.words import slices
from ledgerline.plans.scratch import materialize

KINDS = ("email", "ip", "card", "phone", "found")
ROUNDS = 3
#: A pattern is good from this score on while scoring, and its occurrences are spans from ``CONFIDENT`` on.
GOOD, CONFIDENT = 0.6, 0.8
SUPPORT = 3
LEAST_CHARS = 5
#: Words of this length and more have the patterns of their first signs and of their form alone.
LONG_WORD, AFFIX = 16, 4

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_BLANKS = " \t\n\v\f\r"
_EDGES = "\"'()[]{}<>,.;:!?"
#: Names to which secrets are assigned, and public key formats.
_SECRET_NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey", "access_key")
_SECRET_HINT = re.compile("|".join(_SECRET_NAMES), re.IGNORECASE | re.ASCII)
_ASSIGNED = re.compile(r"""[ ]?[=:][ ]?["']?([^\s"']{8,})""")
_KEY_HINTS = ("AKIA", "ghp_")
_KEYS = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36})(?![A-Za-z0-9])")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """The checksum of card numbers: every second digit from the right is doubled, with its digits added."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    # from each @ outwards, so that a long run without one is passed once
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
            done = m.end()
        at = text.find("@", at + 1)


def exact_spans(text: str) -> list[Span]:
    """Spans of the exact patterns by start, then kind."""
    spans = list(_emails(text))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                spans.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    spans.append(("phone", m.start(), m.end()))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def secret_spans(text: str, spans: list[Span]) -> list[Span]:
    """Words of known secret forms that touch none of ``spans``."""
    found = [m.span() for m in _KEYS.finditer(text)] if any(h in text for h in _KEY_HINTS) else []
    for m in _SECRET_HINT.finditer(text):
        value = _ASSIGNED.match(text, m.end())
        if value and any(c.isdigit() for c in value[1]):
            found.append(value.span(1))
    taken = sorted((s, e) for _, s, e in spans)
    out, k, done = [], 0, 0
    for start, end in sorted(set(found)):
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if start >= done and not (k < len(taken) and taken[k][0] < end):
            out.append(("secret", start, end))
            done = end
    return out


def shape(instance: str) -> str:
    """Letters become a, digits 9, runs are written once."""
    out = []
    for c in instance:
        c = "9" if c.isdigit() else "a" if c.isalpha() else c
        if not out or out[-1] != c:
            out.append(c)
    return "".join(out)


def form(instance: str) -> str:
    """The kinds of signs in the instance, whatever their order, and its length."""
    kinds = {"9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in instance}
    return f"{''.join(sorted(kinds))}{len(instance)}"


def _word_before(text: str, at: int) -> tuple[int, int]:
    """The bounds of the last word that ends at or before ``at``."""
    while at and text[at - 1] in _BLANKS:
        at -= 1
    end = at
    while at and text[at - 1] not in _BLANKS:
        at -= 1
    return at, end


def _masked(word: str) -> str:
    return re.sub(r"[0-9]+", "9", word.lower())


def assigned_to(text: str, start: int) -> str:
    """The name and sign of assignment before ``start``, quotes and blanks between them left out; empty if there is none."""
    at = start
    while at and text[at - 1] in "\"'":
        at -= 1
    while at and text[at - 1] in " \t":
        at -= 1
    if not at or text[at - 1] not in "=:":
        return ""
    sign, at = text[at - 1], at - 1
    while at and text[at - 1] in " \t":
        at -= 1
    end = at
    while at and text[at - 1] not in _BLANKS and text[at - 1] not in _EDGES and text[at - 1] != "=":
        at -= 1
    return f"{text[at:end].lower()}{sign}" if at < end else ""


def patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns of the instance at ``start .. end``."""
    entity = text[start:end]
    one, two = _word_before(text, start), (0, 0)
    if one[1] > one[0]:
        two = _word_before(text, one[0])
    near, far = (_masked(text[s:e]) for s, e in (one, two))
    out = [f"before\n{far} {near}\n{shape(entity)}"] if near else []
    name = assigned_to(text, start)
    if name:
        out.append(f"lead\n{name}\n{form(entity)}")
    if len(entity) >= LONG_WORD:
        if not _DIGIT.search(entity, 0, AFFIX):
            out.append(f"affix\n{entity[:AFFIX]}\n{form(entity)}")
        if any(map(str.isalpha, entity)):
            out.append(f"form\n{form(entity)}")
    return out


def _other_words(text: str, spans: list[Span]) -> Iterator[tuple[int, int]]:
    """Words with a digit that touch no span, without the punctuation around them."""
    k = done = 0
    for m in _DIGIT.finditer(text):
        at = m.start()
        if at < done:
            continue
        start, end = at, at
        while start > done and text[start - 1] not in _BLANKS:
            start -= 1
        while end < len(text) and text[end] not in _BLANKS:
            end += 1
        done = end
        while k < len(spans) and spans[k][2] <= start:
            k += 1
        if any(s[1] < end and s[2] > start for s in spans[k : k + 4]):
            continue
        while start < end and text[start] in _EDGES:
            start += 1
        while end > start and text[end - 1] in _EDGES:
            end -= 1
        value = max(text.rfind("=", start, end), text.rfind(":", start, end)) + 1
        if value and end - value >= LEAST_CHARS and _DIGIT.search(text, value, end):
            start = value
            while start < end and text[start] in _EDGES:
                start += 1
        if end - start >= LEAST_CHARS:
            yield start, end


def occurrences(text: str, spans: list[Span], secrets: list[Span]) -> list[tuple[int, int, int, int, bool, bool]]:
    """``start, end, pattern, instance, seed, exact`` of every seed and other word, once for each pattern around it."""
    known = sorted(spans + secrets, key=lambda s: s[1])
    places = [(s, e, True, True) for _, s, e in spans] + [(s, e, True, False) for _, s, e in secrets] + [(s, e, False, False) for s, e in _other_words(text, known)]
    out = []
    for start, end, seed, exact in places:
        instance = _digest(text[start:end])
        out += [(start, end, _digest(p), instance, seed, exact) for p in patterns(text, start, end)]
    return out


def _digest(x: str) -> int:
    d = xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"))
    return d - (d >> 63 << 64)


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_SEEN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("pattern", pa.int64()), ("instance", pa.int64()), ("seed", pa.bool_()), ("exact", pa.bool_())]))
SPANS_TYPE = "array<struct<kind:string,start:bigint,end:bigint>>"


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        spans, seen = [], []
        for text in batch.column("text").to_pylist():
            found = exact_spans(text or "")
            spans.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
            seen.append([dict(zip(_SEEN.value_type.names, o, strict=True)) for o in occurrences(text or "", found, secret_spans(text or "", found))])
        rest = [i for i, name in enumerate(batch.schema.names) if name != "text"]
        yield pa.RecordBatch.from_arrays([batch.column(i) for i in rest] + [pa.array(spans, _SPANS), pa.array(seen, _SEEN)], names=[batch.schema.names[i] for i in rest] + ["spans", "seen"])


def confident_patterns(seen: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``pattern, score`` of the patterns that end confident, from rows ``pattern, instance, seed``."""
    links = materialize(seen.groupBy("pattern", "instance").agg(F.max(F.col("seed").cast("double")).alias("seed")), "pii-links")
    fixed = links.groupBy("instance").agg(F.max("seed").alias("seed"))
    scores = fixed.withColumn("score", F.col("seed"))
    patterns = None
    for _ in range(rounds):
        rated = links.select("pattern", "instance").join(scores.select("instance", "score"), "instance")
        patterns = rated.groupBy("pattern").agg(F.avg("score").alias("score"), F.count("*").alias("support")).where((F.col("support") >= SUPPORT) & (F.col("score") >= GOOD))
        patterns = materialize(patterns, "pii-patterns")
        doubt = links.select("pattern", "instance").join(patterns.select("pattern", "score"), "pattern").groupBy("instance").agg(F.product(1 - F.col("score")).alias("doubt"))
        scores = fixed.join(doubt, "instance", "left").select("instance", "seed", F.greatest("seed", 1 - F.coalesce("doubt", F.lit(1.0))).alias("score"))
        scores = materialize(scores, "pii-instances")
    return patterns.where(F.col("score") >= CONFIDENT).select("pattern", "score")


def find(documents: DataFrame, keep: tuple[str, ...] = (), rounds: int = ROUNDS) -> DataFrame:
    """One row a document: ``doc_id``, exact ``spans`` and the ``found`` ones; ``keep`` names columns carried as ``kept_*``."""
    kinds = "".join(f", kept_{c} {documents.schema[c].dataType.simpleString()}" for c in keep)
    rows = documents.select("doc_id", "text", *[F.col(c).alias(f"kept_{c}") for c in keep])
    kind = documents.schema["doc_id"].dataType.simpleString()
    seen_type = "array<struct<start:bigint,end:bigint,pattern:bigint,instance:bigint,seed:boolean,exact:boolean>>"
    scanned = rows.mapInArrow(_scanned, f"doc_id {kind}{kinds}, spans {SPANS_TYPE}, seen {seen_type}")
    scanned = materialize(scanned.withColumn("row", F.monotonically_increasing_id()), "pii-scanned")
    seen = scanned.where(F.size("seen") > 0).select("row", F.explode("seen").alias("o")).select("row", "o.*")
    good = confident_patterns(seen.select("pattern", "instance", "seed"), rounds)
    found = seen.where(~F.col("exact")).join(good, "pattern").groupBy("row").agg(F.collect_set(F.struct(F.lit("found").alias("kind"), "start", "end")).alias("found"))
    none = F.expr(f"cast(array() as {SPANS_TYPE})")
    rows = scanned.drop("seen").join(found, "row", "left")
    return rows.withColumn("found", F.coalesce("found", none)).drop("row")


def joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    ordered = F.array_sort(F.transform(spans, _placed))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _placed(span: Column) -> Column:
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), span["kind"])
    return F.struct(span["start"].alias("start"), order.alias("order"), span["end"].alias("end"), span["kind"].alias("kind"))


def _redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out = []
        for text, spans in zip(batch.column("kept_text").to_pylist(), batch.column("all_spans").to_pylist(), strict=True):
            if not spans:
                out.append(text)
                continue
            parts, done = [], 0
            for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                if s["end"] <= done:
                    continue
                if s["start"] >= done:
                    parts += [text[done : s["start"]], f"[{s['kind'].upper()}]"]
                done = s["end"]
            out.append("".join([*parts, text[done:]]))
        rest = [i for i, name in enumerate(batch.schema.names) if name not in ("all_spans", "kept_text")]
        yield pa.RecordBatch.from_arrays([batch.column(i) for i in rest] + [pa.array(out, pa.string())], names=[batch.schema.names[i] for i in rest] + ["kept_text"])


def redact(documents: DataFrame) -> DataFrame:
    """The documents with every span replaced by the name of its kind; ``n_chars`` follows the text."""
    others = tuple(c for c in documents.columns if c not in ("doc_id", "text"))
    rows = find(documents, keep=(*others, "text")).select("doc_id", *[f"kept_{c}" for c in others], F.concat("spans", "found").alias("all_spans"), "kept_text")
    kinds = "".join(f", kept_{c} {documents.schema[c].dataType.simpleString()}" for c in others)
    done = rows.mapInArrow(_redacted, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}{kinds}, kept_text string")
    if "n_chars" in others:
        done = done.withColumn("kept_n_chars", F.char_length("kept_text").cast(documents.schema["n_chars"].dataType))
    return done.select(*[F.col(c) if c == "doc_id" else F.col(f"kept_{c}").alias(c) for c in documents.columns])
