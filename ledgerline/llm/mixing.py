"""Mix sources to target weights by Sainte-Laguë apportionment of equal-token blocks.  DataFrame functions only.

Sizes are words.  Each source is cut into shards by a seeded hash of ``doc_id``; a shard's votes are its part of the
source's target.  All sources and shards compete for one fixed number of blocks of ``block_words``: the highest quotients
``votes / (2 k + 1)`` win, and no shard wins more blocks than ``cap`` times those it has.  The winners are found by the
divisor at which the rounded votes use up all blocks: each round of the search is one aggregation that counts the blocks
at many divisors at once, so nothing is ranked in one task; only exact ties at the last quotient are, by source and shard.

Inside a shard the documents stand in seeded order and their words form one stream of blocks.  Each whole round over the
shard's blocks takes every block once more; the rest of the quota takes the first blocks in seeded order.

Defined cases: null text has size 0; a null source is a source of its own and comes last; null doc_ids are documents
like any other; repeated rows each count and each get their own part; documents that tie in the seeded order follow each
other by size; a very long text is one document of many blocks, cut at its taken words; an empty table gives an empty
result; columns other than doc_id, text and source are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.words import WORD
from ledgerline.plans.scratch import materialize

WEIGHTS = (5, 2, 1)
SEED = 20240
BLOCK_WORDS = 16
SHARD_WORDS = 1 << 18


def _hash32(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """``source, source_size, target``: ``share`` of all words split by weight, no source above ``cap`` times its size.

    Water filling: with sources ordered by the level at which they reach their cap, the level is the first one that
    spreads what the capped sources leave without passing the next cap.  One row a source.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").isNull(), "source")
    sums = sums.withColumn("place", F.row_number().over(place))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    sums = sums.withColumn("weight", weight).withColumn("full_at", cap * F.col("source_size") / F.col("weight"))
    up = Window.orderBy("full_at", "place")
    everything = Window.partitionBy()
    level = (F.col("words") - F.coalesce(F.sum(cap * F.col("source_size")).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing))
    sums = sums.withColumn("words", share * F.sum("source_size").over(everything)).withColumn("level", level)
    sums = sums.withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "place", "level"))).over(everything)["level"])
    return sums.select("source", "source_size", F.least(cap * F.col("source_size"), F.col("level") * F.col("weight")).alias("target"))


def _blocks_at(divisor: float | Column) -> Column:
    return F.least("most", F.floor(F.col("votes") / F.lit(divisor) + F.lit(0.5)))


def last_divisors(parties: DataFrame, blocks: int, points: int = 16) -> tuple[float, float]:
    """Divisors ``low <= high`` with at least and at most ``blocks`` blocks won; equal where one fits exactly."""
    low, high = parties.agg(F.min(F.col("votes") / (F.col("most") + 1)), 3 * F.max("votes")).first()
    while True:
        grid = [low * (high / low) ** (k / (points + 1)) if high > 2 * low else low + (high - low) * k / (points + 1) for k in range(1, points + 1)]
        grid = sorted({d for d in grid if low < d < high})
        if not grid:
            return low, high
        won = list(parties.agg(*[F.sum(_blocks_at(d)).alias(f"b{i}") for i, d in enumerate(grid)]).first())
        if blocks in won:
            exact = grid[won.index(blocks)]
            return exact, exact
        low = max([low, *[d for d, n in zip(grid, won, strict=True) if n > blocks]])
        high = min([high, *[d for d, n in zip(grid, won, strict=True) if n < blocks]])


def sainte_lague(parties: DataFrame, blocks: int) -> DataFrame:
    """``source, shard, quota`` from ``source, shard, votes, most``: ``blocks`` go to the highest quotients."""
    if not blocks:
        return parties.select("source", "shard", F.lit(0).cast("long").alias("quota"))
    low, high = last_divisors(parties, blocks)
    quotas = parties.select("source", "shard", _blocks_at(high).cast("long").alias("quota"), _blocks_at(low).cast("long").alias("next"))
    if low == high:
        return quotas.drop("next")
    left = blocks - quotas.agg(F.sum("quota")).first()[0]
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source", "shard"))
    ties = quotas.where("next > quota").select("source", "shard", "next", place.alias("place"))
    ties = ties.where(F.col("place") <= left).select(F.col("source").alias("s"), F.col("shard").alias("h"), F.lit(1).alias("more"))
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("h"))
    return quotas.join(ties, same, "left").select("source", "shard", (F.col("quota") + F.coalesce("more", F.lit(0))).alias("quota"))


def apportion(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: its size, its source's size and target, its shard and the shard's quota, words ``taken``.

    ``rounds`` is how often the whole document is taken and ``extra`` how many of its first words once more;
    ``taken = rounds * size + extra``.  ``keep`` names further columns, carried as ``kept_*``; they take no part in the
    apportionment and are joined back by row.
    """
    who = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    sizes = documents.select("doc_id", "source", *[F.col(c).alias(f"kept_{c}") for c in keep], F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.md5(who).alias("turn"), _hash32(who).alias("deal"))
    sizes = materialize(sizes.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
    targets = source_targets(sizes, weights, share, cap)
    docs = sizes.select("row", "doc_id", "source", "size", "turn", "deal").alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.*", "t.source_size", "t.target")
    docs = docs.withColumn("shard", F.pmod("deal", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(shard_words)))))
    docs = materialize(docs.drop("deal"), "mix-dealt")
    parties = docs.groupBy("source", "shard", "source_size", "target").agg(F.sum("size").alias("shard_size")).where("shard_size > 0")
    parties = parties.withColumn("votes", F.col("target") * F.col("shard_size") / F.col("source_size")).withColumn("blocks", F.ceil(F.col("shard_size") / F.lit(block_words)))
    parties = materialize(parties.withColumn("most", F.floor(F.lit(cap) * F.col("blocks"))).where("votes > 0"), "mix-parties")
    wanted = parties.agg(F.floor(F.coalesce(F.sum("votes"), F.lit(0.0)) / block_words + 0.5)).first()[0]
    quotas = sainte_lague(parties, int(wanted)).withColumnRenamed("source", "s").withColumnRenamed("shard", "h")
    won = parties.join(quotas, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("h"))).select("s", "h", "quota", "blocks")
    docs = docs.join(won, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("h")), "left").drop("s", "h")
    docs = docs.withColumn("quota", F.coalesce("quota", F.lit(0))).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    stream = Window.partitionBy("source", "shard").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("start", F.coalesce(F.sum("size").over(stream), F.lit(0)))
    docs = docs.withColumn("rounds", F.expr("quota div blocks")).withColumn("cut", (F.col("quota") % F.col("blocks")) * block_words)
    docs = docs.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), "cut") - F.least("start", "cut")))
    docs = docs.withColumn("taken", F.col("rounds") * F.col("size") + F.col("extra"))
    columns = ("size", "source_size", "target", "shard", "quota", "rounds", "extra", "taken")
    if keep:
        docs = sizes.select("row", *[f"kept_{c}" for c in keep]).join(docs, "row")
    return docs.select("doc_id", "source", *[f"kept_{c}" for c in keep], *columns)


def mix(documents: DataFrame, **options) -> DataFrame:
    """The mixed documents: every document as often as it is taken, the last copy cut to its taken words.

    Same columns as ``documents``; ``n_chars`` follows the text.  A document of no words is not taken.
    """
    columns = documents.columns
    others = tuple(c for c in columns if c not in ("doc_id", "source"))
    docs = apportion(documents, keep=others, **options)
    copies = F.col("rounds") + (F.col("extra") > 0).cast("long")
    docs = docs.where(copies > 0).where("size > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    whole = (F.col("copy") <= F.col("rounds")) | (F.col("extra") == F.col("size"))
    cut = F.array_join(F.slice(F.regexp_extract_all("kept_text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("extra").cast("int")), " ")
    docs = docs.withColumn("kept_text", F.when(whole, F.col("kept_text")).otherwise(cut))
    if "n_chars" in columns:
        docs = docs.withColumn("kept_n_chars", F.char_length("kept_text").cast(documents.schema["n_chars"].dataType))
    return docs.select(*[F.col(f"kept_{c}").alias(c) if c in others else F.col(c) for c in columns])


MIX_SQL = rf"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         md5('{SEED}|' || coalesce(doc_id::VARCHAR, 'null')) AS turn FROM documents),
placed AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM sizes GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][((place - 1) % 3 + 1)::INTEGER] AS weight FROM placed),
filled AS (
  SELECT *, 2.0::DOUBLE * source_size / weight AS full_at, 1.5::DOUBLE * sum(source_size) OVER () AS words FROM weighed),
levels AS (
  SELECT *, (words - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY full_at, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY full_at, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM filled),
levelled AS (
  SELECT (SELECT lev FROM levels WHERE lev <= full_at ORDER BY full_at, place LIMIT 1) AS lev0),
targets AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, lev0 * weight) AS target FROM filled, levelled),
dealt AS (
  SELECT s.*, t.source_size, t.target,
         (('0x' || substr(turn, 1, 8))::BIGINT) % greatest(1, ceil(t.source_size / {SHARD_WORDS}))::BIGINT AS shard
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
streams AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source, shard ORDER BY turn, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
         (sum(size) OVER (PARTITION BY source, shard))::BIGINT AS shard_size FROM dealt),
parties AS (
  SELECT source, shard, shard_size, target * shard_size / source_size AS votes, ceil(shard_size / {BLOCK_WORDS})::BIGINT AS blocks
  FROM (SELECT DISTINCT source, shard, shard_size, source_size, target FROM streams WHERE shard_size > 0)),
quotients AS (
  SELECT source, shard, blocks, row_number() OVER (ORDER BY votes / (2 * k + 1) DESC, source IS NULL, source, shard) AS place
  FROM parties, unnest(generate_series(0, 2 * blocks - 1)) AS u(k)),
won AS (
  SELECT source, shard, blocks, count(*) AS quota FROM quotients
  WHERE place <= (SELECT floor(sum(votes) / {BLOCK_WORDS} + 0.5) FROM parties) GROUP BY ALL),
cuts AS (
  SELECT s.*, coalesce(w.quota, 0) AS quota, coalesce(w.blocks, 1) AS blocks, (coalesce(w.quota, 0) % coalesce(w.blocks, 1)) * {BLOCK_WORDS} AS cut
  FROM streams s LEFT JOIN won w ON s.source IS NOT DISTINCT FROM w.source AND s.shard = w.shard)
SELECT doc_id, size, source_size, target,
       (quota // blocks) * size + greatest(0, least(start + size, cut) - least(start, cut)) AS taken
FROM cuts
"""
