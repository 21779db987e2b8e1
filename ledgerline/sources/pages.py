"""Rows from pages, posts and JSON columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blocks(pages: DataFrame, pattern: str) -> DataFrame:
    """Each match of the pattern's group with its place on the page."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("pos", "block"))


def fields(pages: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """One column for each pattern's first group."""
    return pages.select("page_id", *[F.regexp_extract("html", p, 1).alias(n) for n, p in patterns.items()])


def split_posts(pages: DataFrame, opening: str) -> DataFrame:
    """The text from each opening mark to the next."""
    parts = F.split("html", opening)
    return pages.select("page_id", F.posexplode(F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 1))).alias("pos", "post"))


def mentions(posts: DataFrame, pattern: str, width: int) -> DataFrame:
    """Each distinct mention with the text from its first place on."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    return posts.withColumn("word", F.explode(words)).withColumn("context", F.expr(f"substr(text, locate(word, text), {width})"))


def pipe_rows(documents: DataFrame) -> DataFrame:
    """Lines with pipes as arrays of cells, with their line number."""
    lines = documents.where(F.col("text").contains("|")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.where(F.col("line").contains("|")).select("doc_id", (F.col("n") + 1).alias("n"), F.split("line", r"\|").alias("cells"))


def clip_between(rows: DataFrame, names: str, first: Column, last: Column) -> DataFrame:
    """The stretch of an ordered list between two of its entries, turned round where they stand the other way."""
    i, j = F.array_position(names, first), F.array_position(names, last)
    low, high = F.least(i, j).cast("int"), F.greatest(i, j).cast("int")
    part = F.slice(names, low, high - low + 1)
    return rows.withColumn("clipped", F.when(i <= j, part).otherwise(F.reverse(part)))


def epoch_seconds(raw: Column) -> Column:
    """Seconds from a number that is seconds or milliseconds; seconds stay below 1e10."""
    return F.when(raw < 10_000_000_000, raw).otherwise(F.floor(raw / 1000)).cast("long")


def coordinates(rows: DataFrame, column: str) -> DataFrame:
    """``lat`` and ``lon`` from one text; null where either is no number."""
    parts = F.split(column, ",")
    return rows.withColumns({"lat": parts[0].try_cast("double"), "lon": parts[1].try_cast("double")})


BOARD = "departures array<struct<train:string,station:string,time:bigint>>, arrivals array<struct<train:string,station:string,time:bigint>>"


def board_rows(rows: DataFrame, column: str, key: str) -> DataFrame:
    """``key, side, train, station, seconds`` of a station board in JSON: its departures and its arrivals, one row a call.

    Times are epoch seconds or milliseconds, told apart by their size; a missing list has no rows.
    """
    board = rows.select(key, F.from_json(column, BOARD).alias("b"))
    side = lambda name, label: board.select(key, F.lit(label).alias("side"), F.explode(f"b.{name}").alias("c"))
    both = side("departures", "departure").unionByName(side("arrivals", "arrival"))
    return both.select(key, "side", "c.train", "c.station", epoch_seconds(F.col("c.time")).alias("seconds"))
