"""Write side of the ledger: unpivot, append, merge, cache, prune, version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unpivot_update(updates: DataFrame) -> DataFrame:
    """Up to six typed events of one update; an absent value or column gives no event.

    Reads ``event_id, run_id, occurred_at, public_status, delay_min, forecast_arrival, forecast_departure, station, platform``.
    """
    values = {"movement_status": "public_status", "delay_update": "delay_min", "forecast_arrival": "forecast_arrival", "forecast_departure": "forecast_departure", "station_report": "station", "platform_update": "platform"}
    events = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.struct(F.lit(kind).alias("type"), F.col(c).cast("string").alias("detail"))) for kind, c in values.items() if c in updates.columns]))
    rows = updates.select("event_id", "run_id", "occurred_at", F.explode(events).alias("e"))
    return rows.select(F.concat_ws(":", F.col("event_id").cast("string"), "e.type").alias("ledger_id"), "run_id", "occurred_at", F.col("e.type").alias("type"), F.col("e.detail").alias("detail"))


def latest(rows: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """The newest row of each key."""
    order = Window.partitionBy(*keys).orderBy(F.col(time).desc(), F.col(tie).desc())
    return rows.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def last_wins(rows: DataFrame, key: str, order: Column) -> DataFrame:
    place = Window.partitionBy(key).orderBy(order.desc())
    return rows.withColumn("_place", F.row_number().over(place)).where("_place = 1").drop("_place")


def append_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of ``new`` whose key is not in ``old``, one of each key: the least by all columns, so that reruns agree."""
    least = new.groupBy(key).agg(F.min(F.struct(*[c for c in new.columns if c != key])).alias("_r"))
    return least.join(old.select(key), key, "left_anti").select(key, "_r.*").select(*new.columns)


def upsert(old: DataFrame, new: DataFrame, key: str, newest: list[str], largest: list[str], first: list[str]) -> DataFrame:
    """Merge by key: the new value unless null, the larger value, or the value that was there first."""
    both = old.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)))
    picks = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_gen"))).alias(c) for c in newest]
    picks += [F.max(c).alias(c) for c in largest]
    picks += [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_gen"))).alias(c) for c in first]
    return both.groupBy(key).agg(*picks)


def refresh_cache(old: DataFrame, fresh: DataFrame, key: str, now: Column, keep_hours: int) -> DataFrame:
    """Fresh rows replace all rows of their key; others stay while younger than the limit."""
    kept = old.join(fresh.select(key).distinct(), key, "left_anti").where((F.unix_micros(now) - F.unix_micros("occurred_at")) <= keep_hours * 3_600_000_000)
    return fresh.withColumn("origin", F.lit("fresh")).unionByName(kept.withColumn("origin", F.lit("kept")))


def replace_slice(rows: DataFrame, fresh: DataFrame, column: str, value) -> DataFrame:
    """All rows of one source replaced by fresh ones."""
    return rows.where((F.col(column) != value) | F.col(column).isNull()).unionByName(fresh.where(F.col(column) == value))


def accept_checkpoints(rows: DataFrame, key: str, order: str, through: str) -> DataFrame:
    """Mark each checkpoint as accepted unless an earlier one reached further."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("accepted", F.coalesce(F.col(through) >= F.max(through).over(before), F.lit(True)))


def prune(rows: DataFrame, covered: DataFrame, now: Column, keep_days: int) -> DataFrame:
    """Rows that stay: the young ones, and those that no verified checkpoint of their source covers."""
    done = rows.join(covered, "source_id", "left").withColumn("old", (F.unix_micros(now) - F.unix_micros("occurred_at")) > keep_days * 86_400_000_000)
    return done.where(~F.col("old") | F.col("covered_through").isNull() | (F.col("occurred_at") > F.col("covered_through"))).drop("old", "covered_through")


def chunked(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """Number the chunks of an ordered export; every chunk but the last has ``size`` rows."""
    from ledgerline.plans.offsets import running_start

    counted = running_start(rows.withColumn("_one", F.lit(1)), [F.col(c) for c in order], "_one", "_at")
    return counted.withColumn("chunk", F.expr(f"_at div {size}")).drop("_one", "_at")


def merge_tiles(tiles: list[DataFrame], key: list[str], fields: list[str]) -> DataFrame:
    """One row a key; a field comes from the first tile that has it."""
    rows = tiles[0].withColumn("_tile", F.lit(0))
    for i, tile in enumerate(tiles[1:], 1):
        rows = rows.unionByName(tile.withColumn("_tile", F.lit(i)))
    return rows.groupBy(*key).agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), F.col("_tile"))).alias(f) for f in fields])
