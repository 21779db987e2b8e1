"""Public projection of sensitive observations: late, independent, coarse, without identifiers.

The floors are constants of the module; a caller can raise them but not lower them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_DELAY_HOURS, MOST_AGE_DAYS, LEAST_SOURCES, LEAST_UNCERTAINTY_KM = 24, 7, 2, 35.0
CLUSTER_HOURS, ROUND_MINUTES = 6, 15


def _pieces(rows: DataFrame, keys: list[str], time: str, width: int) -> DataFrame:
    """Distinct times ``_t`` of each key with the number ``_piece`` of the stretch without a gap wider than ``width``."""
    times = rows.select(*keys, F.unix_micros(time).alias("_t")).distinct()
    order = Window.partitionBy(*keys).orderBy("_t")
    opens = F.coalesce((F.col("_t") - F.lag("_t").over(order) > width).cast("int"), F.lit(0))
    return times.withColumn("_opens", opens).withColumn("_piece", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def _anchors(pieces: DataFrame, keys: list[str], width: int, at_width: bool) -> DataFrame:
    """The times that open a cluster: the first of a piece, then each first one ``width`` or more after the last opened.

    The fold passes over the times of one piece and keeps the openings alone.
    """
    sorted_times = pieces.groupBy(*keys, "_piece").agg(F.array_sort(F.collect_list("_t")).alias("ts"))
    empty = F.struct(F.lit(-(1 << 62)).alias("last"), F.expr("cast(array() as array<bigint>)").alias("kept"))
    far = (lambda a, t: t - a["last"] >= width) if at_width else (lambda a, t: t - a["last"] > width)
    fold = F.aggregate("ts", empty, lambda a, t: F.when(far(a, t), F.struct(t.alias("last"), F.concat(a["kept"], F.array(t)).alias("kept"))).otherwise(a), lambda a: a["kept"])
    return sorted_times.select(*keys, F.explode(fold).alias("_t"))


def first_anchored(rows: DataFrame, keys: list[str], time: str, hours: float) -> DataFrame:
    """Cluster numbers where a cluster ends ``hours`` after its first row.

    A gap wider than that always opens a cluster, so each key's times are cut there and only the stretches are folded.
    """
    width = int(hours * 3_600_000_000)
    pieces = _pieces(rows, keys, time, width)
    opened = _anchors(pieces, keys, width, False).withColumn("_opens", F.lit(1))
    order = Window.partitionBy(*keys).orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    numbers = pieces.join(opened, [*keys, "_t"], "left").withColumn("cluster", F.sum(F.coalesce("_opens", F.lit(0))).over(order).cast("int")).select(*keys, "_t", "cluster")
    return rows.withColumn("_t", F.unix_micros(time)).join(numbers, [*keys, "_t"]).drop("_t")


def project(evidence: DataFrame, now: Column, delay_hours: int = LEAST_DELAY_HOURS, sources: int = LEAST_SOURCES) -> DataFrame:
    """Aggregates that may be shown.  Reads ``corridor, source_group, fingerprint, occurred_at, received_at, updated_at, confidence, reviewed``."""
    delay, need = max(delay_hours, LEAST_DELAY_HOURS), max(sources, LEAST_SOURCES)
    newest = F.greatest("occurred_at", "received_at", "updated_at")
    age = F.unix_micros(now) - F.unix_micros(newest)
    ready = evidence.where((age >= delay * 3_600_000_000) & (F.unix_micros(now) - F.unix_micros("occurred_at") <= MOST_AGE_DAYS * 86_400_000_000))
    once = Window.partitionBy("fingerprint").orderBy("occurred_at", "source_group")
    ready = ready.withColumn("_p", F.row_number().over(once)).where("_p = 1").drop("_p")
    grouped = first_anchored(ready, ["corridor"], "occurred_at", CLUSTER_HOURS)
    by_source = grouped.groupBy("corridor", "cluster", "source_group").agg(F.max("confidence").alias("best"), F.min("occurred_at").alias("start"), F.max("occurred_at").alias("end"), F.max(F.col("reviewed").cast("int")).alias("reviewed"), F.count("*").alias("rows"))
    out = by_source.groupBy("corridor", "cluster").agg(F.count("*").alias("sources"), (1 - F.product(1 - F.least(F.lit(0.95), F.col("best")))).alias("confidence"), F.min("start").alias("start"), F.max("end").alias("end"), F.max("reviewed").alias("reviewed"), F.sum("rows").alias("rows"))
    out = out.where((F.col("sources") >= need) | (F.col("reviewed") == 1))
    width = ROUND_MINUTES * 60_000_000
    rounded = {c: F.expr(f"(unix_micros({c}) div {width}) * {width}") for c in ("start", "end")}
    uncertainty = F.greatest(F.lit(LEAST_UNCERTAINTY_KM), F.round(LEAST_UNCERTAINTY_KM + (1 - F.col("confidence")) * 60, 1))
    return out.withColumns(rounded).select("corridor", "start", "end", "sources", F.round("confidence", 6).alias("confidence"), uncertainty.alias("uncertainty_km"))


def presentation(projected: DataFrame, now_us: Column) -> DataFrame:
    """Rows for a map without positions: freshness and a quality score."""
    hours = (now_us - F.col("end")) / F.lit(3.6e9)
    quality = 0.82 * F.col("confidence") + 0.18 * F.least(F.lit(1.0), F.col("sources") / 4)
    return projected.select("corridor", "start", F.when(hours <= 48, "recent").when(hours <= 96, "older").otherwise("archive").alias("freshness"), F.round(quality, 4).alias("quality"), F.greatest(F.lit(LEAST_UNCERTAINTY_KM), "uncertainty_km").alias("error_km"), F.lit(None).cast("double").alias("position"))


def roll_up(evidence: DataFrame, now: Column, half_life_hours: float = 6) -> DataFrame:
    """Decayed noisy-or of each area's evidence over a day."""
    age = (F.unix_micros(now) - F.unix_micros("occurred_at")) / F.lit(3.6e9)
    rows = evidence.where((age >= 0) & (age <= 24)).withColumn("w", F.least(F.lit(0.95), F.col("confidence")) * F.pow(F.lit(0.5), age / half_life_hours))
    return rows.groupBy("corridor").agg(F.round(1 - F.product(1 - F.col("w")), 6).alias("strength"), F.count("*").alias("reports"), F.countDistinct("source_group").alias("sources"))


def thin(rows: DataFrame, key: str, time: str, minutes: float) -> DataFrame:
    """Times kept when each must lie at least so many minutes after the last kept one of its key."""
    width = int(minutes * 60_000_000)
    return _anchors(_pieces(rows, [key], time, width - 1), [key], width, True).select(key, F.col("_t").alias("kept_at"))
