"""Fuse reports of one fact from several sources into graded facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.scalars import authority_weight, clamp


def weight() -> Column:
    """Reliability times the weight of the authority."""
    return clamp("reliability") * authority_weight("authority")


def gap_sessions(events: DataFrame, keys: list[str], gap_minutes: float, time: str = "occurred_at", out: str = "session") -> DataFrame:
    """Number the sessions of each key; a row more than the gap after the one before opens a new session.

    The window and any later grouping by the same keys share one shuffle.
    """
    order = Window.partitionBy(*keys).orderBy(time, "event_id")
    late = (F.unix_micros(time) - F.unix_micros(F.lag(time).over(order))) > gap_minutes * 60_000_000
    opens = F.coalesce(late, F.lit(True)).cast("int")
    return events.withColumn("_opens", opens).withColumn(out, F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_opens")


def noisy_or(values: Column | str, cap: float = 1.0) -> Column:
    """Aggregate: the chance that at least one of independent reports is right."""
    v = F.col(values) if isinstance(values, str) else values
    return 1 - F.product(1 - F.least(F.lit(cap), v))


def fuse_simple(events: DataFrame, gap_minutes: float = 15) -> DataFrame:
    """First generation: noisy-or over members; the primary report is the weightiest, then the earliest."""
    keys = ["train", "station"]
    sessions = gap_sessions(events, keys, gap_minutes).withColumn("w", weight())
    best = F.min_by("event_id", F.struct((-F.col("w")).alias("a"), F.col("occurred_at").alias("b"), F.col("event_id").alias("c")))
    return sessions.groupBy(*keys, "session").agg(F.count("*").alias("members"), F.countDistinct("source_id").alias("sources"), best.alias("primary_event_id"), F.round(noisy_or("w"), 6).alias("reliability"), F.min("occurred_at").alias("window_start"), F.max("occurred_at").alias("window_end"))


def fuse_domains(events: DataFrame, gap_minutes: float = 20) -> DataFrame:
    """Graded facts: the best report of each independent domain counts; conflicts and spread lower the consensus."""
    keys = ["train", "station"]
    sessions = gap_sessions(events, keys, gap_minutes).withColumn("w", weight())
    group = [*keys, "session"]
    top = F.min_by(F.struct("event_id", "run_id", "authority"), F.struct((-F.col("w")).alias("a"), (-F.unix_micros("occurred_at")).alias("b"), F.col("event_id").alias("c")))
    by_domain = sessions.groupBy(*group, "domain").agg(
        F.max("w").alias("best"), F.count("*").alias("members"), F.collect_set("source_id").alias("sources"), F.collect_set("run_id").alias("runs"), F.min("occurred_at").alias("start"), F.max("occurred_at").alias("end"),
        top.alias("top"), F.min(F.struct((-F.col("w")).alias("a"), (-F.unix_micros("occurred_at")).alias("b"), F.col("event_id").alias("c"))).alias("place"))
    fused = by_domain.groupBy(*group).agg(
        F.sum("members").alias("members"), F.count("*").alias("domains"), F.size(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"),
        F.size(F.array_distinct(F.flatten(F.collect_list("runs")))).alias("runs"), F.min("start").alias("window_start"), F.max("end").alias("window_end"), noisy_or("best", 0.96).alias("effective"), F.min_by("top", "place").alias("top"))
    spread = (F.unix_micros("window_end") - F.unix_micros("window_start")) / F.lit(60e6)
    fused = fused.withColumn("spread_minutes", spread)
    conflicts = F.array_compact(F.array(F.when(F.col("runs") > 1, F.lit("run-identity-conflict")), F.when(F.col("spread_minutes") > max(12, gap_minutes * 0.75), F.lit("temporal-spread"))))
    fused = fused.withColumn("conflicts", conflicts)
    penalty = F.least(F.lit(0.8), F.size("conflicts") * 0.18 + F.least(F.lit(1.0), F.col("spread_minutes") / max(1, gap_minutes)) * 0.22)
    fused = fused.withColumn("consensus", F.round(F.greatest(F.lit(0.05), 1 - penalty), 4))
    grade = F.when(F.size("conflicts") > 0, "conflict").when((F.col("domains") >= 2) & (F.col("effective") >= 0.8), "corroborated").when(F.col("top.authority") == "official", "official-single").otherwise("single-source")
    return fused.select(*group, "members", "sources", "domains", F.col("top.event_id").alias("primary_event_id"), F.col("top.run_id").alias("primary_run_id"), "window_start", "window_end", F.round("spread_minutes", 1).alias("spread_minutes"), "consensus", F.round(F.least(F.lit(0.99), F.col("effective") * F.col("consensus")), 6).alias("reliability"), grade.alias("grade"), F.array_join("conflicts", ",").alias("conflicts"))


def weighted_median_time(events: DataFrame, gap_minutes: float = 20) -> DataFrame:
    """The time at which half of a session's weight has been reached."""
    keys = ["train", "station"]
    sessions = gap_sessions(events, keys, gap_minutes).withColumn("w", F.greatest(F.lit(0.05), weight()))
    group = Window.partitionBy(*keys, "session")
    upto = F.sum("w").over(group.orderBy("occurred_at", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = sessions.withColumn("upto", upto).withColumn("total", F.sum("w").over(group))
    return rows.groupBy(*keys, "session").agg(F.min(F.when(F.col("upto") >= F.col("total") / 2 - 1e-9, F.col("occurred_at"))).alias("median_at"))


def merge_by_priority(rows: DataFrame, keys: list[str], priority: Column, order: list[Column]) -> DataFrame:
    """One row a key: the highest priority, of equals the last in ``order``."""
    place = Window.partitionBy(*keys).orderBy(priority.desc(), *order)
    return rows.withColumn("_place", F.row_number().over(place)).where("_place = 1").drop("_place")


def fuse_by_service(events: DataFrame) -> DataFrame:
    """One row a run: nullable fields come from the best report that has them; sources are a set."""
    best_first = [(-weight()).alias("a"), (-F.unix_micros("occurred_at")).alias("b"), F.col("event_id").alias("c")]
    rank = F.struct(*best_first)
    filled = {c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), rank)) for c in ("station", "delay_min", "reliability")}
    calls = F.array_sort(F.collect_set(F.concat_ws("@", F.date_format("occurred_at", "HH:mm"), "station")))
    return events.groupBy("run_id").agg(*[v.alias(k) for k, v in filled.items()], F.array_join(F.array_sort(F.collect_set("source_id")), ",").alias("sources"), F.array_join(calls, ",").alias("calls"), F.count("*").alias("reports"))
