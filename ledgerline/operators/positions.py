"""Positions of runs along their routes: from schedules, from forecasts, frozen by a hold, and rebuilt from snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.scalars import clamp, freshness_factor

#: Minutes after which a report no longer moves a position, and after which it is gone.
FROZEN, GONE = 90, 180
#: Halves are rounded up, whatever the last bit of their binary form.
HALF = 1e-9


def _hours(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(3.6e9)


def schedule_position(schedule: DataFrame, runs: DataFrame, now: Column, stale_minutes: float = 12) -> DataFrame:
    """Where a run is between its last and next scheduled event, with confidence and error.

    ``schedule``: run_id, event_id, at, km, status, delay.  ``runs``: run_id, geometry_quality, confirmed_at.
    Before the first and after the last event the nearest one counts while it is fresh.
    """
    event = F.struct("at", "event_id", "km", "status", "delay")
    past = F.col("at") <= now
    ends = schedule.groupBy("run_id").agg(
        F.max(F.when(past, event)).alias("p"), F.min(F.when(~past, event)).alias("n"), F.count("*").alias("events"), F.max(F.when(past & (F.col("status") == "confirmed"), F.col("at"))).alias("_confirmed"),
    )
    rows = runs.join(ends, "run_id", "left").withColumn("last_confirmed_at", F.coalesce("_confirmed", "confirmed_at"))
    both = F.col("p").isNotNull() & F.col("n").isNotNull()
    gap = F.greatest(_hours(F.col("n.at"), F.col("p.at")), F.lit(1 / 3.6e6))
    progress = clamp(_hours(now, F.col("p.at")) / gap)
    quality = F.when(F.col("p.status") == "confirmed", 0.96).when(F.col("p.status") == "reported", 0.84).otherwise(0.7)
    age = F.coalesce(F.greatest(F.lit(0.0), _hours(now, F.col("last_confirmed_at"))), F.lit(8.0))
    delay = F.greatest(F.abs(F.coalesce("p.delay", F.lit(0))), F.abs(F.coalesce("n.delay", F.lit(0))))
    confidence = clamp(
        quality * 0.55 + F.coalesce("geometry_quality", F.lit(0.9)) * 0.35 + 0.1 - F.least(F.lit(0.27), gap * 0.07) - F.least(F.lit(0.25), age * 0.035) - F.least(F.lit(0.14), delay / 300), 0.08, 0.97,
    )
    error = F.greatest(F.lit(0.4), F.least(F.lit(80.0), 0.35 + F.abs(F.col("n.km") - F.col("p.km")) * (1 - confidence) * 0.32))
    one = F.coalesce("p", "n")
    near = F.abs(_hours(now, one["at"])) * 60 <= stale_minutes
    told = one["status"] == "reported"
    known = F.coalesce(F.col("events") >= 2, F.lit(False))
    status = F.when(known & both, "estimated").when(known & near, F.when(told, "reported").otherwise("stale")).otherwise("unknown")
    method = F.when(known & both, "schedule-route-interpolation").when(known & near, "nearest-route-event").when(known, "outside-known-schedule-window").otherwise("insufficient-route-or-schedule")
    nearest = status.isin("reported", "stale")
    return rows.select(
        "run_id", status.alias("status"), method.alias("method"),
        F.when(status == "estimated", F.col("p.km") + (F.col("n.km") - F.col("p.km")) * progress).when(nearest, one["km"]).alias("km"),
        F.round(F.when(status == "estimated", confidence).when(nearest, F.when(told, 0.72).otherwise(0.32)).otherwise(0.0) + HALF, 2).alias("confidence"),
        F.round(F.when(status == "estimated", error).when(nearest, F.when(told, 0.9).otherwise(4.0)), 1).alias("error_km"),
        F.when(status == "estimated", F.round(progress + HALF, 3)).alias("progress"),
        F.when(status == "estimated", F.col("last_confirmed_at")).when(nearest & (one["status"] == "confirmed"), one["at"]).alias("last_confirmed_at"),
        F.when(status == "estimated", F.col("p.event_id")).alias("from_event_id"), F.when(status == "estimated", F.col("n.event_id")).alias("to_event_id"),
    )


def nominal_speed(route_km: Column) -> Column:
    return F.when(route_km > 900, 67.0).when(route_km > 450, 63.0).otherwise(58.0)


def forecast_position(updates: DataFrame, now: Column) -> DataFrame:
    """Where moving runs are by their forecast arrival.

    Reads ``run_id, updated_at, arrival_at, route_km, reliability, anchor_error_km, provisional, moving``.  The model follows a
    report for ``FROZEN`` minutes and ends after ``GONE``.
    """
    age = F.greatest(F.lit(0.0), _hours(now, F.col("updated_at")) * 60)
    rows = updates.where(F.col("moving") & F.col("arrival_at").isNotNull() & F.col("route_km").isNotNull()).withColumn("age", age).where(F.col("age") <= GONE)
    effective = F.unix_micros("updated_at") + F.least(F.col("age"), F.lit(float(FROZEN))) * 60_000_000
    remaining = F.greatest(F.lit(0.0), (F.unix_micros("arrival_at") - effective) / F.lit(3.6e9))
    progress = clamp(1 - remaining * nominal_speed(F.col("route_km")) / F.col("route_km"), 0.025, 0.975)
    frozen, loose = F.col("age") > FROZEN, F.col("provisional")
    source = F.when(F.col("age") <= 20, 1.0).when(F.col("age") <= 45, 0.72).when(F.col("age") <= 120, 0.42).otherwise(0.18)
    route = F.greatest(F.lit(0.48), 1 - F.least(F.col("anchor_error_km"), F.lit(140.0)) / 210)
    quality = F.round(clamp(source * 0.3 + route * 0.28 + 0.24 + F.col("reliability") * 0.18), 2)
    low = F.when(loose, F.when(frozen, 0.1).otherwise(0.16)).otherwise(F.when(frozen, 0.16).otherwise(0.24))
    confidence = F.greatest(low, F.least(F.when(loose, 0.34).otherwise(0.72), quality * 0.78 * freshness_factor("age")))
    floor = F.when(loose, F.greatest(F.lit(35.0), F.col("route_km") * 0.16)).otherwise(18.0)
    error = F.greatest(floor, F.col("anchor_error_km") / 2 + F.col("route_km") * (1 - confidence) * F.when(loose, 0.18).otherwise(0.1) + F.greatest(F.lit(0.0), F.col("age") - 30) * 0.22)
    return rows.select(
        "run_id", F.when(frozen, "stale").otherwise("estimated").alias("status"), F.when(loose, "probabilistic-rail-envelope-v1").otherwise("rail-corridor-v6").alias("method"),
        F.round(progress, 3).alias("progress"), F.round(F.col("route_km") * progress, 3).alias("km"), F.round(confidence + HALF, 2).alias("confidence"), F.round(error + HALF, 1).alias("error_km"),
    )


def frozen_position(held: DataFrame, now: Column) -> DataFrame:
    """Where held runs stay: at their last estimate, or in the middle of the route within a wide envelope.

    Reads ``run_id, updated_at, route_km, progress, confidence, error_km``; the last three are null without an estimate.
    """
    age = F.greatest(F.lit(0.0), _hours(now, F.col("updated_at")) * 60)
    known = F.col("progress").isNotNull()
    progress = F.coalesce("progress", F.lit(0.5))
    confidence = clamp(F.when(known, F.coalesce("confidence", F.lit(0.35))).otherwise(0.14) * 0.68 * F.exp(-age / 360), 0.05, 0.48)
    error = F.least(F.lit(300.0), F.greatest(F.coalesce("error_km", F.lit(25.0)), F.when(known, 0.0).otherwise(F.col("route_km") * 0.52), 25 + age * 0.3))
    return held.select(
        "run_id", F.when(age > 90, "stale").otherwise("estimated").alias("status"), F.when(known, "operational-hold-frozen-estimate").otherwise("operational-hold-route-envelope").alias("method"),
        F.round(progress, 3).alias("progress"), F.round(F.col("route_km") * progress, 3).alias("km"), F.round(confidence + HALF, 2).alias("confidence"), F.round(error + HALF, 1).alias("error_km"),
    )


def historical_positions(snapshots: DataFrame, at: Column, hours: float = 6) -> DataFrame:
    """Positions as they were at a moment: each run's last snapshot before it, with the forecast model of that moment."""
    from ledgerline.operators.state import as_of

    then = as_of(snapshots, "run_id", at, "captured_at", "snapshot_id", hours)
    found = forecast_position(then, at)
    gap = _hours(at, F.col("captured_at")) * 60 > 30
    return then.select("run_id", "snapshot_id", gap.alias("timeline_gap")).join(found, "run_id", "left").withColumn("status", F.coalesce("status", F.lit("unknown")))
