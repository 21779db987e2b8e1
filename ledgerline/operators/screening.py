"""Admit, flag, classify and filter rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_DELAY, MAX_FUTURE, OLD_AFTER = 24 * 60, 20, 6 * 60
EVENT_TYPES = ("station_report", "delay_update", "forecast", "status", "board", "position")


def reasons(**tests: Column) -> Column:
    """The names of the tests that hold, in the order given; a null test does not hold."""
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))


def assess(updates: DataFrame, now: Column) -> DataFrame:
    """Add ``errors`` and ``warnings``; a row is accepted when it has no error.

    Reads ``number, updated_at, delay, lat, lon, route, forecast, text``.
    """
    age = (F.unix_micros(now) - F.unix_micros("updated_at")) / F.lit(60e6)
    errors = reasons(
        invalid_number=F.col("number").isNull() | ~F.col("number").rlike(r"^\d{1,4}(/\d{1,4})?$"),
        invalid_timestamp=F.col("updated_at").isNull(),
        future_timestamp=age < -MAX_FUTURE,
        impossible_delay=~F.col("delay").between(0, MAX_DELAY),
        invalid_coordinates=(F.abs("lat") > 90) | (F.abs("lon") > 180),
    )
    numbers = F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"#\s*(\d{1,4})"), F.lit(1)))
    warnings = reasons(missing_route=F.coalesce(F.trim("route"), F.lit("")) == "", missing_forecast=F.col("forecast").isNull(), old_event=age > OLD_AFTER, several_numbers=F.size(numbers) > 1)
    return updates.withColumn("errors", errors).withColumn("warnings", warnings).withColumn("accepted", F.size("errors") == 0)


def warning_counts(assessed: DataFrame) -> DataFrame:
    return assessed.select(F.explode("warnings").alias("warning")).groupBy("warning").agg(F.count("*").alias("rows"))


def contract_errors(events: DataFrame) -> DataFrame:
    """Add ``errors``: required fields, the event type and the range of the reliability."""
    required = ("event_id", "run_id", "train", "station", "occurred_at", "observed_at", "source_id")
    missing = {f"missing_{c}": F.col(c).isNull() for c in required}
    return events.withColumn("errors", reasons(**missing, unknown_type=~F.col("event_type").isin(*EVENT_TYPES), bad_reliability=~F.col("reliability").between(0, 1)))


def volume_drops(counts: DataFrame, key: str, at: str, count: str, least: int = 20, ratio: float = 0.45) -> DataFrame:
    """Each count with the one before and whether it fell below ``ratio`` of a count of at least ``least``."""
    before = F.lag(count).over(Window.partitionBy(key).orderBy(at))
    rows = counts.withColumn("previous", before)
    return rows.withColumn("anomaly", F.coalesce((F.col("previous") >= least) & (F.col(count) < F.col("previous") * ratio), F.lit(False)))


def guard_coordinates(rows: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Keep coordinates inside the box, swap those that fit only the other way round, null the rest."""
    low_lat, high_lat, low_lon, high_lon = box

    def inside(lat: str, lon: str) -> Column:
        return F.coalesce(F.col(lat).between(low_lat, high_lat) & F.col(lon).between(low_lon, high_lon), F.lit(False))

    straight, swapped = inside("lat", "lon"), inside("lon", "lat")
    quality = F.when(straight, "explicit-fields").when(swapped, "coordinate-order-repaired").otherwise("outside-rejected")
    fixed = {"lat": F.when(straight, F.col("lat")).when(swapped, F.col("lon")), "lon": F.when(straight, F.col("lon")).when(swapped, F.col("lat"))}
    return rows.withColumns({"coordinate_quality": quality, **fixed})


def in_box(rows: DataFrame, box: tuple[float, float, float, float] | None, fallback: tuple[float, float, float, float]) -> DataFrame:
    """Rows inside the box, or inside the fallback box where the given one is not valid; both bounds reach the scan."""
    ok = box is not None and box[0] < box[1] and box[2] < box[3] and -90 <= box[0] and box[1] <= 90 and -180 <= box[2] and box[3] <= 180
    a, b, c, d = box if ok else fallback
    return rows.where(F.col("lat").between(a, b) & F.col("lon").between(c, d))


def search(rows: DataFrame, fields: list[str], variants: list[str]) -> DataFrame:
    """Rows whose joined fields hold any of the variants, whatever the case."""
    text = F.lower(F.concat_ws(" ", *fields))
    hit = F.lit(False)
    for v in variants:
        hit = hit | text.contains(v.lower())
    return rows.where(hit)


def first_rule(text: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """The name of the first rule whose pattern the text holds."""
    out = F.when(text.rlike(rules[0][0]), rules[0][1])
    for pattern, name in rules[1:]:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise(other)


def text_gate(posts: DataFrame, sensitive: str, topic: str, excluded: str) -> DataFrame:
    """Sort posts into quarantined (with the text masked), off topic, excluded and accepted."""
    text = F.lower(F.coalesce("text", F.lit("")))
    verdict = F.when(text.rlike(sensitive), "quarantined").when(~text.rlike(topic), "off-topic").when(text.rlike(excluded), "excluded").otherwise("accepted")
    excerpt = F.when(verdict == "quarantined", F.regexp_replace(F.substring(text, 1, 80), r"[\p{L}\p{N}]", "*")).when(verdict == "accepted", F.substring(text, 1, 80))
    return posts.withColumn("verdict", verdict).withColumn("excerpt", excerpt)


def admission(rows: DataFrame) -> DataFrame:
    """Which position claims a row supports, and why; reads ``age_minutes, operational, evidence, station, has_route, forecast``.

    ``allowed`` is any claim, ``reported`` one at the named station, ``calculated`` one along the route.
    """
    moving, named, route = F.col("operational") == "moving", F.coalesce(F.col("station"), F.lit("")) != "", F.col("has_route")
    reason = (
        F.when(~F.coalesce(F.col("age_minutes") <= 180, F.lit(False)), "source_expired").when((F.col("operational") == "depot") & named, "confirmed_depot").when((F.col("evidence") == "reported-station-passage") & named, "station_fact")
        .when((F.col("evidence") == "station-board-window") & named, "station_window").when((F.col("evidence") == "schedule-only") | (F.col("operational") == "planned"), "planned_only").when(moving & ~route, "route_unavailable")
        .when(moving & F.col("forecast").isNull() & ~named, "forecast_unavailable").when(moving & route, "calculated_corridor").otherwise("insufficient_evidence")
    )
    reported = reason.isin("confirmed_depot", "station_fact", "station_window")
    calculated = (reason == "calculated_corridor") | ((reason == "station_fact") & route & moving)
    return rows.withColumns({"reason": reason, "reported": reported, "calculated": calculated, "allowed": reported | calculated})


def board_phase(minutes: Column) -> Column:
    """The phase of a board row by its offset in minutes; only ``-45 .. 90`` counts as a fact."""
    return F.when(minutes < -45, "past").when(minutes <= 0, "recent").when(minutes <= 90, "near").otherwise("planned")
