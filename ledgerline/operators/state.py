"""What a run is doing now, what changed, and what comes next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.scalars import clamp


def as_of(rows: DataFrame, key: str, at: Column, time: str, tie: str, hours: float | None = None) -> DataFrame:
    """The newest row of each key at a moment, not older than the limit: a grouped maximum, no sort."""
    seen = rows.where(F.col(time) <= at)
    if hours is not None:
        seen = seen.where(F.unix_micros(at) - F.unix_micros(time) < hours * 3_600_000_000)
    picked = F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(time, tie)).alias("r")
    return seen.groupBy(key).agg(picked).select(key, "r.*")


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row of its keys at or before its time.

    One shuffle: both sides are put on one time line and the last right values are carried forward.
    """
    order = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    tagged = left.withColumn("_at", F.col(time)).withColumn("_side", F.lit(1)).withColumn("_r", F.lit(None).cast(right.select(F.struct(right_time, *values).alias("x")).schema["x"].dataType)).withColumn("_l", F.struct(*left.columns))
    facts = right.select(*keys, F.col(right_time).alias("_at"), F.lit(0).alias("_side"), F.struct(right_time, *values).alias("_r"))
    both = tagged.select(*keys, "_at", "_side", "_r", "_l").unionByName(facts, allowMissingColumns=True)
    found = both.withColumn("_last", F.last("_r", ignorenulls=True).over(order)).where("_side = 1")
    return found.select("_l.*", *[F.col(f"_last.{v}").alias(f"last_{v}") for v in (right_time, *values)])


def first_after(predictions: DataFrame, facts: DataFrame, keys: list[str], time: str, fact_time: str, fact_id: str) -> DataFrame:
    """The first fact of the same keys after each prediction; predictions without one stay."""
    left = predictions.select(*keys, F.col(time).alias("_at"), F.lit(1).alias("_side"), F.struct(*predictions.columns).alias("_l"))
    right = facts.select(*keys, F.col(fact_time).alias("_at"), F.lit(2).alias("_side"), F.struct(F.col(fact_time).alias("at"), F.col(fact_id).alias("id")).alias("_r"))
    both = left.unionByName(right, allowMissingColumns=True)
    # going backwards in time, a fact of the same moment comes after the prediction and is not seen by it
    back = Window.partitionBy(*keys).orderBy(F.col("_at").desc(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_next", F.last("_r", ignorenulls=True).over(back))
    return found.where("_side = 1").select("_l.*", F.col("_next.at").alias("fact_at"), F.col("_next.id").alias("fact_id"))


def tail_islands(events: DataFrame) -> DataFrame:
    """The latest unbroken stay of each run at one station: reports, minutes, and the station before."""
    order = Window.partitionBy("run_id").orderBy("occurred_at", "event_id")
    moved = F.coalesce(F.col("station") != F.lag("station").over(order), F.lit(True)).cast("int")
    rows = events.withColumn("before", F.lag("station").over(order)).withColumn("moved", moved).withColumn("island", F.sum("moved").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    stays = rows.groupBy("run_id", "island").agg(F.first("station").alias("station"), F.count("*").alias("repeats"), F.min("occurred_at").alias("since"), F.max("occurred_at").alias("until"), F.min_by("before", F.struct("occurred_at", "event_id")).alias("previous"))
    last = stays.groupBy("run_id").agg(F.max_by(F.struct("station", "repeats", "since", "until", "previous"), "island").alias("s")).select("run_id", "s.*")
    return last.withColumn("dwell_minutes", F.round((F.unix_micros("until") - F.unix_micros("since")) / F.lit(60e6), 1))


def operational_state(rows: DataFrame, now: Column) -> DataFrame:
    """State and its confidence in order of priority; reads ``until, held, position, repeats, dwell_minutes, eta_end, progress, confidence``."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros("until")) / F.lit(60e6))
    overdue = F.coalesce((F.unix_micros(now) - F.unix_micros("eta_end")) / F.lit(60e6), F.lit(0.0))
    state = (
        F.when(F.col("held") & (F.col("position") != "unknown"), "held").when(F.col("position") == "unknown", "unknown").when(F.col("position") == "stale", "stale")
        .when((F.col("repeats") >= 2) & (F.col("dwell_minutes") >= 2) & (age <= 20), "dwelling").when(age <= 5, "at_station").when(overdue > 0, "overdue")
        .when(F.col("progress") < 0.18, "departing").when(F.col("progress") >= 0.78, "approaching").otherwise("in_transit")
    )
    factor = F.when(state.isin("at_station", "dwelling", "held"), 1.0).when(state == "stale", 0.55).when(state == "unknown", 0.0).otherwise(0.85)
    return rows.withColumn("state", state).withColumn("state_confidence", F.round(clamp(F.col("confidence") * factor), 4))


def transitions(rows: DataFrame, key: str, time: str, tie: str, watched: list[str]) -> DataFrame:
    """Rows whose watched columns differ from the row before of the same key, with the old values."""
    order = Window.partitionBy(key).orderBy(time, tie)
    old = {f"from_{c}": F.lag(c).over(order) for c in watched}
    marked = rows.withColumns({**old, "_first": F.row_number().over(order) == 1})
    changed = F.col("_first")
    for c in watched:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"from_{c}"))
    return marked.where(changed).drop("_first")


def trajectory(events: DataFrame) -> DataFrame:
    order = Window.partitionBy("run_id").orderBy("occurred_at", "event_id")
    return events.withColumn("sequence", F.row_number().over(order) - 1)


def changes(previous: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """One row a noticed change: station, route, ETA by 10 minutes, confidence down by 0.15, uncertainty up by a quarter and 15 km.

    Both sides hold ``station, route, eta, confidence, uncertainty``.
    """
    j = previous.alias("p").join(current.alias("c"), key)
    gap = F.abs(F.unix_micros("c.eta") - F.unix_micros("p.eta")) / F.lit(60e6)
    drop = F.col("p.confidence") - F.col("c.confidence")
    wide = F.col("c.uncertainty") >= F.greatest(F.col("p.uncertainty") * 1.25, F.col("p.uncertainty") + 15)

    def change(kind: str, severity: Column, test: Column) -> Column:
        return F.when(test, F.struct(F.lit(kind).alias("kind"), severity.alias("severity")))

    found = F.array_compact(F.array(
        change("station_fact", F.lit("low"), F.col("c.station") != F.col("p.station")), change("route_changed", F.lit("high"), F.col("c.route") != F.col("p.route")),
        change("eta_changed", F.when(gap >= 30, "high").otherwise("medium"), gap >= 10), change("confidence_drop", F.when(F.col("c.confidence") < 0.35, "high").otherwise("medium"), drop >= 0.15),
        change("uncertainty_expanded", F.when(F.col("c.uncertainty") >= 100, "high").otherwise("medium"), wide)))
    return j.select(key, F.explode(found).alias("x")).select(key, "x.kind", "x.severity")


def hypotheses(anchors: DataFrame, edges: DataFrame, now: Column, most: int = 3) -> DataFrame:
    """The likeliest next stations of each run, with probability, progress, uncertainty and ambiguity.

    ``anchors``: run_id, station, train, occurred_at, previous, fusion_reliability.  ``edges``: from_station, to_station,
    train, sample_count, p10, p50, p90.
    """
    edges = edges.where("to_station <> from_station AND p50 > 0 AND p50 <= 1440")
    # what an edge of another train scores does not depend on the anchor but for one next station, so the best few to each
    # next station are enough; the train's own edges join by train
    base = F.log1p("sample_count") * 0.32 + clamp(F.log1p("sample_count") / F.log(F.lit(21.0))) * 0.8
    few = Window.partitionBy("from_station", "to_station").orderBy(F.round(base, 9).desc(), "train")
    common = edges.withColumn("_of", F.row_number().over(few)).where(F.col("_of") <= most + 1).drop("_of").alias("e")
    here = F.col("a.station") == F.col("e.from_station")
    others = anchors.alias("a").join(common, here & ~F.col("a.train").eqNullSafe(F.col("e.train")))
    own = anchors.alias("a").join(edges.alias("e"), here & (F.col("a.train") == F.col("e.train")))
    pairs = others.select("a.*", F.struct("e.*").alias("e")).unionByName(own.select("a.*", F.struct("e.*").alias("e"))).alias("a")
    family = (F.col("a.train") == F.col("e.train")).cast("double")
    reliability = clamp(F.log1p("e.sample_count") / F.log(F.lit(21.0)))
    back = F.coalesce(F.col("a.previous") == F.col("e.to_station"), F.lit(False)).cast("double")
    score = 0.35 + family * 1.4 + F.log1p("e.sample_count") * 0.32 + reliability * 0.8 - back * 0.9
    rows = pairs.select("run_id", F.col("e.to_station").alias("to_station"), "a.occurred_at", "a.fusion_reliability", "e.p10", "e.p50", "e.p90", "e.sample_count", F.col("e.train").alias("family"), reliability.alias("edge_reliability"), score.alias("score"))
    run = Window.partitionBy("run_id")
    order = run.orderBy(F.round("score", 9).desc(), "to_station", "family")
    rows = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    rows = rows.withColumn("w", F.exp(F.col("score") - F.max("score").over(run)))
    rows = rows.withColumn("probability", F.col("w") / F.sum("w").over(run)).withColumn("n", F.count("*").over(run))
    entropy = F.when(F.col("n") > 1, -F.sum(F.col("probability") * F.log(F.greatest(F.col("probability"), F.lit(1e-9)))).over(run) / F.log("n")).otherwise(0.0)
    rows = rows.withColumn("entropy", entropy)
    age = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros("occurred_at")) / F.lit(60e6))
    best = F.max(F.when(F.col("place") == 1, F.col("probability"))).over(run)
    second = F.coalesce(F.max(F.when(F.col("place") == 2, F.col("probability"))).over(run), F.lit(0.0))
    unsure = (best < 0.58) | ((F.col("n") > 1) & (best - second < 0.18)) | (F.col("entropy") > 0.78)
    spread = F.greatest(F.lit(0.05), (F.col("p90") - F.col("p10")) / F.greatest(F.col("p50"), F.lit(1.0)))
    uncertainty = clamp((F.greatest(F.lit(3.0), 60 * spread * 0.5) + age * 0.35 + (1 - F.col("probability")) * 35) * (1 + F.col("entropy") * 0.45), 3.0, 300.0)
    confidence = clamp(clamp("fusion_reliability") * F.col("edge_reliability") * F.col("probability") * F.exp(-age / 150))
    position = F.when(age > 180, "unknown").when(age > 90, "stale").otherwise("estimated")
    return rows.select("run_id", "place", "to_station", F.round("probability", 4).alias("probability"), F.round(clamp(age / F.col("p50")), 4).alias("progress"), F.round("entropy", 4).alias("entropy"), F.round(uncertainty, 2).alias("uncertainty_km"), F.round(confidence, 6).alias("confidence"), position.alias("position"), unsure.alias("ambiguous"))


def posterior(runs: DataFrame, now: Column) -> DataFrame:
    """Where a run is along its route: a discretised normal around the schedule, with nested corridors.

    Reads ``run_id, route_km, anchor_km, anchor_at, error_km, reliability, next_km, next_at``; the next point may be null.
    """
    age = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros("anchor_at")) / F.lit(60e6))
    rows = runs.withColumn("age", age)
    start = F.least(F.greatest(F.col("anchor_km"), F.lit(0.0)), F.col("route_km"))
    goal = F.least(F.greatest(F.col("next_km"), start), F.col("route_km"))
    total = F.greatest(F.lit(1.0), (F.unix_micros("next_at") - F.unix_micros("anchor_at")) / F.lit(60e6))
    speed = 62.0
    with_next = F.col("next_at").isNotNull()
    mean = F.when(with_next, start + (goal - start) * clamp(F.col("age") / total)).otherwise(F.least(start + speed * F.col("age") / 60, F.col("route_km")))
    sigma = F.when(with_next, F.greatest(F.coalesce("error_km", F.lit(1.5)), F.greatest(F.lit(1.0), goal - start) * 0.12, 1.2 + F.col("age") * 0.055)).otherwise(F.greatest(F.coalesce("error_km", F.lit(2.0)), 2 + F.col("age") * 0.16))
    rows = rows.withColumns({"mean_km": mean, "sigma_km": sigma, "bins": F.least(F.lit(240), F.greatest(F.lit(40), F.ceil(F.col("route_km") / 2))).cast("int")})
    cells = rows.where("age <= 180").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("bins")))).withColumn("km", F.col("i") * F.col("route_km") / F.col("bins"))
    z = (F.col("km") - F.col("mean_km")) / F.greatest(F.lit(0.01), F.col("sigma_km"))
    run = Window.partitionBy("run_id")
    cells = cells.withColumn("w", F.exp(-0.5 * z * z))
    cells = cells.withColumn("upto", F.sum("w").over(run.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("w").over(run))
    marks = {"p025": 0.025, "p05": 0.05, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p975": 0.975}
    found = cells.groupBy("run_id").agg(*[F.round(F.min(F.when(F.col("upto") >= p - 1e-12, F.col("km"))), 2).alias(n) for n, p in marks.items()])
    out = rows.join(found, "run_id", "left")
    error = F.greatest(F.col("p50") - F.col("p05"), F.col("p95") - F.col("p50"))
    status = F.when(F.col("age") > 180, "unknown").when(F.col("age") > 90, "stale").when((F.col("age") <= 3) & (error <= 5), "reported").otherwise("estimated")
    concentration = clamp(1 - (F.col("p95") - F.col("p05")) / F.greatest(F.col("route_km"), F.lit(1.0)))
    confidence = clamp(clamp("reliability") * 0.48 + clamp(1 - F.col("age") / 180) * 0.3 + concentration * 0.22, 0.05, 0.96)
    confidence = F.when(F.col("age") > 180, None).when(F.col("age") > 90, F.least(confidence, F.lit(0.32))).otherwise(confidence)
    return out.select("run_id", status.alias("status"), *marks, F.round(confidence, 4).alias("confidence"))
