"""What is expected, what was seen, and where to look next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def expected_runs(plans: DataFrame, calls: DataFrame) -> DataFrame:
    """Planned runs from plans and their calls; reads ``run_id, source_id`` and ``run_id, station, at``."""
    heads = plans.groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_set("source_id")), ",").alias("sources"), F.count("*").alias("discoveries"))
    stops = calls.groupBy("run_id").agg(F.countDistinct("station").alias("stations"), F.min("at").alias("departure"), F.max("at").alias("arrival"))
    return heads.join(stops, "run_id", "left")


def live_coverage(runs: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts of each planned run: one grouped pass, runs without facts stay."""
    seen = facts.groupBy("run_id").agg(F.count("*").alias("facts"), F.max("at").alias("last_at"), F.max_by("station", F.struct("at", "station")).alias("last_station"))
    return runs.join(seen, "run_id", "left").withColumn("facts", F.coalesce("facts", F.lit(0)))


#: Statuses that end a run, and those of a run that stands at a station.
ENDED, STANDING = ("completed", "terminated", "finished"), ("station", "at-station", "depot", "waiting", "dwelling")
#: Minutes for which a fact is fresh, and after which a run is no longer merely unobserved.
FRESH_FACT, GAP_LIMIT = 90, 360


def run_status(rows: DataFrame, now: Column) -> DataFrame:
    """Adds ``status, reason, missing_since``; reads ``service_date, departure, arrival, last_at, operational``.

    A run is completed only by a fresh fact that says so; a passed schedule alone leaves its completion unknown.
    """
    minutes = lambda later, earlier: (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(60e6)
    plus = lambda ts, m: F.timestamp_micros(F.unix_micros(ts) + m * 60_000_000)
    age, day = minutes(now, F.col("last_at")), F.to_timestamp("service_date")
    end = F.timestamp_micros(F.unix_micros(day) + 86_399_000_000)
    fresh = F.coalesce(age <= FRESH_FACT, F.lit(False))
    ended, standing = (F.coalesce(F.lower("operational").isin(*names), F.lit(False)) for names in (ENDED, STANDING))
    rules = (
        (fresh & ended, "completed", "explicit-terminal-fact", None), (fresh & standing, "at_station", "fresh-station-presence", None), (fresh, "active", "fresh-observation", None),
        (F.coalesce(age <= GAP_LIMIT, F.lit(False)), "unobserved", "observation-gap", plus(F.col("last_at"), 90)),
        (now < plus(F.col("departure"), 20), "planned", "departure-window-not-open", None),
        (F.col("departure").isNull() & (now < plus(day, 360)), "planned", "service-day-not-open", None),
        (now > plus(F.col("arrival"), 180), "unknown_completion", "arrival-window-passed-without-fact", plus(F.col("arrival"), 60)),
        (now > plus(end, 360), "unknown_completion", "service-day-ended-without-fact", end),
    )
    out = None
    for test, status, reason, since in rules:
        answer = F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"), (F.lit(None).cast("timestamp") if since is None else since).alias("missing_since"))
        out = F.when(test, answer) if out is None else out.when(test, answer)
    rest = F.struct(F.lit("unobserved").alias("status"), F.lit("expected-run-without-current-fact").alias("reason"), F.coalesce(plus(F.col("departure"), 20), plus(day, 360)).alias("missing_since"))
    return rows.withColumn("_s", out.otherwise(rest)).select(*rows.columns, "_s.*")


def station_priority(rows: DataFrame) -> DataFrame:
    """Score of each station's need; reads ``expected, silent, ambiguous, overdue, silence_minutes, activity``."""
    silence = F.greatest(F.lit(0.0), F.coalesce("silence_minutes", F.lit(720.0)))
    score = F.col("expected") * 4 + F.col("silent") * 18 + F.col("ambiguous") * 14 + F.col("overdue") * 24 + F.least(F.lit(22.0), silence / 30) + F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("activity"))) * 0.08
    return rows.withColumn("score", F.round(score, 4))


def collection_plan(priorities: DataFrame) -> DataFrame:
    """Tier, interval and request weight by score."""
    s = F.col("score")
    tier = F.when(s >= 80, "critical").when(s >= 45, "high").when(s >= 20, "normal").otherwise("low")
    interval = F.when(s >= 80, 2).when(s >= 45, 5).when(s >= 20, 10).otherwise(20)
    return priorities.withColumns({"tier": tier, "interval_minutes": interval, "request_weight": F.least(F.lit(6), F.greatest(F.lit(1), F.ceil(s / 20).cast("int")))})


def source_score(rows: DataFrame) -> DataFrame:
    """Failover order of sources; reads ``source_id, reliability, age_minutes, cadence_minutes, records, failures``."""
    state = F.when(F.col("failures") >= 5, "open").when(F.col("records") == 0, "empty").when(F.col("failures") > 0, "degraded").otherwise("usable")
    fresh = F.greatest(F.lit(0.0), 1 - F.col("age_minutes") / (F.col("cadence_minutes") * 3))
    score = F.when(state.isin("open", "empty"), 0.0).otherwise(F.col("reliability") * 0.55 + fresh * 0.35 + F.least(F.lit(1.0), F.col("records") / 100) * 0.1)
    return rows.withColumn("state", state).withColumn("score", F.round(score, 6))


def failover(rows: DataFrame, key: str) -> DataFrame:
    """The best source with a positive score for each key."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), "source_id")
    return rows.where("score > 0").withColumn("_p", F.row_number().over(order)).where("_p = 1").drop("_p")


def circuit(rows: DataFrame) -> DataFrame:
    """Whether a collector may call, and how long it must wait; reads ``failures``."""
    f = F.col("failures")
    return rows.withColumns({"circuit": F.when(f >= 5, "open").when(f >= 3, "half-open").otherwise("closed"), "retry_minutes": F.when(f >= 5, F.least(F.lit(60), 5 * (f - 4))).when(f >= 3, 2).otherwise(0)})


def merge_itineraries(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union of stops and the longer ordered list; reads ``run_id, stations`` (an ordered array)."""
    both = old.unionByName(new)
    return both.groupBy("run_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("stations")))).alias("known"), F.max_by("stations", F.struct(F.size("stations").alias("n"), F.array_join("stations", ">").alias("t"))).alias("longest"))


def versioned(rows: DataFrame, key: str, order: str, content: Column) -> DataFrame:
    """A version number that grows when the content changes."""
    w = Window.partitionBy(key).orderBy(order)
    marked = rows.withColumn("hash", F.sha2(content, 256))
    changed = F.coalesce(F.col("hash") != F.lag("hash").over(w), F.lit(True)).cast("int")
    return marked.withColumn("_changed", changed).withColumn("version", F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_changed")


def readiness(segments: DataFrame, statuses: DataFrame, linked: DataFrame, states: DataFrame) -> DataFrame:
    """One row: what of the four parts is there, how many are, the status they give, and the expected runs by status.

    ``segments``: the active graph; ``statuses``: expected runs with ``status``; ``linked``: observations that have a run;
    ``states``: current states.  Only whether a table holds a row is asked of three of them.
    """
    some = lambda df, name: df.limit(1).agg((F.count("*") > 0).alias(name))
    kinds = statuses.groupBy("status").agg(F.count("*").alias("n"))
    by_status = kinds.agg(F.sort_array(F.collect_list(F.struct("status", "n"))).alias("statuses"), (F.count("*") > 0).alias("expected_registry"))
    row = by_status
    for part in (some(segments, "graph"), some(linked, "observation_fusion"), some(states, "current_states")):
        row = row.crossJoin(F.broadcast(part))  # one row each
    names = ("graph", "expected_registry", "observation_fusion", "current_states")
    ready = sum((F.col(c).cast("int") for c in names), F.lit(0))
    status = F.when(ready == len(names), "operational").when(ready > 0, "warming").otherwise("insufficient-evidence")
    return row.select(*names, ready.alias("ready_count"), status.alias("status"), "statuses")


def import_progress(chunks: DataFrame, planned: DataFrame, stall_minutes: float = 20) -> DataFrame:
    """Running count, rate, hours left and stalls of an import; ``chunks``: at, chunks; ``planned``: one row.

    One row a moment of arrival, so the running window is over the log of the import, not over its rows.
    """
    order = Window.orderBy("at")
    rows = chunks.crossJoin(F.broadcast(planned))  # one row
    rows = rows.withColumns({"done": F.sum("chunks").over(order.rowsBetween(Window.unboundedPreceding, 0)), "_next": F.lead("at").over(order), "_first": F.min("at").over(Window.partitionBy())})
    hours = (F.unix_micros("at") - F.unix_micros("_first")) / F.lit(3.6e9)
    rate = F.when(hours > 0, F.col("done") / hours)
    pause = (F.unix_micros("_next") - F.unix_micros("at")) / F.lit(60e6)
    return rows.withColumns({"per_hour": F.round(rate, 4), "eta_hours": F.round((F.col("planned") - F.col("done")) / rate, 3), "stalled": F.coalesce(pause > stall_minutes, F.lit(False))}).drop("_next", "_first", "planned")


def operations_view(events: DataFrame, now: Column) -> DataFrame:
    """One row a run: facts, history, worst delay, last station, number of moves and how far its position is to be trusted."""
    order = Window.partitionBy("run_id").orderBy("occurred_at", "event_id")
    rows = events.withColumn("_moved", F.coalesce(F.col("station") != F.lag("station").over(order), F.lit(False)))
    out = rows.groupBy("run_id").agg(F.count("*").alias("facts"), F.array_sort(F.collect_list(F.struct("occurred_at", "event_id", "station"))).alias("history"), F.max("delay_min").alias("worst"), F.count_if("_moved").alias("changes"))
    last = F.element_at("history", -1)
    age = (F.unix_micros(now) - F.unix_micros(last["occurred_at"])) / F.lit(60e6)
    return out.withColumns({"station": last["station"], "position": F.when(age > 180, "unknown").when(age > 90, "stale").otherwise("estimated")})


def alert_rows(events: DataFrame) -> DataFrame:
    """``alert_key, event_id, delay``: holds by run and station, delays by run and half hour, and stations where three runs of a
    day are an hour late; the first event of a key stands for it."""
    hold = F.when(F.col("held"), F.concat_ws(":", F.lit("hold"), "run_id", "station"))
    late = F.when(F.col("delay_min") >= 30, F.concat_ws(":", F.lit("delay"), "run_id", F.expr("delay_min div 30").cast("string")))
    rows = events.select("event_id", "delay_min", F.explode(F.array_compact(F.array(hold, late))).alias("alert_key"))
    own = rows.groupBy("alert_key").agg(F.min("event_id").alias("event_id"), F.max("delay_min").cast("long").alias("delay"))
    network = events.where("delay_min >= 60").groupBy("station", "service_date").agg(F.countDistinct("run_id").alias("runs"), F.min("event_id").alias("event_id"), F.max("delay_min").cast("long").alias("delay"))
    return own.unionByName(network.where("runs >= 3").select(F.concat_ws(":", F.lit("network"), "station", "service_date").alias("alert_key"), "event_id", "delay"))
