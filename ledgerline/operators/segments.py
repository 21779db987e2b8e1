"""Travel between consecutive stations, and what is learned from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.scalars import clamp
from ledgerline.plans.ranks import nearest_rank


def consecutive_segments(events: DataFrame) -> DataFrame:
    """Rows where a run reports another station than before, with the travel minutes and delays at both ends."""
    order = Window.partitionBy("run_id").orderBy("occurred_at", "event_id")
    before = {"from_station": "station", "from_at": "occurred_at", "delay_in": "delay_min"}
    rows = events.withColumns({k: F.lag(v).over(order) for k, v in before.items()}).where("from_station <> station")
    minutes = (F.unix_micros("occurred_at") - F.unix_micros("from_at")) / F.lit(60e6)
    return rows.select("event_id", "run_id", "train", "from_station", F.col("station").alias("to_station"), "from_at", F.col("occurred_at").alias("to_at"), minutes.alias("minutes"), "delay_in", F.col("delay_min").alias("delay_out"))


def recovered(segments: DataFrame) -> DataFrame:
    """Minutes of delay made up on each segment."""
    return segments.withColumn("recovered_minutes", F.col("delay_in") - F.col("delay_out"))


def plausible(segments: DataFrame, low: float = 1, high: float = 720) -> DataFrame:
    return segments.where((F.col("minutes") > low) & (F.col("minutes") < high))


def last_of_key(segments: DataFrame, keep: int = 200) -> DataFrame:
    """The newest observations of each (train, from, to)."""
    newest = Window.partitionBy("train", "from_station", "to_station").orderBy(F.col("to_at").desc(), F.col("event_id").desc())
    return segments.withColumn("_place", F.row_number().over(newest)).where(F.col("_place") <= keep).drop("_place")


def segment_stats(segments: DataFrame, keys: list[str] | None = None, keep: int = 200) -> DataFrame:
    """Mean, population variance and nearest-rank percentiles of the last travel times of each key."""
    keys = keys or ["train", "from_station", "to_station"]
    rows = last_of_key(plausible(segments), keep).withColumn("minutes", F.round("minutes", 2)).withColumn("_h", F.round(F.col("minutes") * 100).cast("long"))
    ranks = nearest_rank(rows, keys, "minutes", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    # sums of whole hundredths and of their squares, rounded once, do not depend on the order of the rows
    sums = {"_n": F.count("*"), "_s": F.sum("_h"), "_q": F.sum(F.col("_h") * F.col("_h"))}
    moments = rows.groupBy(*keys).agg(*[v.cast("decimal(18,0)").alias(k) for k, v in sums.items()])
    mean, variance = F.expr("(20 * _s + _n) div (2 * _n)") / 1000, F.expr("(2 * (_n * _q - _s * _s) + 100 * _n * _n) div (200 * _n * _n)") / 100
    moments = moments.select(*keys, mean.alias("mean_minutes"), variance.alias("variance_minutes"))
    return moments.join(ranks.withColumnRenamed("n", "sample_count"), keys)


def replay(facts: DataFrame, stats: DataFrame, least: int) -> DataFrame:
    """``event_id, minutes, learned_from, sample_count, p50``: each fact with what its own train has learned of its segment.

    Where that is nothing, the train with most samples of the segment stands in, if it has ``least``.  So a fact meets its own
    row and one for all, never the trains of its segment.  Of facts that share an id one is kept, own ones first.
    """
    pair = ["from_station", "to_station"]
    learned = F.struct(F.col("train").alias("learned_from"), "sample_count", "p50")
    own = stats.select("train", *pair, learned.alias("own"))
    most = stats.where(F.col("sample_count") >= least).groupBy(*pair).agg(F.min_by(learned, F.struct(-F.col("sample_count"), F.col("train"))).alias("most"))
    rows = facts.select("event_id", "train", *pair, "minutes").join(own, ["train", *pair], "left").join(most, pair, "left").withColumn("best", F.coalesce("own", "most")).where("best IS NOT NULL")
    order = Window.partitionBy("event_id").orderBy(F.col("own").isNull(), F.desc("best.sample_count"), "best.learned_from")
    return rows.withColumn("_place", F.row_number().over(order)).where("_place = 1").select("event_id", "minutes", "best.*")


def rolling_mean(segments: DataFrame, last: int = 200) -> DataFrame:
    """Mean of each observation with up to ``last - 1`` earlier ones of its key."""
    frame = Window.partitionBy("train", "from_station", "to_station").orderBy("to_at", "event_id").rowsBetween(1 - last, 0)
    return segments.withColumn("rolling_minutes", F.avg("minutes").over(frame)).withColumn("rolling_count", F.count("*").over(frame))


def train_spread(stats: DataFrame) -> DataFrame:
    """Spread per train, weighted by sample count."""
    spread = F.sum((F.col("p90") - F.col("p10")) * F.col("sample_count")) / F.sum("sample_count")
    return stats.groupBy("train").agg(F.round(spread, 5).alias("spread_minutes"), F.sum("sample_count").alias("samples"))


def node_activity(events: DataFrame, now: str, baseline_hours: int = 23) -> DataFrame:
    """Reports in the last hour against the hours before, per station, with a bounded log score."""
    at = F.lit(now).cast("timestamp")
    age = (F.unix_micros(at) - F.unix_micros("occurred_at")) / F.lit(3.6e9)
    rows = events.withColumn("age", age).where((F.col("age") >= 0) & (F.col("age") < baseline_hours + 1))
    current = F.col("age") < 1
    counts = rows.groupBy("station").agg(F.count_if(current).alias("observations"), F.countDistinct(F.when(current, F.col("run_id"))).alias("unique_runs"), (F.count_if(~current) / baseline_hours).alias("baseline_per_hour"))
    return activity_score(counts).select("station", "observations", "unique_runs", "baseline_per_hour", "score", "change_ratio")


def activity_score(counts: DataFrame) -> DataFrame:
    """``score`` and ``change_ratio`` of rows with ``observations``, ``unique_runs`` and ``baseline_per_hour``."""
    ratio = F.when(F.col("baseline_per_hour") > 0, F.col("observations") / F.col("baseline_per_hour")).when(F.col("observations") > 0, 4.0).otherwise(1.0)
    counts = counts.withColumn("ratio", ratio)
    score = F.log1p("observations") * 24 + F.log1p("unique_runs") * 18 + F.greatest(F.lit(-12.0), F.least(F.lit(28.0), F.log2(F.greatest(F.lit(0.25), F.col("ratio"))) * 8))
    return counts.withColumns({"baseline_per_hour": F.round("baseline_per_hour", 4), "score": F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 1), "change_ratio": F.round("ratio", 2)}).drop("ratio")


def activity_anomalies(activity: DataFrame) -> DataFrame:
    """Spikes (4 or more, threefold) and drops (none where three an hour are usual)."""
    spike = (F.col("observations") >= 4) & (F.col("change_ratio") >= 3)
    drop = (F.col("observations") == 0) & (F.col("baseline_per_hour") >= 3)
    kind = F.when(spike, "activity_spike").when(drop, "activity_drop")
    severity = F.when(spike & (F.col("change_ratio") >= 6) | drop & (F.col("baseline_per_hour") >= 8), "high").otherwise("medium")
    level = F.when(spike, F.least(F.lit(1.0), F.col("change_ratio") / 8)).otherwise(F.least(F.lit(1.0), F.col("baseline_per_hour") / 10))
    return activity.withColumn("kind", kind).where("kind IS NOT NULL").select("station", "kind", severity.alias("severity"), F.round(level, 4).alias("level"))


def disruptions(observations: DataFrame) -> DataFrame:
    """Segments that several runs report as disturbed; rows hold ``from_station, to_station, run_id, state, delay``."""
    groups = observations.groupBy("from_station", "to_station").agg(F.countDistinct("run_id").alias("runs"), F.max(F.greatest(F.lit(0), F.coalesce("delay", F.lit(0)))).alias("max_delay"), F.max((F.col("state") == "held").cast("int")).alias("held"))
    sure = F.when(F.col("held") == 1, F.col("runs") >= 2).otherwise(F.col("runs") >= 3)
    confidence = clamp(F.lit(0.48) + F.col("runs") * 0.14 + F.least(F.lit(0.15), F.col("max_delay") / 1200))
    severity = F.when((F.col("max_delay") >= 180) | (F.col("runs") >= 3), "high").when(F.col("runs") >= 2, "medium").otherwise("low")
    return groups.select("from_station", "to_station", "runs", "max_delay", F.round(confidence * F.when(sure, 1.0).otherwise(0.78), 3).alias("confidence"), severity.alias("severity"), F.when(sure, "probable").otherwise("possible").alias("status"), F.when(F.col("held") == 1, "traffic_hold").otherwise("mass_delay").alias("kind"))


def consolidate_nodes(events: DataFrame) -> DataFrame:
    return events.groupBy("station").agg(F.min("occurred_at").alias("first_seen"), F.max("occurred_at").alias("last_seen"), F.count("*").alias("facts"))
