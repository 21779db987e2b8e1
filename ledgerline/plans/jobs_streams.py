"""Registered queries: streams over the ledger cut into files, drained, and read back."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.plans.jobs_state import NOON, TS
from ledgerline.plans.proxy import EV, ev
from ledgerline.plans.registry import job
from ledgerline.plans.scratch import scratch_root
from ledgerline.streaming import jobs, open_items

GAP = "24 hours"
#: Where the ledger is cut; each part is a batch of its own, and a last one moves the watermark past all rows.
CUTS = ("2024-01-11 00:00:00", "2024-01-21 00:00:00")
FILES = 2
END, LATE = "~end", "1 hour"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """The state store that timers and map state need, for the streams started inside."""
    name, before = "spark.sql.streaming.stateStore.providerClass", None
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def _path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut_ledger(rows: DataFrame, name: str, cuts: tuple[str, ...] = CUTS) -> DataFrame:
    """The ledger as a stream of files, a batch for each stretch of time, and one row of ``END`` a year later."""
    spark = rows.sparkSession
    path = _path(spark, name)
    at = F.col("occurred_at")
    bounds = [None, *(F.lit(c).cast("timestamp") for c in cuts), None]
    for low, high in zip(bounds, bounds[1:], strict=False):
        part = rows.where((F.lit(True) if low is None else at >= low) & (F.lit(True) if high is None else at < high))
        part.repartition(FILES).write.mode("append").parquet(path)
    last = rows.agg(F.max("occurred_at").alias("occurred_at")).select(*[
        (at + F.expr("INTERVAL 400 DAYS")).alias(f.name) if f.name == "occurred_at" else (F.lit(END).cast(f.dataType) if f.dataType.simpleString() == "string" else F.lit(-1 if f.name == "event_id" else None).cast(f.dataType)).alias(f.name) for f in rows.schema
    ])
    last.repartition(FILES).write.mode("append").parquet(path)
    return jobs.ledger_stream(spark, path, rows.schema, FILES)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives until its input ends, as a table."""
    spark = stream.sparkSession
    path = _path(spark, name)
    with rocks(spark):
        jobs.run_once(stream, path, checkpoint=f"{path}-checkpoint")
    return spark.read.schema(stream.schema).parquet(path)


@job("s1_deduplicated", f"WITH {EV} SELECT event_id, station FROM ev")
def s1(spark, sf):
    rows = ev(spark, sf)
    twice = rows.unionByName(rows.where("event_id % 3 = 0"))
    return drained(jobs.deduplicated(cut_ledger(twice, "s1")).select("event_id", "station"), "s1").where("event_id >= 0")


@job("s2_sessions", f"""WITH {EV}, o AS (SELECT *, CASE WHEN epoch_us(occurred_at) - epoch_us(lag(occurred_at) OVER w) <= 24 * 3600000000::BIGINT THEN 0 ELSE 1 END AS opens FROM ev WINDOW w AS (PARTITION BY train, station ORDER BY occurred_at, event_id)),
n AS (SELECT *, sum(opens) OVER (PARTITION BY train, station ORDER BY occurred_at, event_id ROWS UNBOUNDED PRECEDING) AS session FROM o),
d AS (SELECT train, station, session, domain, max(least(1.0, greatest(0.0, reliability))) AS best FROM n GROUP BY ALL),
g AS (SELECT train, station, session, epoch_us(min(occurred_at)) AS window_start, count(*) AS members, count(DISTINCT source_id)::INTEGER AS sources, count(DISTINCT domain)::INTEGER AS domains FROM n GROUP BY ALL)
SELECT g.train, g.station, window_start, members, sources, domains, round(1 - product(1 - best), 4) AS reliability, CASE WHEN domains >= 2 THEN 'corroborated' ELSE 'single-source' END AS grade FROM g JOIN d USING (train, station, session) GROUP BY ALL""")
def s2(spark, sf):
    stream = cut_ledger(ev(spark, sf).select("train", "station", "occurred_at", "source_id", "domain", "reliability"), "s2")
    return drained(jobs.sessions(stream, GAP, LATE), "s2").select("train", "station", F.unix_micros("window_start").alias("window_start"), "members", "sources", "domains", F.round("reliability", 4).alias("reliability"), "grade")


@job("s3_activity", f"""WITH {EV}, h AS (SELECT station, epoch_us(occurred_at) // 3600000000 AS hour, count(*) AS n, count(DISTINCT run_id) AS runs FROM ev GROUP BY ALL),
e AS (SELECT DISTINCT station, unnest(range(hour + 1, hour + 25)) AS till FROM h),
c AS (SELECT e.station, till, coalesce(sum(n) FILTER (hour = till - 1), 0)::BIGINT AS observations, coalesce(sum(runs) FILTER (hour = till - 1), 0)::BIGINT AS unique_runs, coalesce(sum(n) FILTER (hour < till - 1), 0) / 23.0::DOUBLE AS base FROM e JOIN h ON h.station = e.station AND hour >= till - 24 AND hour < till GROUP BY ALL),
r AS (SELECT *, CASE WHEN base > 0 THEN observations / base WHEN observations > 0 THEN 4.0 ELSE 1.0 END AS ratio FROM c)
SELECT station || ':' || strftime(make_timestamp(till * 3600000000), '%Y-%m-%dT%H') AS score_id, station, till * 3600000000 AS hour_end, observations, unique_runs, round(base, 4) AS baseline_per_hour,
  round(greatest(0.0, least(100.0, ln(1 + observations) * 24 + ln(1 + unique_runs) * 18 + greatest(-12.0, least(28.0, log2(greatest(0.25, ratio)) * 8)))), 1) AS score, round(ratio, 2) AS change_ratio FROM r""")
def s3(spark, sf):
    stream = cut_ledger(ev(spark, sf).select("event_id", "run_id", "station", "occurred_at"), "s3")
    return drained(jobs.activity(stream, late=LATE), "s3").withColumn("hour_end", F.unix_micros("hour_end"))


@job("s4_snapshots", f"WITH {EV} SELECT run_id, (epoch_us(occurred_at) // 900000000) * 900000000 AS bucket, arg_max(event_id, (occurred_at, event_id)) AS event_id FROM ev GROUP BY ALL")
def s4(spark, sf):
    stream = cut_ledger(ev(spark, sf).select("event_id", "run_id", "occurred_at"), "s4")
    return drained(jobs.snapshots(stream, late=LATE), "s4").select("run_id", F.unix_micros("bucket").alias("bucket"), "event_id")


@job("s5_transitions", f"""WITH {EV}, o AS (SELECT *, epoch_us(occurred_at) AS t, lag(station) OVER w AS was, epoch_us(occurred_at) - epoch_us(lag(occurred_at) OVER w) AS gap, epoch_us(lead(occurred_at) OVER w) - epoch_us(occurred_at) AS wait FROM ev WINDOW w AS (PARTITION BY run_id ORDER BY occurred_at, event_id))
SELECT run_id, event_id, CASE WHEN gap <= 360 * 60000000::BIGINT THEN was END AS from_station, station, t AS at FROM o WHERE gap IS NULL OR gap > 360 * 60000000::BIGINT OR station <> was
UNION ALL SELECT run_id, -1, station, name, t + minutes * 60000000::BIGINT FROM o, (VALUES ('stale', 90), ('unknown', 180), ('expired', 360)) AS l(name, minutes) WHERE wait IS NULL OR wait > minutes * 60000000::BIGINT""")
def s5(spark, sf):
    stream = cut_ledger(ev(spark, sf).select("run_id", "event_id", "station", "occurred_at"), "s5")
    return drained(jobs.transitions(stream), "s5").where(F.col("run_id") != END).select("run_id", "event_id", "from_station", "station", F.unix_micros("occurred_at").alias("at"))


ITEMS = f"""{EV}, items AS (SELECT train::VARCHAR AS key, CASE station WHEN 'signup' THEN 'prediction' WHEN 'error' THEN 'anomaly' ELSE 'hypothesis' END AS kind, event_id AS id, epoch_us(occurred_at) AS t0,
  epoch_us(occurred_at) + CASE station WHEN 'signup' THEN 54 * 3600 WHEN 'error' THEN 45 * 60 ELSE (event_id % 30) * 3600 END * 1000000::BIGINT AS until FROM ev WHERE station <> 'purchase'),
facts AS (SELECT train::VARCHAR AS key, event_id AS fact_id, epoch_us(occurred_at) AS fact_at FROM ev WHERE station = 'purchase')"""


def _tagged(spark: SparkSession, sf: str, name: str, forever: bool = False) -> DataFrame:
    stream = cut_ledger(ev(spark, sf).select("event_id", F.col("train").cast("string").alias("key"), "station", "occurred_at"), name)
    rows = stream.select("key", "station", F.col("event_id").alias("id"), F.col("occurred_at").alias("at"))
    kind = F.when(F.col("station") == "signup", open_items.PREDICTION).when(F.col("station") == "error", open_items.ANOMALY).otherwise(open_items.HYPOTHESIS)
    until = F.when(F.col("station") == "signup", F.col("at") + F.expr("INTERVAL 48 HOURS")).otherwise(F.timestamp_micros(F.unix_micros("at") + F.col("id") % 30 * 3_600_000_000))
    items = rows.where(F.col("station") == "signup").withColumn("until", F.lit(None).cast("timestamp")) if forever else rows.where(F.col("station") != "purchase").withColumn("until", until)
    return open_items.ended(open_items.standing(items.withColumn("kind", kind), rows.where(F.col("station").isin("purchase", END))))


@job("s6_open_items", f"""WITH {ITEMS}, p AS (SELECT i.key, id, t0, until, min((fact_at, fact_id)) AS f FROM items i LEFT JOIN facts f ON f.key = i.key AND kind = 'prediction' AND fact_at > t0 AND fact_at <= until GROUP BY ALL)
SELECT i.key, kind, i.id, CASE WHEN f[1] IS NOT NULL OR kind = 'anomaly' THEN 'resolved' ELSE 'expired' END AS status, coalesce(f[1], i.until) AS "at", f[2] AS fact_id FROM items i JOIN p ON p.key = i.key AND p.id = i.id""")
def s6(spark, sf):
    return drained(_tagged(spark, sf, "s6"), "s6").where(F.col("key") != END).withColumn("at", F.unix_micros("at"))


@job("s7_late_rows", f"WITH {EV} SELECT event_id, epoch_us({TS}) - epoch_us(occurred_at) <= 36 * 3600000000::BIGINT AS fused FROM ev")
def s7(spark, sf):
    path = _path(spark, "s7")
    stream = cut_ledger(ev(spark, sf).select("event_id", "occurred_at"), "s7")
    fused = lambda batch: batch.select("event_id").write.mode("append").parquet(f"{path}/fused")
    jobs.with_ledger(stream, f"{path}/ledger", fused, F.lit(NOON).cast("timestamp"), checkpoint=f"{path}/checkpoint").awaitTermination()
    went = spark.read.schema("event_id long").parquet(f"{path}/fused").withColumn("fused", F.lit(True))
    return spark.read.parquet(f"{path}/ledger").where("event_id >= 0").select("event_id").join(went, "event_id", "left").select("event_id", F.coalesce("fused", F.lit(False)).alias("fused"))


@job("s8_coverage_gaps", f"""WITH {EV}, cuts AS (SELECT * FROM (VALUES (0, TIMESTAMP '{CUTS[0]}'), (1, TIMESTAMP '{CUTS[1]}'), (2, TIMESTAMP '2100-01-01')) AS c(batch, till)),
seen AS (SELECT batch, run_id, epoch_us(max(occurred_at)) AS last_at FROM ev JOIN cuts ON occurred_at < till GROUP BY ALL),
gap AS (SELECT batch, run_id, CASE WHEN max(last_at) OVER (PARTITION BY batch) - last_at > 180 * 60000000::BIGINT THEN last_at END AS since FROM seen),
pair AS (SELECT n.batch, n.run_id, o.since AS was, n.since FROM gap n LEFT JOIN gap o ON o.run_id = n.run_id AND o.batch = n.batch - 1)
SELECT batch, run_id, CASE WHEN was IS NULL THEN 'opened' WHEN since IS NULL THEN 'resolved' ELSE 'updated' END AS status, coalesce(was, since) AS since FROM pair WHERE was IS NOT NULL OR since IS NOT NULL""")
def s8(spark, sf):
    path = _path(spark, "s8")
    stream = cut_ledger(ev(spark, sf).select("run_id", "occurred_at"), "s8")
    jobs.coverage_gaps(stream, path, 180, f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/changes").where(f"batch < {len(CUTS) + 1}").select(F.col("batch").cast("int").alias("batch"), "run_id", "status", F.unix_micros("since").alias("since"))


@job("s10_resolution", f"WITH {ITEMS} SELECT id AS prediction_id, min((fact_at, fact_id))[2] AS fact_id, min((fact_at, fact_id))[1] AS fact_at FROM items i JOIN facts f ON f.key = i.key AND fact_at > t0 WHERE kind = 'prediction' GROUP BY id")
def s10(spark, sf):
    return drained(_tagged(spark, sf, "s10", True), "s10").where("status = 'resolved'").select(F.col("id").alias("prediction_id"), "fact_id", F.unix_micros("at").alias("fact_at"))
