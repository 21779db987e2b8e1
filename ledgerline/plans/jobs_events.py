"""Registered queries: fusion, segments, activity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import fusion, segments
from ledgerline.plans.proxy import EV, SEG, ev, seg
from ledgerline.plans.registry import job

#: The proxy ledger is sparse, so registered sessions use a gap of a day.
GAP = 24 * 60
W = "least(1.0::DOUBLE, greatest(0.0::DOUBLE, reliability)) * CASE authority WHEN 'official' THEN 1.0::DOUBLE WHEN 'operator' THEN 0.97::DOUBLE WHEN 'reference' THEN 0.72::DOUBLE ELSE 0.62::DOUBLE END"
SESSIONS = f"""{EV}, opened AS (SELECT *, {W} AS w, CASE WHEN epoch_us(occurred_at) - epoch_us(lag(occurred_at) OVER o) <= {GAP} * 60000000::BIGINT THEN 0 ELSE 1 END AS opens
  FROM ev WINDOW o AS (PARTITION BY train, station ORDER BY occurred_at, event_id)),
s AS (SELECT *, (sum(opens) OVER (PARTITION BY train, station ORDER BY occurred_at, event_id ROWS UNBOUNDED PRECEDING))::INTEGER AS session FROM opened)"""


def _us(*names: str):
    return [F.unix_micros(n).alias(n) for n in names]


@job("e1_fusion_simple", f"""WITH {SESSIONS} SELECT train, station, session, count(*) AS members, count(DISTINCT source_id) AS sources,
  arg_min(event_id, (-w, occurred_at, event_id)) AS primary_event_id, round(1 - product(1 - least(1.0, w)), 6) AS reliability,
  epoch_us(min(occurred_at)) AS window_start, epoch_us(max(occurred_at)) AS window_end FROM s GROUP BY ALL""")
def e1(spark, sf):
    out = fusion.fuse_simple(ev(spark, sf), GAP)
    return out.select("train", "station", "session", "members", "sources", "primary_event_id", "reliability", *_us("window_start", "window_end"))


@job("e2_fusion_domains", f"""WITH {SESSIONS}, dom AS (SELECT train, station, session, domain, max(w) AS best FROM s GROUP BY ALL),
eff AS (SELECT train, station, session, count(*) AS domains, 1 - product(1 - least(0.96, best)) AS effective FROM dom GROUP BY ALL),
g AS (SELECT train, station, session, count(*) AS members, count(DISTINCT source_id) AS sources, count(DISTINCT run_id) AS runs, min(occurred_at) AS a, max(occurred_at) AS b,
  arg_min({{'e': event_id, 'r': run_id, 'a': authority}}, (-w, -epoch_us(occurred_at), event_id)) AS top FROM s GROUP BY ALL),
j AS (SELECT *, (epoch_us(b) - epoch_us(a)) / 60e6 AS spread FROM g JOIN eff USING (train, station, session)),
c AS (SELECT *, (runs > 1)::INTEGER + (spread > greatest(12, {GAP} * 0.75))::INTEGER AS n FROM j),
p AS (SELECT *, round(greatest(0.05, 1 - least(0.8, n * 0.18 + least(1.0, spread / {GAP}) * 0.22)), 4) AS consensus FROM c)
SELECT train, station, session, members, sources, domains, top.e AS primary_event_id, top.r AS primary_run_id, epoch_us(a) AS window_start, epoch_us(b) AS window_end,
  round(spread, 1) AS spread_minutes, consensus, round(least(0.99, effective * consensus), 6) AS reliability,
  CASE WHEN n > 0 THEN 'conflict' WHEN domains >= 2 AND effective >= 0.8 THEN 'corroborated' WHEN top.a = 'official' THEN 'official-single' ELSE 'single-source' END AS grade,
  concat_ws(',', CASE WHEN runs > 1 THEN 'run-identity-conflict' END, CASE WHEN spread > greatest(12, {GAP} * 0.75) THEN 'temporal-spread' END) AS conflicts FROM p""")
def e2(spark, sf):
    out = fusion.fuse_domains(ev(spark, sf), GAP)
    return out.withColumns({c: F.unix_micros(c) for c in ("window_start", "window_end")})


@job("e3_weighted_median", f"""WITH {SESSIONS}, u AS (SELECT *, greatest(0.05, w) AS w5 FROM s),
c AS (SELECT *, sum(w5) OVER (PARTITION BY train, station, session ORDER BY occurred_at, event_id ROWS UNBOUNDED PRECEDING) AS upto, sum(w5) OVER (PARTITION BY train, station, session) AS total FROM u)
SELECT train, station, session, epoch_us(min(occurred_at) FILTER (upto >= total / 2 - 1e-9)) AS median_at FROM c GROUP BY ALL""")
def e3(spark, sf):
    return fusion.weighted_median_time(ev(spark, sf), GAP).select("train", "station", "session", *_us("median_at"))


@job("e4_service_fusion", f"""WITH {EV} SELECT run_id, arg_min(station, (-({W}), -epoch_us(occurred_at), event_id)) AS station, arg_min(delay_min, (-({W}), -epoch_us(occurred_at), event_id)) AS delay_min,
  round(arg_min(reliability, (-({W}), -epoch_us(occurred_at), event_id)), 4) AS reliability, array_to_string(list_sort(list(DISTINCT source_id)), ',') AS sources,
  array_to_string(list_sort(list(DISTINCT strftime(occurred_at, '%H:%M') || '@' || station)), ',') AS calls, count(*) AS reports FROM ev GROUP BY run_id""")
def e4(spark, sf):
    return fusion.fuse_by_service(ev(spark, sf)).withColumn("reliability", F.round("reliability", 4))


@job("e5_priority_merge", f"""WITH {EV} SELECT run_id, station, event_id, authority FROM (SELECT *, row_number() OVER (PARTITION BY run_id, station ORDER BY
  CASE authority WHEN 'official' THEN 3 WHEN 'operator' THEN 2 WHEN 'reference' THEN 1 ELSE 0 END DESC, event_id DESC) AS place FROM ev) WHERE place = 1""")
def e5(spark, sf):
    rank = F.when(F.col("authority") == "official", 3).when(F.col("authority") == "operator", 2).when(F.col("authority") == "reference", 1).otherwise(0)
    return fusion.merge_by_priority(ev(spark, sf), ["run_id", "station"], rank, [F.col("event_id").desc()]).select("run_id", "station", "event_id", "authority")


_H = "round(m * 100)::HUGEINT"
MOMENTS = f"((20 * sum({_H}) + count(*)) // (2 * count(*)))::DOUBLE / 1000 AS mean_minutes, ((2 * (count(*) * sum({_H} * {_H}) - sum({_H}) * sum({_H})) + 100 * count(*) * count(*)) // (200 * count(*) * count(*)))::DOUBLE / 100 AS variance_minutes"
PLAUSIBLE = f"""{EV}, {SEG}, ok AS (SELECT *, round(minutes, 2) AS m FROM seg WHERE minutes > 1 AND minutes < 720)"""
STATS = f"""{PLAUSIBLE}, kept AS (SELECT *, row_number() OVER (PARTITION BY train, from_station, to_station ORDER BY to_at DESC, event_id DESC) AS place FROM ok QUALIFY place <= 200),
stats AS (SELECT train, from_station, to_station, {MOMENTS}, count(*) AS sample_count,
  list_sort(list(m))[(floor((count(*) - 1) * 0.1 + 0.5) + 1)::INTEGER] AS p10, list_sort(list(m))[(floor((count(*) - 1) * 0.5 + 0.5) + 1)::INTEGER] AS p50,
  list_sort(list(m))[(floor((count(*) - 1) * 0.9 + 0.5) + 1)::INTEGER] AS p90 FROM kept GROUP BY train, from_station, to_station)"""


@job("e6_segment_stats", f"WITH {STATS} SELECT * FROM stats")
def e6(spark, sf):
    return segments.segment_stats(seg(spark, sf))


@job("e6_segment_stats_all_trains", f"""WITH {PLAUSIBLE}, kept AS (SELECT *, row_number() OVER (PARTITION BY train, from_station, to_station ORDER BY to_at DESC, event_id DESC) AS place FROM ok QUALIFY place <= 200)
SELECT from_station, to_station, {MOMENTS}, count(*) AS sample_count,
  list_sort(list(m))[(floor((count(*) - 1) * 0.1 + 0.5) + 1)::INTEGER] AS p10, list_sort(list(m))[(floor((count(*) - 1) * 0.5 + 0.5) + 1)::INTEGER] AS p50,
  list_sort(list(m))[(floor((count(*) - 1) * 0.9 + 0.5) + 1)::INTEGER] AS p90 FROM kept GROUP BY from_station, to_station""")
def e6_all(spark, sf):
    return segments.segment_stats(seg(spark, sf), ["from_station", "to_station"])


@job("f1_recovered_minutes", f"WITH {EV}, {SEG} SELECT event_id, run_id, from_station, to_station, round(minutes, 3) AS minutes, delay_in, delay_out, delay_in - delay_out AS recovered_minutes FROM seg")
def f1(spark, sf):
    return segments.recovered(seg(spark, sf)).select("event_id", "run_id", "from_station", "to_station", F.round("minutes", 3).alias("minutes"), "delay_in", "delay_out", "recovered_minutes")


@job("f2_rolling_mean", f"""WITH {EV}, {SEG} SELECT event_id, round(avg(minutes) OVER w, 4) AS rolling_minutes, count(*) OVER w AS rolling_count FROM seg
  WINDOW w AS (PARTITION BY train, from_station, to_station ORDER BY to_at, event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)""")
def f2(spark, sf):
    return segments.rolling_mean(seg(spark, sf)).select("event_id", F.round("rolling_minutes", 4).alias("rolling_minutes"), "rolling_count")


@job("e27_train_spread", f"WITH {STATS} SELECT train, round(sum((p90 - p10) * sample_count) / sum(sample_count), 5) AS spread_minutes, sum(sample_count)::BIGINT AS samples FROM stats GROUP BY train")
def e27(spark, sf):
    return segments.train_spread(segments.segment_stats(seg(spark, sf)))


DAY = "2024-01-15 12:00:00"
ACTIVITY = f"""{EV}, aged AS (SELECT *, (epoch_us(TIMESTAMP '{DAY}') - epoch_us(occurred_at)) / 3.6e9 AS age FROM ev),
cnt AS (SELECT station, count(*) FILTER (age < 1) AS observations, count(DISTINCT run_id) FILTER (age < 1) AS unique_runs, (count(*) FILTER (age >= 1)) / 23.0::DOUBLE AS base FROM aged WHERE age >= 0 AND age < 24 GROUP BY station),
rat AS (SELECT *, CASE WHEN base > 0 THEN observations / base WHEN observations > 0 THEN 4.0 ELSE 1.0 END AS ratio FROM cnt),
act AS (SELECT station, observations, unique_runs, round(base, 4) AS baseline_per_hour,
  round(greatest(0.0, least(100.0, ln(1 + observations) * 24 + ln(1 + unique_runs) * 18 + greatest(-12.0, least(28.0, log2(greatest(0.25, ratio)) * 8)))), 1) AS score, round(ratio, 2) AS change_ratio FROM rat)"""


@job("e7_node_activity", f"WITH {ACTIVITY} SELECT * FROM act")
def e7(spark, sf):
    return segments.node_activity(ev(spark, sf), DAY)


@job("e8_activity_anomalies", f"""WITH {ACTIVITY}
SELECT station, 'activity_spike' AS kind, CASE WHEN change_ratio >= 6 THEN 'high' ELSE 'medium' END AS severity, round(least(1.0, change_ratio / 8), 4) AS level FROM act WHERE observations >= 4 AND change_ratio >= 3
UNION ALL SELECT station, 'activity_drop', CASE WHEN baseline_per_hour >= 8 THEN 'high' ELSE 'medium' END, round(least(1.0, baseline_per_hour / 10), 4) FROM act WHERE observations = 0 AND baseline_per_hour >= 3""")
def e8(spark, sf):
    return segments.activity_anomalies(segments.node_activity(ev(spark, sf), DAY))


@job("e9_corridor_score", f"""WITH {ACTIVITY}, corridor AS (SELECT r_name AS corridor, unnest(list_distinct(list(['click', 'view', 'error', 'signup', 'purchase'][(n_nationkey % 5 + 1)::INTEGER]))) AS station FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name)
SELECT corridor, round(avg(coalesce(score, 0)), 4) AS score, count(*) AS nodes FROM corridor LEFT JOIN act USING (station) GROUP BY corridor""")
def e9(spark, sf):
    from ledgerline.plans.proxy import table

    nodes = F.element_at(F.array(*map(F.lit, ("click", "view", "error", "signup", "purchase"))), (F.col("n_nationkey") % 5 + 1).cast("int"))
    corridor = table(spark, sf, "region").join(table(spark, sf, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("corridor"), nodes.alias("station")).distinct()
    scores = segments.node_activity(ev(spark, sf), DAY).select("station", "score")
    return corridor.join(scores, "station", "left").groupBy("corridor").agg(F.round(F.avg(F.coalesce("score", F.lit(0.0))), 4).alias("score"), F.count("*").alias("nodes"))


@job("e15_segment_disruptions", f"""WITH {EV}, {SEG}, obs AS (SELECT from_station, to_station, run_id, CASE WHEN delay_out >= 80 THEN 'held' ELSE 'delayed' END AS state, delay_out AS delay FROM seg WHERE delay_out >= 60),
g AS (SELECT from_station, to_station, count(DISTINCT run_id) AS runs, max(greatest(0, coalesce(delay, 0))) AS max_delay, max((state = 'held')::INTEGER) AS held FROM obs GROUP BY ALL),
k AS (SELECT *, CASE WHEN held = 1 THEN runs >= 2 ELSE runs >= 3 END AS sure FROM g)
SELECT from_station, to_station, runs, max_delay, round(least(1.0, 0.48 + runs * 0.14 + least(0.15, max_delay / 1200::DOUBLE)) * CASE WHEN sure THEN 1.0 ELSE 0.78 END, 3) AS confidence,
  CASE WHEN max_delay >= 180 OR runs >= 3 THEN 'high' WHEN runs >= 2 THEN 'medium' ELSE 'low' END AS severity, CASE WHEN sure THEN 'probable' ELSE 'possible' END AS status, CASE WHEN held = 1 THEN 'traffic_hold' ELSE 'mass_delay' END AS kind FROM k""")
def e15(spark, sf):
    rows = seg(spark, sf).where("delay_out >= 60").select("from_station", "to_station", "run_id", F.when(F.col("delay_out") >= 80, "held").otherwise("delayed").alias("state"), F.col("delay_out").alias("delay"))
    return segments.disruptions(rows)


@job("e32_node_facts", f"WITH {EV} SELECT station, epoch_us(min(occurred_at)) AS first_seen, epoch_us(max(occurred_at)) AS last_seen, count(*) AS facts FROM ev GROUP BY station")
def e32(spark, sf):
    return segments.consolidate_nodes(ev(spark, sf)).select("station", *_us("first_seen", "last_seen"), "facts")
