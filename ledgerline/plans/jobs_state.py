"""Registered queries: state, linking, publication."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.operators import fusion, linking, publish, segments, state
from ledgerline.plans.jobs_events import GAP, SESSIONS, STATS
from ledgerline.plans.proxy import EV, ev, seg, table
from ledgerline.plans.registry import job

NOON = "2024-01-15 12:00:00"


def now_at():
    return F.lit(NOON).cast("timestamp")


TS = f"TIMESTAMP '{NOON}'"
AGE = f"((epoch_us({TS}) - epoch_us(occurred_at)) / 60e6)"


@job("f3_latest_per_node", f"WITH {EV} SELECT station, event_id, run_id FROM ev QUALIFY row_number() OVER (PARTITION BY station ORDER BY occurred_at DESC, event_id DESC) = 1")
def f3(spark, sf):
    return state.as_of(ev(spark, sf), "station", F.lit("2030-01-01").cast("timestamp"), "occurred_at", "event_id").select("station", "event_id", "run_id")


@job("d5_timeline_as_of", f"WITH {EV} SELECT run_id, event_id, station FROM ev WHERE {AGE} >= 0 AND {AGE} < 360 QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY occurred_at DESC, event_id DESC) = 1")
def d5(spark, sf):
    return state.as_of(ev(spark, sf), "run_id", now_at(), "occurred_at", "event_id", 6).select("run_id", "event_id", "station")


@job("d4_as_of_join", f"""WITH {EV}, a AS (SELECT train, event_id, occurred_at FROM ev WHERE station = 'view'), b AS (SELECT train, event_id AS fact, occurred_at AS fact_at FROM ev WHERE station = 'click')
SELECT a.event_id, arg_max(fact, fact_at) AS fact, epoch_us(max(fact_at)) AS fact_at FROM a LEFT JOIN b ON a.train = b.train AND fact_at <= a.occurred_at GROUP BY a.event_id""")
def d4(spark, sf):
    e = ev(spark, sf)
    left = e.where("station = 'view'").select("train", "event_id", "occurred_at")
    right = e.where("station = 'click'").select("train", F.col("event_id").alias("fact"), F.col("occurred_at").alias("fact_at"))
    out = state.as_of_join(left, right, ["train"], "occurred_at", "fact_at", ["fact"])
    return out.select("event_id", F.col("last_fact").alias("fact"), F.unix_micros("last_fact_at").alias("fact_at"))


FIRST = f"""{EV}, p AS (SELECT train, event_id AS prediction_id, occurred_at AS predicted_at, delay_min FROM ev WHERE station = 'signup'), f AS (SELECT train, event_id AS fact_id, occurred_at AS fact_at FROM ev WHERE station = 'purchase'),
r AS (SELECT prediction_id, predicted_at, delay_min, arg_min(fact_id, fact_at) AS fact_id, min(fact_at) AS fact_at FROM p LEFT JOIN f ON p.train = f.train AND fact_at > predicted_at GROUP BY ALL)"""


def _first(spark, sf):
    e = ev(spark, sf)
    p = e.where("station = 'signup'").select("train", F.col("event_id").alias("prediction_id"), F.col("occurred_at").alias("predicted_at"), "delay_min")
    return state.first_after(p, e.where("station = 'purchase'"), ["train"], "predicted_at", "occurred_at", "event_id")


@job("d6_first_fact_after", f"WITH {FIRST} SELECT prediction_id, fact_id, epoch_us(fact_at) AS fact_at FROM r")
def d6(spark, sf):
    return _first(spark, sf).select("prediction_id", "fact_id", F.unix_micros("fact_at").alias("fact_at"))


@job("m10_prediction_evaluation", f"""WITH {FIRST}, k AS (SELECT *, (epoch_us(fact_at) - epoch_us(predicted_at)) / 60e6 AS actual FROM r WHERE fact_at IS NOT NULL)
SELECT prediction_id, round(abs(actual - delay_min * 30), 3) AS error_minutes, actual BETWEEN delay_min * 15 AND delay_min * 60 AS within_p80 FROM k""")
def m10(spark, sf):
    actual = (F.unix_micros("fact_at") - F.unix_micros("predicted_at")) / F.lit(60e6)
    rows = _first(spark, sf).where("fact_at IS NOT NULL").withColumn("actual", actual)
    return rows.select("prediction_id", F.round(F.abs(F.col("actual") - F.col("delay_min") * 30), 3).alias("error_minutes"), F.col("actual").between(F.col("delay_min") * 15, F.col("delay_min") * 60).alias("within_p80"))


ISLANDS = f"""{EV}, mv AS (SELECT *, lag(station) OVER w AS before, CASE WHEN station = lag(station) OVER w THEN 0 ELSE 1 END AS moved FROM ev WINDOW w AS (PARTITION BY run_id ORDER BY occurred_at, event_id)),
il AS (SELECT *, sum(moved) OVER (PARTITION BY run_id ORDER BY occurred_at, event_id ROWS UNBOUNDED PRECEDING) AS island FROM mv),
st AS (SELECT run_id, island, first(station) AS station, count(*) AS repeats, min(occurred_at) AS since, max(occurred_at) AS until, arg_min({{'b': before}}, (occurred_at, event_id)).b AS previous FROM il GROUP BY run_id, island),
tail AS (SELECT *, round((epoch_us(until) - epoch_us(since)) / 60e6, 1) AS dwell_minutes FROM st QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY island DESC) = 1)"""


@job("f4_tail_island", f"WITH {ISLANDS} SELECT run_id, station, repeats, previous, dwell_minutes FROM tail")
def f4(spark, sf):
    return state.tail_islands(ev(spark, sf)).select("run_id", "station", "repeats", "previous", "dwell_minutes")


STATE = f"""{ISLANDS}, inp AS (SELECT run_id, until, repeats, dwell_minutes, CASE WHEN epoch_us({TS}) - epoch_us(until) > 180 * 60000000::BIGINT THEN 'unknown' WHEN epoch_us({TS}) - epoch_us(until) > 90 * 60000000::BIGINT THEN 'stale' ELSE 'estimated' END AS position,
  repeats >= 3 AS held, (repeats % 10) / 10.0::DOUBLE AS progress, until + to_minutes(40) AS eta_end FROM tail WHERE until BETWEEN {TS} - INTERVAL 1 DAY AND {TS}),
sta AS (SELECT *, greatest(0.0, (epoch_us({TS}) - epoch_us(until)) / 60e6) AS age, (epoch_us({TS}) - epoch_us(eta_end)) / 60e6 AS overdue FROM inp),
lab AS (SELECT run_id, CASE WHEN held AND position <> 'unknown' THEN 'held' WHEN position = 'unknown' THEN 'unknown' WHEN position = 'stale' THEN 'stale' WHEN repeats >= 2 AND dwell_minutes >= 2 AND age <= 20 THEN 'dwelling' WHEN age <= 5 THEN 'at_station' WHEN overdue > 0 THEN 'overdue' WHEN progress < 0.18 THEN 'departing' WHEN progress >= 0.78 THEN 'approaching' ELSE 'in_transit' END AS state FROM sta)"""


@job("m7_operational_state", f"WITH {STATE} SELECT run_id, state, round(0.8::DOUBLE * CASE WHEN state IN ('at_station', 'dwelling', 'held') THEN 1.0 WHEN state = 'stale' THEN 0.55 WHEN state = 'unknown' THEN 0.0 ELSE 0.85 END, 4) AS state_confidence FROM lab")
def m7(spark, sf):
    rows = state.tail_islands(ev(spark, sf)).where((F.col("until") <= now_at()) & (F.unix_micros(now_at()) - F.unix_micros("until") <= 86_400_000_000))
    age = (F.unix_micros(now_at()) - F.unix_micros("until")) / F.lit(60e6)
    rows = rows.withColumns({"position": F.when(age > 180, "unknown").when(age > 90, "stale").otherwise("estimated"), "held": F.col("repeats") >= 3, "progress": (F.col("repeats") % 10) / 10, "eta_end": F.timestamp_micros(F.unix_micros("until") + 40 * 60_000_000), "confidence": F.lit(0.8)})
    return state.operational_state(rows, now_at()).select("run_id", "state", "state_confidence")


@job("f6_transitions", f"""WITH {EV}, l AS (SELECT *, lag(station) OVER w AS from_station, lag(authority) OVER w AS from_authority, row_number() OVER w AS n FROM ev WINDOW w AS (PARTITION BY train ORDER BY occurred_at, event_id))
SELECT event_id, from_station, station, from_authority, authority FROM l WHERE n = 1 OR station IS DISTINCT FROM from_station OR authority IS DISTINCT FROM from_authority""")
def f6(spark, sf):
    return state.transitions(ev(spark, sf), "train", "occurred_at", "event_id", ["station", "authority"]).select("event_id", "from_station", "station", "from_authority", "authority")


@job("f5_trajectory", f"WITH {EV} SELECT event_id, run_id, row_number() OVER (PARTITION BY run_id ORDER BY occurred_at, event_id) - 1 AS sequence FROM ev")
def f5(spark, sf):
    return state.trajectory(ev(spark, sf)).select("event_id", "run_id", "sequence")


def _day(e, day: str):
    last = state.as_of(e.where(F.col("service_date") == day), "train", F.lit("2030-01-01").cast("timestamp"), "occurred_at", "event_id")
    return last.select("train", "station", F.col("authority").alias("route"), F.timestamp_micros(F.unix_micros("occurred_at") % 86_400_000_000 + F.col("delay_min").cast("long") * 60_000_000).alias("eta"), F.col("reliability").alias("confidence"), (F.col("delay_min") + 10.0).alias("uncertainty"))


DAY = "SELECT train, station, authority AS route, epoch_us(occurred_at) % 86400000000 + delay_min * 60000000::BIGINT AS eta, reliability AS confidence, delay_min + 10.0 AS uncertainty FROM ev WHERE service_date = '{}' QUALIFY row_number() OVER (PARTITION BY train ORDER BY occurred_at DESC, event_id DESC) = 1"


@job("d17_movement_changes", f"""WITH {EV}, p AS ({DAY.format('2024-01-10')}), c AS ({DAY.format('2024-01-11')}), j AS (SELECT p.train, c.station <> p.station AS st, c.route <> p.route AS ro, abs(c.eta - p.eta) / 60e6 AS gap, p.confidence - c.confidence AS fall, c.confidence AS conf, c.uncertainty >= greatest(p.uncertainty * 1.25, p.uncertainty + 15) AS wide, c.uncertainty AS unc FROM p JOIN c USING (train))
SELECT train, 'station_fact' AS kind, 'low' AS severity FROM j WHERE st UNION ALL SELECT train, 'route_changed', 'high' FROM j WHERE ro UNION ALL SELECT train, 'eta_changed', CASE WHEN gap >= 30 THEN 'high' ELSE 'medium' END FROM j WHERE gap >= 10
UNION ALL SELECT train, 'confidence_drop', CASE WHEN conf < 0.35 THEN 'high' ELSE 'medium' END FROM j WHERE fall >= 0.15 UNION ALL SELECT train, 'uncertainty_expanded', CASE WHEN unc >= 100 THEN 'high' ELSE 'medium' END FROM j WHERE wide""")
def d17(spark, sf):
    e = ev(spark, sf)
    return state.changes(_day(e, "2024-01-10"), _day(e, "2024-01-11"), "train")


@job("d23_refresh_changes", f"""WITH {EV}, p AS ({DAY.format('2024-01-12')}), c AS ({DAY.format('2024-01-13')}) SELECT p.train, c.station <> p.station AS moved, abs(c.uncertainty - p.uncertainty) >= 15 AS delayed, c.route <> p.route AS rerouted FROM p JOIN c USING (train)""")
def d23(spark, sf):
    e = ev(spark, sf)
    j = _day(e, "2024-01-12").alias("p").join(_day(e, "2024-01-13").alias("c"), "train")
    return j.select("train", (F.col("c.station") != F.col("p.station")).alias("moved"), (F.abs(F.col("c.uncertainty") - F.col("p.uncertainty")) >= 15).alias("delayed"), (F.col("c.route") != F.col("p.route")).alias("rerouted"))


LNC = "ln(1 + sample_count)"
HYPOTHESES = f"""{STATS}, anc AS (SELECT run_id, station, train, occurred_at, lag(station) OVER w AS previous, reliability FROM ev WHERE occurred_at <= {TS} WINDOW w AS (PARTITION BY run_id ORDER BY occurred_at, event_id) QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY occurred_at DESC, event_id DESC) = 1),
pr AS (SELECT a.run_id, e.to_station, a.occurred_at, a.reliability AS fr, p10, p50, p90, sample_count, e.train AS family, least(1.0, {LNC} / ln(21)) AS er,
  0.35 + (a.train = e.train)::INTEGER * 1.4 + {LNC} * 0.32 + least(1.0, {LNC} / ln(21)) * 0.8 - coalesce((a.previous = e.to_station)::INTEGER, 0) * 0.9 AS score FROM anc a JOIN stats e ON a.station = e.from_station WHERE e.to_station <> a.station AND p50 > 0 AND p50 <= 1440),
rk AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY round(score, 9) DESC, to_station, family) AS place FROM pr QUALIFY place <= 3),
wt AS (SELECT *, exp(score - max(score) OVER (PARTITION BY run_id)) AS w FROM rk), pb AS (SELECT *, w / sum(w) OVER (PARTITION BY run_id) AS probability, count(*) OVER (PARTITION BY run_id) AS n FROM wt),
en AS (SELECT *, CASE WHEN n > 1 THEN -sum(probability * ln(greatest(probability, 1e-9))) OVER (PARTITION BY run_id) / ln(n) ELSE 0.0 END AS entropy, greatest(0.0, (epoch_us({TS}) - epoch_us(occurred_at)) / 60e6) AS age,
  max(probability) FILTER (place = 1) OVER (PARTITION BY run_id) AS best, coalesce(max(probability) FILTER (place = 2) OVER (PARTITION BY run_id), 0.0) AS second FROM pb)"""


@job("m6_next_station_hypotheses", f"""WITH {HYPOTHESES} SELECT run_id, place, to_station, round(probability, 4) AS probability, round(least(1.0, age / p50), 4) AS progress, round(entropy, 4) AS entropy,
  round(least(300.0, greatest(3.0, (greatest(3.0, 60 * greatest(0.05, (p90 - p10) / greatest(p50, 1.0)) * 0.5) + age * 0.35 + (1 - probability) * 35) * (1 + entropy * 0.45))), 2) AS uncertainty_km,
  round(least(1.0, fr * er * probability * exp(-age / 150)), 6) AS confidence, CASE WHEN age > 180 THEN 'unknown' WHEN age > 90 THEN 'stale' ELSE 'estimated' END AS position, best < 0.58 OR (n > 1 AND best - second < 0.18) OR entropy > 0.78 AS ambiguous FROM en""")
def m6(spark, sf):
    e = ev(spark, sf).where(F.col("occurred_at") <= now_at())
    order = Window.partitionBy("run_id").orderBy("occurred_at", "event_id")
    anchors = state.as_of(e.withColumn("previous", F.lag("station").over(order)), "run_id", now_at(), "occurred_at", "event_id").withColumn("fusion_reliability", F.col("reliability"))
    return state.hypotheses(anchors, segments.segment_stats(seg(spark, sf)), now_at())


POST = f"""{EV}, inp AS (SELECT run_id, 100.0 + train AS route_km, (train % 60)::DOUBLE AS anchor_km, occurred_at AS anchor_at, 1.0 + train % 3 AS error_km, reliability, CASE WHEN train % 4 <> 0 THEN 80.0 + train % 20 END AS next_km, CASE WHEN train % 4 <> 0 THEN occurred_at + to_minutes(60 + train % 50) END AS next_at
  FROM ev WHERE {AGE} BETWEEN 0 AND 240 QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY occurred_at DESC, event_id DESC) = 1),
ag AS (SELECT *, (epoch_us({TS}) - epoch_us(anchor_at)) / 60e6 AS age FROM inp),
ms AS (SELECT *, CASE WHEN next_at IS NOT NULL THEN anchor_km + (next_km - anchor_km) * least(1.0, age / greatest(1.0, (epoch_us(next_at) - epoch_us(anchor_at)) / 60e6)) ELSE least(anchor_km + 62.0 * age / 60, route_km) END AS mean_km,
  CASE WHEN next_at IS NOT NULL THEN greatest(error_km, greatest(1.0, next_km - anchor_km) * 0.12, 1.2 + age * 0.055) ELSE greatest(error_km, 2 + age * 0.16) END AS sigma_km, least(240, greatest(40, ceil(route_km / 2)))::INTEGER AS bins FROM ag),
ce AS (SELECT *, i * route_km / bins AS km FROM (SELECT *, unnest(range(0, bins + 1)) AS i FROM ms WHERE age <= 180)),
cw AS (SELECT *, exp(-0.5 * pow((km - mean_km) / greatest(0.01, sigma_km), 2)) AS w FROM ce),
cu AS (SELECT *, sum(w) OVER (PARTITION BY run_id ORDER BY i ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY run_id) AS upto FROM cw),
qs AS (SELECT run_id, {', '.join(f"round(min(km) FILTER (upto >= {p} - 1e-12), 2) AS {n}" for n, p in (('p025', 0.025), ('p05', 0.05), ('p10', 0.1), ('p25', 0.25), ('p50', 0.5), ('p75', 0.75), ('p90', 0.9), ('p95', 0.95), ('p975', 0.975)))} FROM cu GROUP BY run_id)"""


@job("m1_position_posterior", f"""WITH {POST}, jo AS (SELECT m.run_id, age, route_km, reliability, qs.* EXCLUDE (run_id) FROM ms m LEFT JOIN qs ON m.run_id = qs.run_id), cf AS (SELECT *, least(0.96, greatest(0.05, least(1.0, reliability) * 0.48 + least(1.0, greatest(0.0, 1 - age / 180)) * 0.3 + least(1.0, greatest(0.0, 1 - (p95 - p05) / greatest(route_km, 1.0))) * 0.22)) AS c FROM jo)
SELECT run_id, CASE WHEN age > 180 THEN 'unknown' WHEN age > 90 THEN 'stale' WHEN age <= 3 AND greatest(p50 - p05, p95 - p50) <= 5 THEN 'reported' ELSE 'estimated' END AS status, p025, p05, p10, p25, p50, p75, p90, p95, p975, round(CASE WHEN age > 180 THEN NULL WHEN age > 90 THEN least(c, 0.32) ELSE c END, 4) AS confidence FROM cf""")
def m1(spark, sf):
    e = state.as_of(ev(spark, sf), "run_id", now_at(), "occurred_at", "event_id", 4.0000001)
    t, there = F.col("train"), F.col("train") % 4 != 0
    rows = e.select("run_id", (100.0 + t).alias("route_km"), (t % 60).cast("double").alias("anchor_km"), F.col("occurred_at").alias("anchor_at"), (1.0 + t % 3).alias("error_km"), "reliability", F.when(there, 80.0 + t % 20).alias("next_km"), F.when(there, F.timestamp_micros(F.unix_micros("occurred_at") + (60 + t % 50) * 60_000_000)).alias("next_at"))
    return state.posterior(rows, now_at())


LINK = f"""{EV}, calls AS (SELECT run_id, list({{'station': station, 'called': called}}) AS calls FROM (SELECT run_id, station, min(occurred_at) AS called FROM ev GROUP BY ALL) GROUP BY run_id),
runs AS (SELECT *, CASE WHEN number % 4 <> 0 THEN origin || ' - ' || destination END AS rroute, CASE WHEN number % 3 = 0 THEN 'l' || number % 9 END AS rloco FROM (SELECT run_id, train AS number, service_date AS rdate, max(occurred_at) AS last_seen, list(DISTINCT station) AS stations, arg_min(station, (occurred_at, event_id)) AS origin, arg_max(station, (occurred_at, event_id)) AS destination FROM ev GROUP BY ALL) JOIN calls USING (run_id)),
obs AS (SELECT event_id, CASE WHEN event_id % 53 = 0 THEN train + 100000 WHEN event_id % 50 <> 0 THEN train END AS number, service_date, lag(station) OVER w AS eo, lead(station) OVER w AS ed, station, occurred_at, CASE event_id % 4 WHEN 0 THEN 'corroborated' WHEN 1 THEN 'conflict' ELSE 'single-source' END AS grade,
  event_id % 3 + 1 AS domains, CASE WHEN event_id % 7 <> 0 THEN reliability END AS reliability, CASE WHEN event_id % 3 = 0 THEN lag(station) OVER w || ' - ' || lead(station) OVER w END AS route, CASE WHEN event_id % 4 = 2 THEN 'l' || event_id % 9 END AS loco, CASE WHEN event_id % 6 = 0 THEN [train::VARCHAR] WHEN event_id % 100 = 50 THEN [run_id] ELSE [] END AS negative FROM ev WINDOW w AS (PARTITION BY run_id ORDER BY occurred_at, event_id)),
cand AS (SELECT o.*, r.run_id, r.rdate, r.origin AS ro, r.destination AS rd, r.rroute, r.rloco, r.stations, r.calls, r.last_seen, r.number AS rnumber, regexp_replace(lower(concat_ws(' ', r.origin, r.rroute, r.destination)), '[^a-z0-9]+', '-', 'g') AS rtext FROM obs o JOIN runs r ON abs(date_diff('day', o.service_date::DATE, r.rdate::DATE)) <= 1 AND (o.number = r.number OR o.number IS NULL)),
feat AS (SELECT *, coalesce(eo = ro AND ed = rd, false) AS same, coalesce(eo = rd AND ed = ro, false) AS opp, abs(epoch_us(occurred_at) - epoch_us(last_seen)) / 3.6e9 AS gap, list_min(list_transform(list_filter(calls, lambda c: c.station = station), lambda c: abs(epoch_us(occurred_at) - epoch_us(c.called)) / 6e7)) AS sgap FROM cand),
weights AS (SELECT *, [{{'n': 'number', 'w': CASE WHEN number IS NOT NULL THEN 0.42::DOUBLE ELSE 0 END}}, {{'n': 'date', 'w': CASE WHEN service_date = rdate THEN 0.24 ELSE 0.08 END}}, {{'n': 'direction', 'w': CASE WHEN same THEN 0.2 ELSE 0 END}}, {{'n': 'opposite', 'w': CASE WHEN opp AND NOT same THEN -0.18 ELSE 0 END}},
  {{'n': 'route', 'w': CASE WHEN route = rroute THEN 0.14 ELSE 0 END}}, {{'n': 'station', 'w': CASE WHEN list_contains(stations, station) THEN 0.12 WHEN contains(rtext, station) THEN 0.07 ELSE -0.04 END}}, {{'n': 'schedule', 'w': CASE WHEN sgap <= 240 THEN 0.12 * (1 - sgap / 240) ELSE 0 END}},
  {{'n': 'locomotive', 'w': CASE WHEN loco = rloco THEN 0.12 WHEN loco <> rloco THEN -0.16 ELSE 0 END}}, {{'n': 'time', 'w': CASE WHEN gap <= 12 THEN 0.06 * (1 - gap / 12) ELSE 0 END}}, {{'n': 'corroborated', 'w': CASE WHEN grade = 'corroborated' AND domains >= 2 THEN 0.08 ELSE 0 END}}, {{'n': 'conflict', 'w': CASE WHEN grade = 'conflict' THEN -0.12 ELSE 0 END}},
  {{'n': 'reliability', 'w': coalesce((reliability - 0.5) * 0.08, 0)}}, {{'n': 'negative', 'w': CASE WHEN list_contains(negative, run_id) OR list_contains(negative, rnumber::VARCHAR) THEN -0.28 ELSE 0 END}}, {{'n': 'completeness', 'w': (2 + (rroute IS NOT NULL)::INTEGER) / 3 * 0.04}}] AS parts FROM feat),
scored AS (SELECT *, least(1.0, greatest(0.0, round(list_sum(list_transform(parts, lambda x: x.w)), 4))) AS score FROM weights),
one AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY event_id, ro, rd, rroute ORDER BY score DESC, run_id) = 1),
first AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS second FROM one WINDOW w AS (PARTITION BY event_id ORDER BY score DESC, run_id) QUALIFY place <= 5),
pb AS (SELECT *, round(exp(6 * (score - max_score)) / sum(exp(6 * (score - max_score))) OVER m, 4) AS probability FROM (SELECT *, max(score) OVER (PARTITION BY event_id) AS max_score FROM first) WINDOW m AS (PARTITION BY event_id))"""


def _linked(spark, sf):
    """Observations and the runs they may belong to; some have a number that no run has."""
    e = ev(spark, sf)
    calls = e.groupBy("run_id", "station").agg(F.min("occurred_at").alias("at")).groupBy("run_id").agg(F.collect_list(F.struct("station", "at")).alias("calls"))
    runs = e.groupBy("run_id", F.col("train").alias("number"), "service_date").agg(F.max("occurred_at").alias("last_seen"), F.collect_set("station").alias("stations"), F.min_by("station", F.struct("occurred_at", "event_id")).alias("origin"), F.max_by("station", F.struct("occurred_at", "event_id")).alias("destination"))
    runs = runs.join(calls, "run_id").withColumn("route", F.when(F.col("number") % 4 != 0, F.concat_ws(" - ", "origin", "destination"))).withColumn("locomotive", F.when(F.col("number") % 3 == 0, F.concat(F.lit("l"), (F.col("number") % 9).cast("string"))))
    order, k = Window.partitionBy("run_id").orderBy("occurred_at", "event_id"), F.col("event_id")
    grade = F.when(k % 4 == 0, "corroborated").when(k % 4 == 1, "conflict").otherwise("single-source")
    obs = e.select("event_id", F.when(k % 53 == 0, F.col("train") + 100000).when(k % 50 != 0, F.col("train")).alias("number"), "service_date", F.lag("station").over(order).alias("origin"), F.lead("station").over(order).alias("destination"), "station", "occurred_at", grade.alias("grade"), (k % 3 + 1).alias("domains"),
        F.when(k % 7 != 0, F.col("reliability")).alias("reliability"), F.when(k % 4 == 2, F.concat(F.lit("l"), (k % 9).cast("string"))).alias("locomotive"), F.when(k % 6 == 0, F.array(F.col("train").cast("string"))).when(k % 100 == 50, F.array("run_id")).alias("negative"))
    obs = obs.withColumn("route", F.when((k % 3 == 0) & F.col("origin").isNotNull() & F.col("destination").isNotNull(), F.concat_ws(" - ", "origin", "destination")))
    return obs, runs


@job("d3_link_candidates", f"WITH {LINK} SELECT event_id, place::INTEGER AS place, run_id, probability FROM pb")
def d3(spark, sf):
    return linking.candidates(*_linked(spark, sf)).select("event_id", "place", "run_id", "probability")


@job("m4_link_scores", f"WITH {LINK} SELECT event_id, run_id, score, array_to_string(list_transform(list_filter(parts, lambda x: x.w <> 0), lambda x: x.n), ',') AS features FROM first")
def m4(spark, sf):
    return linking.candidates(*_linked(spark, sf)).select("event_id", "run_id", "score", F.array_join(F.transform("features", lambda f: f["name"]), ",").alias("features"))


@job("m5_canonical_run", f"""WITH {LINK}, b AS (SELECT *, round(score - coalesce(second, 0), 4) AS margin, grade = 'corroborated' AND domains >= 2 AS sure FROM pb WHERE place = 1),
k AS (SELECT *, score >= CASE WHEN sure THEN 0.62 ELSE 0.68 END AS enough, second IS NULL OR margin >= CASE WHEN sure THEN 0.05 ELSE 0.08 END AS apart FROM b)
SELECT o.event_id, CASE WHEN k.run_id IS NULL THEN 'unmatched' WHEN enough AND apart THEN 'linked' ELSE 'pending' END AS status, CASE WHEN enough AND apart THEN k.run_id END AS canonical_run_id, coalesce(score, 0) AS confidence, coalesce(margin, 0) AS margin, probability,
  CASE WHEN k.run_id IS NULL THEN 'no-candidates' WHEN NOT enough THEN 'low-confidence' WHEN NOT apart THEN 'candidate-conflict' END AS reason FROM obs o LEFT JOIN k USING (event_id)""")
def m5(spark, sf):
    obs, runs = _linked(spark, sf)
    return linking.choose(linking.candidates(obs, runs), obs)


EVIDENCE = f"""{EV}, evi AS (SELECT station AS corridor, source_id AS source_group, run_id || ':' || delay_min AS fingerprint, occurred_at, observed_at AS received_at, observed_at + to_minutes(event_id % 3) AS updated_at, reliability AS confidence, event_id % 97 = 0 AS reviewed FROM ev)"""


def _evidence(spark, sf):
    return ev(spark, sf).select(F.col("station").alias("corridor"), F.col("source_id").alias("source_group"), F.concat_ws(":", "run_id", F.col("delay_min").cast("string")).alias("fingerprint"), "occurred_at", F.col("observed_at").alias("received_at"), F.timestamp_micros(F.unix_micros("observed_at") + F.col("event_id") % 3 * 60_000_000).alias("updated_at"), F.col("reliability").alias("confidence"), (F.col("event_id") % 97 == 0).alias("reviewed"))


CLUSTERS = f"""WITH RECURSIVE {EVIDENCE}, rdy AS (SELECT * FROM evi WHERE epoch_us({TS}) - epoch_us(greatest(occurred_at, received_at, updated_at)) >= 24 * 3600000000::BIGINT AND epoch_us({TS}) - epoch_us(occurred_at) <= 7 * 86400000000::BIGINT QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY occurred_at, source_group) = 1),
tm AS (SELECT DISTINCT corridor, epoch_us(occurred_at) AS t FROM rdy), ord AS (SELECT corridor, t, row_number() OVER (PARTITION BY corridor ORDER BY t) AS n FROM tm),
cl AS (SELECT corridor, t, n, t AS first, 1 AS cluster FROM ord WHERE n = 1 UNION ALL SELECT o.corridor, o.t, o.n, CASE WHEN o.t - c.first > 6 * 3600000000::BIGINT THEN o.t ELSE c.first END, CASE WHEN o.t - c.first > 6 * 3600000000::BIGINT THEN c.cluster + 1 ELSE c.cluster END FROM cl c JOIN ord o ON o.corridor = c.corridor AND o.n = c.n + 1),
gr AS (SELECT r.*, cluster FROM rdy r JOIN cl ON cl.corridor = r.corridor AND cl.t = epoch_us(r.occurred_at)),
bs AS (SELECT corridor, cluster, source_group, max(confidence) AS best, min(occurred_at) AS a, max(occurred_at) AS b, max(reviewed::INTEGER) AS reviewed FROM gr GROUP BY ALL),
pj AS (SELECT corridor, (epoch_us(min(a)) // 900000000) * 900000000 AS "start", (epoch_us(max(b)) // 900000000) * 900000000 AS "end", count(*) AS sources, 1 - product(1 - least(0.95, best)) AS conf FROM bs GROUP BY corridor, cluster HAVING count(*) >= 2 OR max(reviewed) = 1),
pub AS (SELECT corridor, "start", "end", sources, round(conf, 6) AS confidence, greatest(35.0, round(35.0 + (1 - conf) * 60, 1)) AS uncertainty_km FROM pj)"""


@job("e17_public_projection", f"{CLUSTERS} SELECT * FROM pub")
def e17(spark, sf):
    return publish.project(_evidence(spark, sf), now_at())


@job("e34_presentation", f"""{CLUSTERS} SELECT corridor, "start", CASE WHEN (epoch_us({TS}) - "end") / 3.6e9 <= 48 THEN 'recent' WHEN (epoch_us({TS}) - "end") / 3.6e9 <= 96 THEN 'older' ELSE 'archive' END AS freshness, round(0.82 * confidence + 0.18 * least(1.0, sources / 4.0::DOUBLE), 4) AS quality, greatest(35.0, uncertainty_km) AS error_km, NULL::DOUBLE AS position FROM pub""")
def e34(spark, sf):
    return publish.presentation(publish.project(_evidence(spark, sf), now_at()), F.unix_micros(now_at()))


@job("f12_first_anchored_clusters", f"""{CLUSTERS} SELECT corridor, cluster, count(*) AS rows FROM gr GROUP BY ALL""")
def f12(spark, sf):
    rows = _evidence(spark, sf)
    newest = F.unix_micros(now_at()) - F.unix_micros(F.greatest("occurred_at", "received_at", "updated_at"))
    ready = rows.where((newest >= 24 * 3_600_000_000) & (F.unix_micros(now_at()) - F.unix_micros("occurred_at") <= 7 * 86_400_000_000))
    once = Window.partitionBy("fingerprint").orderBy("occurred_at", "source_group")
    ready = ready.withColumn("p", F.row_number().over(once)).where("p = 1")
    return publish.first_anchored(ready, ["corridor"], "occurred_at", 6).groupBy("corridor", "cluster").agg(F.count("*").alias("rows"))


@job("e18_evidence_roll_up", f"""WITH {EVIDENCE}, k AS (SELECT *, (epoch_us({TS}) - epoch_us(occurred_at)) / 3.6e9 AS age FROM evi) SELECT corridor, round(1 - product(1 - least(0.95, confidence) * pow(0.5, age / 6)), 6) AS strength, count(*) AS reports, count(DISTINCT source_group) AS sources FROM k WHERE age BETWEEN 0 AND 24 GROUP BY corridor""")
def e18(spark, sf):
    return publish.roll_up(_evidence(spark, sf), now_at())


@job("f11_thinned_snapshots", f"""WITH RECURSIVE {EV}, o AS (SELECT train, epoch_us(occurred_at) AS t, row_number() OVER (PARTITION BY train ORDER BY occurred_at) AS n FROM (SELECT DISTINCT train, occurred_at FROM ev)),
th AS (SELECT train, t, n, t AS last, true AS kept FROM o WHERE n = 1 UNION ALL SELECT o.train, o.t, o.n, CASE WHEN o.t - th.last >= 21600000000 THEN o.t ELSE th.last END, o.t - th.last >= 21600000000 FROM th JOIN o ON o.train = th.train AND o.n = th.n + 1)
SELECT train, t AS kept_at FROM th WHERE kept""")
def f11(spark, sf):
    return publish.thin(ev(spark, sf), "train", "occurred_at", 360)


@job("f11_bucket_snapshots", f"WITH {EV} SELECT run_id, (epoch_us(occurred_at) // 900000000) * 900000000 AS bucket, max(event_id) AS event_id FROM ev GROUP BY ALL")
def f11_bucket(spark, sf):
    bucket = F.expr("(unix_micros(occurred_at) div 900000000) * 900000000")
    return ev(spark, sf).groupBy("run_id", bucket.alias("bucket")).agg(F.max("event_id").alias("event_id"))


@job("d12_pending_links", f"WITH {EV} SELECT e.event_id FROM ev e LEFT JOIN ev l ON l.event_id = e.event_id AND l.event_id % 3 <> 0 WHERE l.event_id IS NULL OR (epoch_us({TS}) - epoch_us(l.occurred_at)) / 60e6 > 60 AND l.event_id % 3 = 1")
def d12(spark, sf):
    e = ev(spark, sf)
    links = e.where("event_id % 3 <> 0").select("event_id", F.col("occurred_at").alias("linked_at"), (F.col("event_id") % 3 == 1).alias("pending"))
    stale = (F.unix_micros(now_at()) - F.unix_micros("linked_at")) / F.lit(60e6) > 60
    return e.join(links, "event_id", "left").where(F.col("linked_at").isNull() | stale & F.col("pending")).select("event_id")


@job("d13_current_against_baseline", f"""WITH {EV}, c AS (SELECT station, authority, count(*) AS n FROM ev WHERE {AGE} BETWEEN 0 AND 120 GROUP BY ALL), b AS (SELECT station, authority, count(*) AS n FROM ev WHERE {AGE} > 120 AND {AGE} <= 1440 GROUP BY ALL)
SELECT station, authority, coalesce(c.n, 0) AS current, coalesce(b.n, 0) AS baseline FROM c FULL OUTER JOIN b USING (station, authority)""")
def d13(spark, sf):
    age = (F.unix_micros(now_at()) - F.unix_micros("occurred_at")) / F.lit(60e6)
    e = ev(spark, sf).withColumn("age", age)
    count = lambda rows, name: rows.groupBy("station", "authority").agg(F.count("*").alias(name))
    return count(e.where("age BETWEEN 0 AND 120"), "current").join(count(e.where("age > 120 AND age <= 1440"), "baseline"), ["station", "authority"], "full_outer").select("station", "authority", F.coalesce("current", F.lit(0)).alias("current"), F.coalesce("baseline", F.lit(0)).alias("baseline"))


@job("d1_ledger_view", f"""WITH {SESSIONS}, grp AS (SELECT train, station, session, arg_min(event_id, (-w, occurred_at, event_id)) AS primary_id FROM s GROUP BY ALL)
SELECT e.event_id, coalesce(l.canonical, e.run_id) AS canonical_run_id, g.session FROM s e LEFT JOIN (SELECT event_id, 'run:' || train AS canonical FROM ev WHERE event_id % 3 = 0) l USING (event_id) LEFT JOIN grp g ON g.train = e.train AND g.station = e.station AND g.session = e.session WHERE g.primary_id = e.event_id""")
def d1(spark, sf):
    e = fusion.gap_sessions(ev(spark, sf), ["train", "station"], GAP)
    groups = fusion.fuse_simple(ev(spark, sf), GAP).select("train", "station", "session", "primary_event_id")
    links = ev(spark, sf).where("event_id % 3 = 0").select("event_id", F.concat(F.lit("run:"), F.col("train").cast("string")).alias("canonical"))
    rows = e.join(links, "event_id", "left").join(groups, ["train", "station", "session"], "left").where("primary_event_id = event_id")
    return rows.select("event_id", F.coalesce("canonical", "run_id").alias("canonical_run_id"), "session")


@job("d19_replay", f"""WITH {STATS}, facts AS (SELECT event_id, train, from_station, to_station, minutes FROM seg)
SELECT f.event_id, s.train AS learned_from, s.sample_count, round(abs(f.minutes - s.p50), 3) AS error FROM facts f JOIN stats s ON f.from_station = s.from_station AND f.to_station = s.to_station WHERE s.train = f.train OR s.sample_count >= 10
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY (s.train = f.train) DESC, s.sample_count DESC, s.train) = 1""")
def d19(spark, sf):
    stats = segments.segment_stats(seg(spark, sf)).select("train", "from_station", "to_station", "sample_count", "p50")
    return segments.replay(seg(spark, sf), stats, 10).select("event_id", "learned_from", "sample_count", F.round(F.abs(F.col("minutes") - F.col("p50")), 3).alias("error"))


@job("d14_schedule_choice", """SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY (o_orderkey % 7 = 0) DESC, (o_orderstatus = 'O') DESC, o_orderdate DESC, o_orderkey) = 1""")
def d14(spark, sf):
    j = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    order = Window.partitionBy("c_custkey").orderBy((F.col("o_orderkey") % 7 == 0).desc(), (F.col("o_orderstatus") == "O").desc(), F.desc("o_orderdate"), "o_orderkey")
    return j.withColumn("place", F.row_number().over(order)).where("place = 1").select("c_custkey", "o_orderkey")
