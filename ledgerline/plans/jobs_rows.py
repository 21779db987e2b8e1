"""Registered queries: screening, ledger writes, scalar expressions, ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import scalars
from ledgerline.operators import ledger, screening
from ledgerline.plans.proxy import EV, NOW, ev, pts, table
from ledgerline.plans.registry import job



def now_at():
    return F.lit(NOW).cast("timestamp")


TS = f"TIMESTAMP '{NOW}'"
AGE = f"((epoch_us({TS}) - epoch_us(occurred_at)) / 60e6)"


def _updates(spark, sf):
    e = ev(spark, sf)
    return e.withColumns({"number": F.when(F.col("event_id") % 17 == 0, F.lit("x1")).otherwise(F.col("train").cast("string")), "updated_at": F.when(F.col("event_id") % 19 != 0, F.col("occurred_at")), "delay": F.col("delay_min") * F.when(F.col("event_id") % 23 == 0, -1).otherwise(1),
                          "lat": F.pmod(F.col("event_id") * 31, F.lit(97)).cast("double"), "lon": F.pmod(F.col("event_id") * 7, F.lit(185)).cast("double"), "route": F.when(F.col("event_id") % 5 != 0, F.col("station")), "forecast": F.when(F.col("event_id") % 3 == 0, F.col("delay_min")),
                          "text": F.concat(F.lit("#"), F.col("train").cast("string"), F.lit(" and #"), F.pmod(F.col("event_id"), F.lit(150)).cast("string"))})


UPDATES = f"""{EV}, upd AS (SELECT *, CASE WHEN event_id % 17 = 0 THEN 'x1' ELSE train::VARCHAR END AS number, CASE WHEN event_id % 19 <> 0 THEN occurred_at END AS updated_at, delay_min * CASE WHEN event_id % 23 = 0 THEN -1 ELSE 1 END AS delay,
  (event_id * 31 % 97)::DOUBLE AS lat, (event_id * 7 % 185)::DOUBLE AS lon, CASE WHEN event_id % 5 <> 0 THEN station END AS route, CASE WHEN event_id % 3 = 0 THEN delay_min END AS forecast FROM ev),
u AS (SELECT *, (epoch_us({TS}) - epoch_us(updated_at)) / 60e6 AS age FROM upd),
assessed AS (SELECT event_id, list_filter([CASE WHEN NOT regexp_full_match(number, '\\d{{1,4}}(/\\d{{1,4}})?') THEN 'invalid_number' END, CASE WHEN updated_at IS NULL THEN 'invalid_timestamp' END, CASE WHEN age < -20 THEN 'future_timestamp' END,
  CASE WHEN NOT (delay BETWEEN 0 AND 1440) THEN 'impossible_delay' END, CASE WHEN abs(lat) > 90 OR abs(lon) > 180 THEN 'invalid_coordinates' END], lambda x: x IS NOT NULL) AS errors,
  list_filter([CASE WHEN coalesce(route, '') = '' THEN 'missing_route' END, CASE WHEN forecast IS NULL THEN 'missing_forecast' END, CASE WHEN age > 360 THEN 'old_event' END, CASE WHEN train <> event_id % 150 THEN 'several_numbers' END], lambda x: x IS NOT NULL) AS warnings FROM u)"""


@job("b1_quality_screen", f"WITH {UPDATES} SELECT event_id, array_to_string(errors, ',') AS errors, array_to_string(warnings, ',') AS warnings, len(errors) = 0 AS accepted FROM assessed")
def b1(spark, sf):
    out = screening.assess(_updates(spark, sf), now_at())
    return out.select("event_id", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"), "accepted")


@job("b1_warning_counts", f"WITH {UPDATES} SELECT warning, count(*) AS rows FROM (SELECT unnest(warnings) AS warning FROM assessed) GROUP BY warning")
def b1_counts(spark, sf):
    return screening.warning_counts(screening.assess(_updates(spark, sf), now_at()))


@job("a20_quarantine", f"WITH {UPDATES} SELECT event_id, array_to_string(errors, ',') AS errors FROM assessed WHERE len(errors) > 0")
def a20(spark, sf):
    return screening.assess(_updates(spark, sf), now_at()).where("NOT accepted").select("event_id", F.array_join("errors", ",").alias("errors"))


@job("a1_ingest_latest", f"""WITH {UPDATES}, good AS (SELECT upd.* FROM upd JOIN assessed USING (event_id) WHERE len(errors) = 0)
SELECT run_id, event_id, station, delay FROM good QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY occurred_at DESC, event_id DESC) = 1""")
def a1(spark, sf):
    good = screening.assess(_updates(spark, sf), now_at()).where("accepted")
    return ledger.latest(good, ["run_id"], "occurred_at", "event_id").select("run_id", "event_id", "station", "delay")


@job("b2_event_contract", f"""WITH {EV} SELECT event_id, concat_ws(',', CASE WHEN event_id % 29 = 0 THEN 'missing_station' END, CASE WHEN station NOT IN ('view', 'click') THEN 'unknown_type' END, CASE WHEN value / 40 > 1 THEN 'bad_reliability' END) AS errors FROM ev""")
def b2(spark, sf):
    kind = F.when(F.col("station").isin("view", "click"), "station_report").otherwise(F.col("station"))
    rows = ev(spark, sf).withColumns({"event_type": kind, "reliability": F.col("value") / 40}).withColumn("station", F.when(F.col("event_id") % 29 != 0, F.col("station")))
    return screening.contract_errors(rows).select("event_id", F.array_join("errors", ",").alias("errors"))


@job("b3_volume_drop", f"""WITH {EV}, c AS (SELECT source_id, service_date, count(*) FILTER (NOT (event_id % 10 < 7 AND service_date = '2024-01-10')) AS n FROM ev GROUP BY ALL), l AS (SELECT *, lag(n) OVER (PARTITION BY source_id ORDER BY service_date) AS previous FROM c)
SELECT source_id, service_date, n, previous, coalesce(previous >= 20 AND n < previous * 0.45, false) AS anomaly FROM l""")
def b3(spark, sf):
    counts = ev(spark, sf).groupBy("source_id", "service_date").agg(F.count_if(~((F.col("event_id") % 10 < 7) & (F.col("service_date") == "2024-01-10"))).alias("n"))
    return screening.volume_drops(counts, "source_id", "service_date", "n")


BOX = (43.8, 53.0, 21.0, 41.5)


@job("b4_coordinate_guard", """WITH p AS (SELECT c_custkey AS id, 44 + (c_custkey * 7919 % 9000) / 1000.0::DOUBLE AS la, 22 + (c_custkey * 104729 % 18000) / 1000.0::DOUBLE AS lo FROM customer),
s AS (SELECT id, CASE WHEN id % 13 = 0 THEN lo ELSE la END + CASE WHEN id % 31 = 0 THEN 60 ELSE 0 END AS lat, CASE WHEN id % 13 = 0 THEN la ELSE lo END AS lon FROM p),
k AS (SELECT *, lat BETWEEN 43.8 AND 53.0 AND lon BETWEEN 21.0 AND 41.5 AS straight, lon BETWEEN 43.8 AND 53.0 AND lat BETWEEN 21.0 AND 41.5 AS swapped FROM s)
SELECT id, CASE WHEN straight THEN 'explicit-fields' WHEN swapped THEN 'coordinate-order-repaired' ELSE 'outside-rejected' END AS coordinate_quality, round(CASE WHEN straight THEN lat WHEN swapped THEN lon END, 4) AS lat, round(CASE WHEN straight THEN lon WHEN swapped THEN lat END, 4) AS lon FROM k""")
def b4(spark, sf):
    left, _ = pts(spark, sf)
    odd = F.col("id") % 13 == 0
    rows = left.select("id", (F.when(odd, F.col("lon")).otherwise(F.col("lat")) + F.when(F.col("id") % 31 == 0, 60).otherwise(0)).alias("lat"), F.when(odd, F.col("lat")).otherwise(F.col("lon")).alias("lon"))
    return screening.guard_coordinates(rows, BOX).select("id", "coordinate_quality", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"))


@job("b7_bounding_box", "SELECT c_custkey AS id FROM customer WHERE 44 + (c_custkey * 7919 % 9000) / 1000.0::DOUBLE BETWEEN 46 AND 48.5 AND 22 + (c_custkey * 104729 % 18000) / 1000.0::DOUBLE BETWEEN 25 AND 33")
def b7(spark, sf):
    return screening.in_box(pts(spark, sf)[0], (46.0, 48.5, 25.0, 33.0), BOX).select("id")


@job("b8_text_search", "SELECT p_partkey, p_name FROM part WHERE lower(concat_ws(' ', p_name, p_brand)) LIKE '%brand#1%' OR lower(concat_ws(' ', p_name, p_brand)) LIKE '%part 7%'")
def b8(spark, sf):
    return screening.search(table(spark, sf, "part"), ["p_name", "p_brand"], ["Brand#1", "Part 7"]).select("p_partkey", "p_name")


RULES = [("steel", "freight"), ("copper|brass", "express"), ("^promo|^economy", "suburban")]


@job("b15_category", "SELECT p_partkey, CASE WHEN regexp_matches(lower(p_type), 'steel') THEN 'freight' WHEN regexp_matches(lower(p_type), 'copper|brass') THEN 'express' WHEN regexp_matches(lower(p_type), '^promo|^economy') THEN 'suburban' ELSE 'regional' END AS category FROM part")
def b15(spark, sf):
    return table(spark, sf, "part").select("p_partkey", screening.first_rule(F.lower("p_type"), RULES, "regional").alias("category"))


@job("b16_board_phase", """WITH o AS (SELECT o_orderkey, l_linenumber, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 60e6 / 1440 - 40 AS m FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT o_orderkey, l_linenumber, CASE WHEN m < -45 THEN 'past' WHEN m <= 0 THEN 'recent' WHEN m <= 90 THEN 'near' ELSE 'planned' END AS phase, m BETWEEN -45 AND 90 AS fact FROM o""")
def b16(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    m = (F.unix_micros(F.col("l_shipdate").cast("timestamp")) - F.unix_micros(F.col("o_orderdate").cast("timestamp"))) / F.lit(60e6) / 1440 - 40
    return rows.select("o_orderkey", "l_linenumber", screening.board_phase(m).alias("phase"), m.between(-45, 90).alias("fact"))


@job("b17_incomplete", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR lang IS NULL")
def b17(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left").where("quality IS NULL OR lang IS NULL").select("doc_id")


@job("b18_expected_runs", """SELECT lpad((o_orderkey % 1000)::VARCHAR, 4, '0') AS number, 'exp:' || o_orderkey AS expected_id, strftime(o_orderdate, '%Y-%m-%d') AS service_date, substr(o_orderpriority, 1, 8) AS kind FROM orders WHERE o_orderkey % 1000 > 0""")
def b18(spark, sf):
    o = table(spark, sf, "orders")
    number = F.lpad((F.col("o_orderkey") % 1000).cast("string"), 4, "0")
    return o.where(number.rlike(r"^\d{1,4}$") & (F.col("o_orderkey") % 1000 > 0)).select(number.alias("number"), F.concat(F.lit("exp:"), F.col("o_orderkey").cast("string")).alias("expected_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("service_date"), F.substring("o_orderpriority", 1, 8).alias("kind"))


CLAIMS = f"""{EV}, clm AS (SELECT event_id, occurred_at, delay_min, CASE WHEN event_id % 6 <> 0 THEN station END AS station, ['moving', 'depot', 'planned', 'station'][(event_id % 4 + 1)::INTEGER] AS operational,
  ['reported-station-passage', 'station-board-window', 'schedule-only', 'none', 'none'][(event_id % 5 + 1)::INTEGER] AS evidence, event_id % 3 <> 0 AS has_route, CASE WHEN event_id % 7 <> 0 THEN 1 END AS forecast, (event_id * 13 % 240)::DOUBLE AS age_minutes FROM ev)"""


def _claims(spark, sf):
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % len(names) + 1).cast("int"))
    return ev(spark, sf).select("event_id", "occurred_at", "delay_min", F.when(F.col("event_id") % 6 != 0, F.col("station")).alias("station"), pick(("moving", "depot", "planned", "station")).alias("operational"), pick(("reported-station-passage", "station-board-window", "schedule-only", "none", "none")).alias("evidence"),
                                (F.col("event_id") % 3 != 0).alias("has_route"), F.when(F.col("event_id") % 7 != 0, 1).alias("forecast"), (F.col("event_id") * 13 % 240).cast("double").alias("age_minutes"))


@job("b10_position_admission", f"""WITH {CLAIMS}, r AS (SELECT *, CASE WHEN age_minutes > 180 THEN 'source_expired' WHEN operational = 'depot' AND station IS NOT NULL THEN 'confirmed_depot' WHEN evidence = 'reported-station-passage' AND station IS NOT NULL THEN 'station_fact' WHEN evidence = 'station-board-window' AND station IS NOT NULL THEN 'station_window'
  WHEN evidence = 'schedule-only' OR operational = 'planned' THEN 'planned_only' WHEN operational = 'moving' AND NOT has_route THEN 'route_unavailable' WHEN operational = 'moving' AND forecast IS NULL AND station IS NULL THEN 'forecast_unavailable' WHEN operational = 'moving' THEN 'calculated_corridor' ELSE 'insufficient_evidence' END AS reason FROM clm),
f AS (SELECT *, reason IN ('confirmed_depot', 'station_fact', 'station_window') AS reported, reason = 'calculated_corridor' OR (reason = 'station_fact' AND has_route AND operational = 'moving') AS calculated FROM r)
SELECT event_id, reason, reported, calculated, reported OR calculated AS allowed FROM f""")
def b10(spark, sf):
    return screening.admission(_claims(spark, sf)).select("event_id", "reason", "reported", "calculated", "allowed")


@job("c25_registry_state", f"""WITH {CLAIMS} SELECT event_id, CASE WHEN operational = 'depot' THEN 'depot' WHEN evidence = 'station-board-window' THEN CASE WHEN has_route THEN 'expected_at_station' ELSE 'at_station' END WHEN evidence = 'reported-station-passage' THEN CASE WHEN operational = 'moving' THEN 'moving' ELSE 'at_station' END
  WHEN operational = 'moving' THEN 'moving' WHEN evidence = 'schedule-only' OR operational = 'planned' THEN 'planned' ELSE 'unobserved' END AS state FROM clm""")
def c25(spark, sf):
    return _claims(spark, sf).select("event_id", scalars.registry_state("operational", "evidence", F.col("has_route")).alias("state"))


@job("c20_weighted_quality", f"""WITH {CLAIMS} SELECT event_id, round(least(1.0, greatest(0.0, CASE WHEN age_minutes <= 20 THEN 1 WHEN age_minutes <= 45 THEN 0.72 WHEN age_minutes <= 120 THEN 0.42 ELSE 0.18 END * 0.3 + CASE WHEN has_route THEN greatest(0.48, 1 - least(delay_min, 140) / 210.0::DOUBLE) ELSE 0 END * 0.28 + CASE WHEN forecast IS NOT NULL THEN 1 ELSE 0 END * 0.24 + 0.7 * 0.18)), 6) AS quality FROM clm""")
def c20(spark, sf):
    return _claims(spark, sf).select("event_id", F.round(scalars.quality_score("age_minutes", F.col("has_route"), F.col("forecast").isNotNull(), F.lit(0.7), F.col("delay_min")), 6).alias("quality"))


@job("c24_station_lifecycle", f"""WITH {CLAIMS} SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'cancelled' WHEN station IS NOT NULL AND operational = 'depot' THEN CASE WHEN age_minutes <= 720 THEN 'depot' ELSE 'last-seen' END WHEN station IS NOT NULL AND event_id % 11 = 0 THEN 'departed'
  WHEN station IS NOT NULL AND event_id % 8 = 3 THEN CASE WHEN age_minutes <= 180 THEN 'completed' ELSE 'last-seen' END WHEN station IS NOT NULL AND operational = 'station' THEN CASE WHEN age_minutes <= 60 THEN 'dwelling' ELSE 'last-seen' END WHEN station IS NOT NULL THEN 'passed' WHEN evidence = 'station-board-window' THEN 'scheduled' ELSE 'in-transit' END AS phase FROM clm""")
def c24(spark, sf):
    at = lambda n, rest: F.col("event_id") % n == rest
    phase = scalars.station_lifecycle(at(17, 0), at(11, 0), "station", "operational", at(8, 3), F.col("operational") == "station", "evidence", "age_minutes")
    return _claims(spark, sf).select("event_id", phase.alias("phase"))


@job("b5_text_gate", """WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), v AS (SELECT *, CASE WHEN regexp_matches(t, 'token|@') THEN 'quarantined' WHEN NOT regexp_matches(t, 'the|que|der') THEN 'off-topic' WHEN regexp_matches(t, 'idiot') THEN 'excluded' ELSE 'accepted' END AS verdict FROM t)
SELECT doc_id, verdict, CASE WHEN verdict = 'accepted' THEN substr(t, 1, 80) WHEN verdict = 'quarantined' THEN regexp_replace(substr(t, 1, 80), '[\\p{L}\\p{N}]', '*', 'g') END AS excerpt FROM v""")
def b5(spark, sf):
    return screening.text_gate(table(spark, sf, "documents"), "token|@", "the|que|der", "idiot").select("doc_id", "verdict", "excerpt")


@job("b6_incident_class", """SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'pathetic') THEN 'damage' WHEN regexp_matches(lower(text), 'idiot') THEN 'closure' WHEN regexp_matches(lower(text), '[0-9]{4}') THEN 'status' ELSE 'none' END AS kind FROM documents""")
def b6(spark, sf):
    return table(spark, sf, "documents").select("doc_id", screening.first_rule(F.lower("text"), [("pathetic", "damage"), ("idiot", "closure"), ("[0-9]{4}", "status")], "none").alias("kind"))


@job("b9_registry_view", f"""WITH {EV} SELECT event_id, run_id, station, round(reliability, 4) AS reliability FROM ev WHERE station IN ('click', 'view') AND reliability >= 0.4 AND authority <> 'public' AND delay_min >= 15 AND station LIKE '%i%'""")
def b9(spark, sf):
    rows = ev(spark, sf).where(F.col("station").isin("click", "view") & (F.col("reliability") >= 0.4) & (F.col("authority") != "public") & (F.col("delay_min") >= 15))
    return screening.search(rows, ["station"], ["i"]).select("event_id", "run_id", "station", F.round("reliability", 4).alias("reliability"))


@job("b11_ledger_since", f"WITH {EV} SELECT event_id, station FROM ev WHERE occurred_at >= TIMESTAMP '2024-01-20 00:00:00' AND train = 7 ORDER BY occurred_at DESC, event_id DESC LIMIT 500")
def b11(spark, sf):
    return ev(spark, sf).where((F.col("occurred_at") >= "2024-01-20 00:00:00") & (F.col("train") == 7)).orderBy(F.desc("occurred_at"), F.desc("event_id")).limit(500).select("event_id", "station")


@job("b12_run_history", f"WITH {EV} SELECT event_id, station, delay_min FROM ev WHERE train = 9 AND occurred_at >= TIMESTAMP '2024-01-05 00:00:00' ORDER BY occurred_at, event_id LIMIT 200")
def b12(spark, sf):
    return ev(spark, sf).where((F.col("train") == 9) & (F.col("occurred_at") >= "2024-01-05 00:00:00")).orderBy("occurred_at", "event_id").limit(200).select("event_id", "station", "delay_min")


@job("b13_review_queue", "SELECT doc_id, coalesce(CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'approved' END, 'open') AS status, coalesce(toxic, 0) = 0 AND coalesce(quality, 0) = 1 AS promotable FROM documents LEFT JOIN labels USING (doc_id)")
def b13(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    status = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "approved").otherwise("open")
    return rows.select("doc_id", status.alias("status"), ((F.coalesce("toxic", F.lit(0)) == 0) & (F.coalesce("quality", F.lit(0)) == 1)).alias("promotable"))


@job("b14_moderated_promotion", f"""WITH {EV} SELECT event_id, 'moderated:' || event_id AS ledger_id, round({AGE.replace(NOW, '2024-01-15 12:00:00')}, 3) AS age FROM ev WHERE event_id % 4 = 1 AND {AGE.replace(NOW, '2024-01-15 12:00:00')} BETWEEN -5 AND 180""")
def b14(spark, sf):
    at = F.lit("2024-01-15 12:00:00").cast("timestamp")
    rows = ev(spark, sf)
    decisions = rows.where("event_id % 4 = 1").select("event_id")
    age = (F.unix_micros(at) - F.unix_micros("occurred_at")) / F.lit(60e6)
    return rows.join(decisions, "event_id").where(age.between(-5, 180)).select("event_id", F.concat(F.lit("moderated:"), F.col("event_id").cast("string")).alias("ledger_id"), F.round(age, 3).alias("age"))


@job("b19_station_board", f"""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY occurred_at, event_id) AS a, row_number() OVER (PARTITION BY run_id ORDER BY occurred_at DESC, event_id DESC) AS z FROM ev)
SELECT event_id, run_id, CASE WHEN a = 1 THEN 'departure' WHEN z = 1 THEN 'arrival' ELSE 'passage' END AS role, epoch_us(occurred_at) AS planned, epoch_us(observed_at) AS actual FROM r WHERE station = 'view' ORDER BY occurred_at DESC, event_id DESC LIMIT 120""")
def b19(spark, sf):
    from pyspark.sql import Window

    run = Window.partitionBy("run_id")
    rows = ev(spark, sf).withColumns({"a": F.row_number().over(run.orderBy("occurred_at", "event_id")), "z": F.row_number().over(run.orderBy(F.desc("occurred_at"), F.desc("event_id")))})
    role = F.when(F.col("a") == 1, "departure").when(F.col("z") == 1, "arrival").otherwise("passage")
    return rows.where("station = 'view'").orderBy(F.desc("occurred_at"), F.desc("event_id")).limit(120).select("event_id", "run_id", role.alias("role"), F.unix_micros("occurred_at").alias("planned"), F.unix_micros("observed_at").alias("actual"))


@job("b20_operator_filters", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND (o_totalprice < 50000 OR o_orderstatus = 'P')")
def b20(spark, sf):
    open_work = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").join(open_work, "o_orderkey", "left_semi").where("o_totalprice < 50000 OR o_orderstatus = 'P'").select("o_orderkey", "o_orderstatus")


@job("c18_unpivot", f"""WITH {EV}, k AS (SELECT event_id, run_id, occurred_at, delay_min, CASE WHEN event_id % 5 <> 0 THEN station ELSE '' END AS public_status, CASE WHEN event_id % 3 = 0 THEN strftime(occurred_at, '%H:%M') END AS arrival, CASE WHEN event_id % 4 = 0 THEN strftime(observed_at, '%H:%M') END AS departure, CASE WHEN event_id % 2 = 0 THEN station END AS station, CASE WHEN event_id % 7 = 0 THEN 'p' || (event_id % 9) END AS platform FROM ev),
u AS (SELECT event_id, run_id, occurred_at, unnest(list_filter([{{'t': 'movement_status', 'd': public_status}}, {{'t': 'delay_update', 'd': delay_min::VARCHAR}}, {{'t': 'forecast_arrival', 'd': arrival}}, {{'t': 'forecast_departure', 'd': departure}}, {{'t': 'station_report', 'd': station}}, {{'t': 'platform_update', 'd': platform}}], lambda x: coalesce(x.d, '') <> '')) AS e FROM k)
SELECT event_id || ':' || e.t AS ledger_id, run_id, epoch_us(occurred_at) AS occurred_at, e.t AS type, e.d AS detail FROM u""")
def c18(spark, sf):
    some = lambda n, x: F.when(F.col("event_id") % n == 0, x)
    rows = ev(spark, sf).withColumns({
        "public_status": F.when(F.col("event_id") % 5 != 0, F.col("station")).otherwise(""), "forecast_arrival": some(3, F.date_format("occurred_at", "HH:mm")), "forecast_departure": some(4, F.date_format("observed_at", "HH:mm")),
        "station": some(2, F.col("station")), "platform": some(7, F.concat(F.lit("p"), (F.col("event_id") % 9).cast("string"))),
    })
    return ledger.unpivot_update(rows).withColumn("occurred_at", F.unix_micros("occurred_at"))


@job("a18_append_new", f"WITH {EV} SELECT DISTINCT event_id, station FROM ev WHERE event_id % 3 = 0 AND event_id % 2 <> 0")
def a18(spark, sf):
    rows = ev(spark, sf)
    new = rows.where("event_id % 3 = 0")
    return ledger.append_new(rows.where("event_id % 2 = 0"), new.unionByName(new), "event_id").select("event_id", "station")


@job("a17_upsert", """WITH o AS (SELECT o_custkey AS k, max(o_totalprice) FILTER (o_orderkey % 2 = 0) AS p0, max(o_totalprice) FILTER (o_orderkey % 2 = 1) AS p1, min(o_orderkey) FILTER (o_orderkey % 2 = 0) AS f0, min(o_orderkey) FILTER (o_orderkey % 2 = 1) AS f1, max(o_orderdate) FILTER (o_orderkey % 2 = 0) AS d0, max(o_orderdate) FILTER (o_orderkey % 2 = 1) AS d1 FROM orders GROUP BY o_custkey)
SELECT k, coalesce(p1, p0) AS price, epoch_us(greatest(d0, d1)) AS last_date, coalesce(f0, f1) AS first_order FROM o""")
def a17(spark, sf):
    o = table(spark, sf, "orders")
    half = lambda n: o.where(f"o_orderkey % 2 = {n}").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("price"), F.max(F.col("o_orderdate").cast("timestamp")).alias("last_date"), F.min("o_orderkey").alias("first_order"))
    return ledger.upsert(half(0), half(1), "k", ["price"], ["last_date"], ["first_order"]).withColumn("last_date", F.unix_micros("last_date"))


@job("a19_cache", f"""WITH {EV}, o AS (SELECT event_id, station, run_id, occurred_at FROM ev WHERE service_date = '2024-01-14'), f AS (SELECT event_id, station, run_id, occurred_at FROM ev WHERE service_date = '2024-01-15' AND station IN ('view', 'click'))
SELECT event_id, station, 'fresh' AS origin FROM f UNION ALL SELECT event_id, station, 'kept' FROM o WHERE station NOT IN (SELECT station FROM f) AND epoch_us(TIMESTAMP '2024-01-15 00:00:00') - epoch_us(occurred_at) <= 8 * 3600000000::BIGINT""")
def a19(spark, sf):
    rows = ev(spark, sf)
    old, fresh = rows.where("service_date = '2024-01-14'"), rows.where("service_date = '2024-01-15' AND station IN ('view', 'click')")
    return ledger.refresh_cache(old, fresh, "station", F.lit("2024-01-15 00:00:00").cast("timestamp"), 8).select("event_id", "station", "origin")


@job("h9_replace_slice", f"WITH {EV} SELECT event_id, source_id FROM ev WHERE source_id <> 's2' AND event_id % 2 = 0 UNION ALL SELECT event_id, source_id FROM ev WHERE source_id = 's2' AND event_id % 2 = 1")
def h9(spark, sf):
    rows = ev(spark, sf).select("event_id", "source_id")
    return ledger.replace_slice(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), "source_id", "s2")


@job("a22_checkpoint_order", """SELECT o_orderkey, coalesce(o_orderdate >= max(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS accepted FROM orders""")
def a22(spark, sf):
    return ledger.accept_checkpoints(table(spark, sf, "orders"), "o_custkey", "o_orderkey", "o_orderdate").select("o_orderkey", "accepted")


@job("a21_retention", f"""WITH {EV}, c AS (SELECT source_id, max(occurred_at) AS through FROM ev WHERE event_id % 5 < 3 AND occurred_at < TIMESTAMP '2024-01-20 00:00:00' GROUP BY source_id)
SELECT event_id FROM ev LEFT JOIN c USING (source_id) WHERE NOT (epoch_us({TS}) - epoch_us(occurred_at) > 2 * 86400000000::BIGINT) OR through IS NULL OR occurred_at > through""")
def a21(spark, sf):
    rows = ev(spark, sf)
    covered = rows.where("event_id % 5 < 3 AND occurred_at < '2024-01-20 00:00:00'").groupBy("source_id").agg(F.max("occurred_at").alias("covered_through"))
    return ledger.prune(rows, covered, now_at(), 2).select("event_id")


@job("a16_snapshot", f"""WITH {EV} SELECT run_id, event_id, epoch_us(max(occurred_at) OVER ()) AS generated_at FROM (SELECT * FROM ev WHERE epoch_us(TIMESTAMP '2024-01-15 12:00:00') - epoch_us(occurred_at) BETWEEN 0 AND 43200000000 ORDER BY occurred_at DESC, event_id DESC LIMIT 1000)""")
def a16(spark, sf):
    at = F.lit("2024-01-15 12:00:00").cast("timestamp")
    rows = ev(spark, sf).where((F.unix_micros(at) - F.unix_micros("occurred_at")).between(0, 43_200_000_000)).orderBy(F.desc("occurred_at"), F.desc("event_id")).limit(1000)
    top = rows.agg(F.unix_micros(F.max("occurred_at")).alias("generated_at"))
    return rows.select("run_id", "event_id").crossJoin(F.broadcast(top))  # one row


@job("a12_tile_merge", "SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 <> 0 THEN p_name END, p_name) AS p_name, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'tile-b' END AS p_brand FROM part")
def a12(spark, sf):
    p = table(spark, sf, "part")
    one = p.select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).alias("p_name"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("p_brand"))
    return ledger.merge_tiles([one, p.select("p_partkey", "p_name", F.lit("tile-b").alias("p_brand"))], ["p_partkey"], ["p_name", "p_brand"])


@job("a28_chunked_export", "SELECT chunk, count(*) AS rows, min(p_partkey) AS first_key, max(p_partkey) AS last_key FROM (SELECT p_partkey, (row_number() OVER (ORDER BY p_partkey) - 1) // 125 AS chunk FROM part) GROUP BY chunk")
def a28(spark, sf):
    return ledger.chunked(table(spark, sf, "part").select("p_partkey"), ["p_partkey"], 125).groupBy("chunk").agg(F.count("*").alias("rows"), F.min("p_partkey").alias("first_key"), F.max("p_partkey").alias("last_key"))


@job("a24_region_select", "SELECT n_nationkey, upper(n_name) AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')")
def a24(spark, sf):
    wanted = table(spark, sf, "region").where(F.col("r_name").isin("ASIA", "EUROPE"))
    return table(spark, sf, "nation").join(wanted, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.upper("n_name").alias("name"))


@job("a26_timetable_validity", """WITH j AS (SELECT o_orderkey, l_linenumber, o_orderdate, l_shipdate FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE TIMESTAMP '1995-06-17 00:00:00' BETWEEN o_orderdate AND l_shipdate)
SELECT o_orderkey, l_linenumber, 'departure' AS role, epoch_us(o_orderdate) AS at FROM j UNION ALL SELECT o_orderkey, l_linenumber, 'arrival', epoch_us(l_shipdate) FROM j""")
def a26(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).where("timestamp'1995-06-17 00:00:00' BETWEEN o_orderdate AND l_shipdate")
    roles = F.explode(F.array(F.struct(F.lit("departure").alias("role"), F.col("o_orderdate").cast("timestamp").alias("at")), F.struct(F.lit("arrival").alias("role"), F.col("l_shipdate").cast("timestamp").alias("at"))))
    return rows.select("o_orderkey", "l_linenumber", roles.alias("r")).select("o_orderkey", "l_linenumber", "r.role", F.unix_micros("r.at").alias("at"))


@job("a23_health_summary", f"WITH {EV} SELECT source_id, count(*) AS checks, count(*) FILTER (station <> 'error') AS online, min(delay_min) AS least_records, max(delay_min) AS most_records, arg_max(station, (occurred_at, event_id)) AS last_status FROM ev GROUP BY source_id")
def a23(spark, sf):
    return ev(spark, sf).groupBy("source_id").agg(F.count("*").alias("checks"), F.count_if(F.col("station") != "error").alias("online"), F.min("delay_min").alias("least_records"), F.max("delay_min").alias("most_records"), F.max_by("station", F.struct("occurred_at", "event_id")).alias("last_status"))


@job("c1_slug", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def c1(spark, sf):
    return table(spark, sf, "part").select("p_partkey", scalars.slug("p_name").alias("slug"))


@job("c3_train_number", """WITH k AS (SELECT c_custkey, lpad((c_custkey % 40)::VARCHAR, 3, '0') || '/' || (c_custkey % 41) AS a, (c_custkey % 20) || '' AS b FROM customer)
SELECT c_custkey, a, b, list_has_any(list_transform(string_split(a, '/'), lambda x: ltrim(x, '0')), list_transform(string_split(b, '/'), lambda x: ltrim(x, '0'))) AS same FROM k""")
def c3(spark, sf):
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select("c_custkey", F.concat_ws("/", F.lpad((k % 40).cast("string"), 3, "0"), (k % 41).cast("string")).alias("a"), (k % 20).cast("string").alias("b"))
    return rows.withColumn("same", scalars.same_train("a", "b"))


@job("c4_delay_text", """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 4 WHEN 0 THEN l_quantity::INTEGER WHEN 1 THEN 60 + l_quantity::INTEGER WHEN 2 THEN l_quantity::INTEGER END AS delay FROM lineitem""")
def c4(spark, sf):
    q, n = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber") % 4
    text = F.when(n == 0, F.concat(F.lit("at 12:45 late by "), q, F.lit(" min"))).when(n == 1, F.concat(F.lit("1 h "), q, F.lit(" min"))).when(n == 2, F.concat(F.lit("+"), q)).otherwise("departs 09:15")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", scalars.delay_minutes(text).alias("delay"))


@job("c11_freshness", f"""WITH {EV}, a AS (SELECT event_id, greatest(0.0::DOUBLE, (epoch_us(TIMESTAMP '2024-01-15 12:00:00') - epoch_us(occurred_at)) / 60e6) AS age FROM ev)
SELECT event_id, CASE WHEN age <= 30 THEN 'fresh' WHEN age <= 60 THEN 'watch' WHEN age <= 90 THEN 'degraded' WHEN age <= 180 THEN 'stale' ELSE 'expired' END AS class,
  round(CASE WHEN age <= 30 THEN 1.0 WHEN age <= 60 THEN greatest(0.8, 1 - (age - 30) / 150) WHEN age <= 90 THEN greatest(0.5, 0.8 - (age - 60) / 100) WHEN age <= 180 THEN greatest(0.3, 0.5 - (age - 90) / 450) ELSE 0.0 END, 6) AS factor FROM a""")
def c11(spark, sf):
    age = (F.unix_micros(F.lit("2024-01-15 12:00:00").cast("timestamp")) - F.unix_micros("occurred_at")) / F.lit(60e6)
    return ev(spark, sf).select("event_id", scalars.freshness_class(age).alias("class"), F.round(scalars.freshness_factor(age), 6).alias("factor"))


@job("c12_buckets", f"""WITH {EV} SELECT event_id, CASE WHEN hour(occurred_at) < 6 THEN 'night' WHEN hour(occurred_at) < 12 THEN 'morning' WHEN hour(occurred_at) < 18 THEN 'day' ELSE 'evening' END AS daypart,
  CASE WHEN delay_min <= 30 THEN 'short' WHEN delay_min <= 120 THEN 'medium' ELSE 'long' END AS horizon, CASE WHEN month(occurred_at) IN (12, 1, 2) THEN 'winter' WHEN month(occurred_at) <= 5 THEN 'spring' WHEN month(occurred_at) <= 8 THEN 'summer' ELSE 'autumn' END AS season, dayofweek(occurred_at)::INTEGER AS weekday FROM ev""")
def c12(spark, sf):
    return ev(spark, sf).select("event_id", scalars.daypart("occurred_at").alias("daypart"), scalars.horizon("delay_min").alias("horizon"), scalars.season("occurred_at").alias("season"), (F.dayofweek("occurred_at") - 1).alias("weekday"))


@job("c13_floor_time", f"WITH {EV} SELECT event_id, (epoch_us(occurred_at) // 900000000) * 900000000 AS bucket FROM ev")
def c13(spark, sf):
    return ev(spark, sf).select("event_id", F.unix_micros(scalars.floor_time("occurred_at", 15)).alias("bucket"))


@job("c7_nearest_clock", f"""WITH {EV}, m AS (SELECT event_id, epoch_us(occurred_at) AS t, (epoch_us(occurred_at) // 86400000000) * 86400000000 AS mid, (event_id * 37 % 1440) * 60000000 AS clock FROM ev),
o AS (SELECT event_id, t, unnest([mid - 86400000000 + clock, mid + clock, mid + 86400000000 + clock]) AS c FROM m)
SELECT event_id, arg_min(c, (abs(c - t), c)) AS nearest FROM o GROUP BY event_id""")
def c7(spark, sf):
    return ev(spark, sf).select("event_id", F.unix_micros(scalars.nearest_clock("occurred_at", F.pmod(F.col("event_id") * 37, F.lit(1440)))).alias("nearest"))


@job("c14_name_match", """WITH k AS (SELECT p_partkey, p_name AS a, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN substr(p_name, 2) ELSE 'x' || substr(p_name, 3) END AS b FROM part),
s AS (SELECT p_partkey, regexp_replace(regexp_replace(lower(a), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-|-$', '', 'g') AS a, regexp_replace(regexp_replace(lower(b), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-|-$', '', 'g') AS b FROM k)
SELECT p_partkey, a = b OR (least(length(a), length(b)) >= 5 AND levenshtein(a, b) <= 1) AS same FROM s""")
def c14(spark, sf):
    n, k = F.col("p_name"), F.col("p_partkey") % 3
    other = F.when(k == 0, n).when(k == 1, F.substr(n, F.lit(2))).otherwise(F.concat(F.lit("x"), F.substr(n, F.lit(3))))
    return table(spark, sf, "part").select("p_partkey", scalars.name_match("p_name", other).alias("same"))


@job("h1_top_scores", f"WITH {EV} SELECT station, train, count(*) AS reports, round(sum(reliability) * 4 + max(delay_min) * 0.08, 4) AS score FROM ev GROUP BY ALL ORDER BY score DESC, station, train LIMIT 100")
def h1(spark, sf):
    rows = ev(spark, sf).groupBy("station", "train").agg(F.count("*").alias("reports"), F.round(F.sum("reliability") * 4 + F.max("delay_min") * 0.08, 4).alias("score"))
    return rows.orderBy(F.desc("score"), "station", "train").limit(100)


@job("h6_round_robin", "SELECT s_suppkey, (row_number() OVER (ORDER BY s_suppkey) - 1) % 4 AS shard FROM supplier")
def h6(spark, sf):
    from ledgerline.plans.offsets import running_start

    rows = running_start(table(spark, sf, "supplier").select("s_suppkey").withColumn("one", F.lit(1)), [F.col("s_suppkey")], "one", "place")
    return rows.select("s_suppkey", (F.col("place") % 4).alias("shard"))


@job("h7_union_last_wins", f"WITH {EV}, u AS (SELECT event_id, 'a' AS batch FROM ev WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'b' FROM ev WHERE event_id % 3 = 0) SELECT event_id, max(batch) AS batch FROM u GROUP BY event_id")
def h7(spark, sf):
    rows = ev(spark, sf).select("event_id")
    both = rows.where("event_id % 2 = 0").withColumn("batch", F.lit("a")).unionByName(rows.where("event_id % 3 = 0").withColumn("batch", F.lit("b")))
    return ledger.last_wins(both, "event_id", F.col("batch"))


@job("h8_union_first_wins", f"""WITH {EV}, u AS (SELECT run_id AS id, 'observed' AS origin, 0 AS p FROM ev UNION ALL SELECT (o_custkey % 150) || ':' || '2024-01-05', 'expected', 1 FROM orders)
SELECT id, arg_min(origin, p) AS origin FROM u GROUP BY id""")
def h8(spark, sf):
    seen = ev(spark, sf).select(F.col("run_id").alias("id"), F.lit("observed").alias("origin")).distinct()
    planned = table(spark, sf, "orders").select(F.concat_ws(":", (F.col("o_custkey") % 150).cast("string"), F.lit("2024-01-05")).alias("id"), F.lit("expected").alias("origin")).distinct()
    return ledger.last_wins(seen.unionByName(planned), "id", F.col("origin"))


@job("h10_severity_order", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 50")
def h10(spark, sf):
    rank = F.when(F.substring("o_orderpriority", 1, 1) == "1", 0).when(F.substring("o_orderpriority", 1, 1) == "2", 1).otherwise(2)
    return table(spark, sf, "orders").orderBy(rank, F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_orderpriority")


@job("h11_event_feed", f"WITH {EV} SELECT event_id, run_id, station FROM ev ORDER BY occurred_at DESC, event_id DESC LIMIT 30")
def h11(spark, sf):
    return ev(spark, sf).orderBy(F.desc("occurred_at"), F.desc("event_id")).limit(30).select("event_id", "run_id", "station")


@job("e21_status_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS orders FROM orders GROUP BY ALL")
def e21(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("orders"))
