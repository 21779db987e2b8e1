"""Registered queries: coverage, sources, demand, remaining joins and expressions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions import scalars
from ledgerline.operators import coverage, graph, ledger
from ledgerline.plans.proxy import EV, G_EDGES, PTS, ev, g_edges, pts, table
from ledgerline.plans.registry import job

NOON = "2024-01-15 12:00:00"
TS = f"TIMESTAMP '{NOON}'"
THEN = "1995-06-17 00:00:00"


def _at(text: str):
    return F.lit(text).cast("timestamp")


EXPECTED = """pln AS (SELECT o_orderkey AS run_id, 's' || (o_custkey % 5) AS source_id FROM orders), cal AS (SELECT l_orderkey AS run_id, 'p' || (l_partkey % 50) AS station, l_shipdate AS t_at FROM lineitem),
hd AS (SELECT run_id, array_to_string(list_sort(list(DISTINCT source_id)), ',') AS sources, count(*) AS discoveries FROM pln GROUP BY run_id), sp AS (SELECT run_id, count(DISTINCT station) AS stations, min(t_at) AS departure, max(t_at) AS arrival FROM cal GROUP BY run_id),
exr AS (SELECT * FROM hd LEFT JOIN sp USING (run_id))"""


def _expected(spark, sf):
    plans = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.concat(F.lit("s"), (F.col("o_custkey") % 5).cast("string")).alias("source_id"))
    return coverage.expected_runs(plans, _calls(spark, sf))


def _calls(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.concat(F.lit("p"), (F.col("l_partkey") % 50).cast("string")).alias("station"), F.col("l_shipdate").cast("timestamp").alias("at"))


@job("e23_expected_runs", f"WITH {EXPECTED} SELECT run_id, sources, discoveries, stations, epoch_us(departure) AS departure, epoch_us(arrival) AS arrival FROM exr")
def e23(spark, sf):
    return _expected(spark, sf).withColumns({c: F.unix_micros(c) for c in ("departure", "arrival")})


COVER = f"""{EXPECTED}, fct AS (SELECT run_id, count(*) AS facts, max(t_at) AS last_at, arg_max(station, (t_at, station)) AS last_station FROM cal WHERE t_at <= TIMESTAMP '{THEN}' GROUP BY run_id), cov AS (SELECT e.*, coalesce(facts, 0) AS facts, last_at, last_station FROM exr e LEFT JOIN fct USING (run_id))"""


def _covered(spark, sf):
    return coverage.live_coverage(_expected(spark, sf), _calls(spark, sf).where(F.col("at") <= _at(THEN)))


@job("e25_live_coverage", f"WITH {COVER} SELECT run_id, facts, epoch_us(last_at) AS last_at, last_station FROM cov")
def e25(spark, sf):
    return _covered(spark, sf).select("run_id", "facts", F.unix_micros("last_at").alias("last_at"), "last_station")


NAMES = ("completed", "at-station", "moving", "depot")
STATUS = f"""{COVER}, opr AS (SELECT *, last_at + to_minutes(run_id % 480) AS seen_at, ['completed', 'at-station', 'moving', 'depot'][(run_id % 4 + 1)::INTEGER] AS operational, departure::DATE::TIMESTAMP AS day, TIMESTAMP '{THEN}' AS now FROM cov),
aged AS (SELECT *, (epoch_us(now) - epoch_us(seen_at)) / 60e6 AS age FROM opr), sta AS (SELECT *, CASE WHEN age <= 90 THEN CASE operational WHEN 'completed' THEN 'completed' WHEN 'moving' THEN 'active' ELSE 'at_station' END WHEN age <= 360 THEN 'unobserved' WHEN now < departure + INTERVAL 20 MINUTE THEN 'planned'
  WHEN departure IS NULL AND now < day + INTERVAL 6 HOUR THEN 'planned' WHEN now > arrival + INTERVAL 3 HOUR OR now > day + INTERVAL 1 DAY - INTERVAL 1 SECOND + INTERVAL 6 HOUR THEN 'unknown_completion' ELSE 'unobserved' END AS status,
  epoch_us(CASE WHEN age <= 90 THEN NULL WHEN age <= 360 THEN seen_at + INTERVAL 90 MINUTE WHEN now < departure + INTERVAL 20 MINUTE OR departure IS NULL AND now < day + INTERVAL 6 HOUR THEN NULL WHEN now > arrival + INTERVAL 3 HOUR THEN arrival + INTERVAL 1 HOUR
  WHEN now > day + INTERVAL 1 DAY - INTERVAL 1 SECOND + INTERVAL 6 HOUR THEN day + INTERVAL 1 DAY - INTERVAL 1 SECOND ELSE coalesce(departure + INTERVAL 20 MINUTE, day + INTERVAL 6 HOUR) END) AS missing_since FROM aged)"""


def _statuses(spark, sf):
    names = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("run_id") % 4 + 1).cast("int"))
    seen = F.timestamp_micros(F.unix_micros("last_at") + F.col("run_id") % 480 * 60_000_000)
    rows = _covered(spark, sf).withColumns({"last_at": seen, "operational": names, "service_date": F.to_date("departure")})
    return coverage.run_status(rows, _at(THEN))


@job("m17_run_status", f"WITH {STATUS} SELECT run_id, status, missing_since FROM sta")
def m17(spark, sf):
    return _statuses(spark, sf).select("run_id", "status", F.unix_micros("missing_since").alias("missing_since"))


@job("e30_readiness", f"""WITH {STATUS} SELECT count(*) AS runs, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'active') AS active, CASE WHEN count(*) FILTER (status = 'active') > 0 AND count(*) FILTER (status = 'completed') > 0 THEN 'ready' ELSE 'degraded' END AS readiness FROM sta""")
def e30(spark, sf):
    out = _statuses(spark, sf).agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "active").alias("active"))
    return out.withColumn("readiness", F.when((F.col("active") > 0) & (F.col("completed") > 0), "ready").otherwise("degraded"))


@job("e30_operational_readiness", f"""WITH {STATUS}, {G_EDGES}, c AS (SELECT (SELECT count(*) FROM g_edges) > 0 AS graph, (SELECT count(*) FROM sta) > 0 AS expected_registry, (SELECT count(*) FROM events WHERE event_id % 3 = 0) > 0 AS observation_fusion, (SELECT count(*) FROM events WHERE value < 0) > 0 AS current_states)
SELECT *, graph::INTEGER + expected_registry::INTEGER + observation_fusion::INTEGER + current_states::INTEGER AS ready_count, CASE graph::INTEGER + expected_registry::INTEGER + observation_fusion::INTEGER + current_states::INTEGER WHEN 4 THEN 'operational' WHEN 0 THEN 'insufficient-evidence' ELSE 'warming' END AS status,
  (SELECT string_agg(status || ':' || n, ',' ORDER BY status) FROM (SELECT status, count(*) AS n FROM sta GROUP BY status)) AS statuses FROM c""")
def e30_readiness(spark, sf):
    e = ev(spark, sf)
    out = coverage.readiness(g_edges(spark, sf), _statuses(spark, sf), e.where("event_id % 3 = 0"), e.where("value < 0"))
    return out.withColumn("statuses", F.array_join(F.transform("statuses", lambda x: F.concat_ws(":", x["status"], x["n"].cast("string"))), ","))


PRIORITY = f"""{EV}, need AS (SELECT station || ':' || train AS station, count(DISTINCT run_id) AS expected, count(*) FILTER (delay_min >= 80) AS silent, count(DISTINCT source_id) - 1 AS ambiguous, count(*) FILTER (reliability < 0.05) AS overdue, max(value) AS activity, min((epoch_us({TS}) - epoch_us(occurred_at)) / 60e6) FILTER (occurred_at <= {TS}) AS silence FROM ev GROUP BY 1),
pri AS (SELECT *, round(expected * 4 + silent * 18 + ambiguous * 14 + overdue * 24 + least(22.0, greatest(0.0, coalesce(silence, 720.0)) / 30) + least(100.0, greatest(0.0, activity)) * 0.08, 4) AS score FROM need)"""


def _priorities(spark, sf):
    age = (F.unix_micros(_at(NOON)) - F.unix_micros("occurred_at")) / F.lit(60e6)
    rows = ev(spark, sf).groupBy(F.concat_ws(":", "station", F.col("train").cast("string")).alias("station")).agg(F.countDistinct("run_id").alias("expected"), F.count_if(F.col("delay_min") >= 80).alias("silent"), (F.countDistinct("source_id") - 1).alias("ambiguous"), F.count_if(F.col("reliability") < 0.05).alias("overdue"), F.max("value").alias("activity"), F.min(F.when(age >= 0, age)).alias("silence_minutes"))
    return coverage.station_priority(rows)


@job("e16_station_priority", f"WITH {PRIORITY} SELECT station, score FROM pri ORDER BY score DESC, station LIMIT 500")
def e16(spark, sf):
    return _priorities(spark, sf).orderBy(F.desc("score"), "station").limit(500).select("station", "score")


@job("h3_collection_plan", f"WITH {PRIORITY} SELECT station, CASE WHEN score >= 80 THEN 'critical' WHEN score >= 45 THEN 'high' WHEN score >= 20 THEN 'normal' ELSE 'low' END AS tier, CASE WHEN score >= 80 THEN 2 WHEN score >= 45 THEN 5 WHEN score >= 20 THEN 10 ELSE 20 END AS interval_minutes, least(6, greatest(1, ceil(score / 20)))::INTEGER AS request_weight FROM pri")
def h3(spark, sf):
    return coverage.collection_plan(_priorities(spark, sf)).select("station", "tier", "interval_minutes", "request_weight")


@job("h2_station_rank", f"WITH {EV} SELECT station, authority, dense_rank() OVER (PARTITION BY authority ORDER BY n DESC, station) AS place FROM (SELECT station, authority, count(*) AS n FROM ev GROUP BY ALL)")
def h2(spark, sf):
    counts = ev(spark, sf).groupBy("station", "authority").agg(F.count("*").alias("n"))
    return counts.select("station", "authority", F.dense_rank().over(Window.partitionBy("authority").orderBy(F.desc("n"), "station")).alias("place"))


SOURCES = f"""{EV}, src AS (SELECT source_id, station AS capability, round(avg(reliability), 6) AS reliability, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(occurred_at))) / 60e6 AS age, count(*) FILTER (delay_min > 5) AS records, count(*) % 7 AS failures FROM ev GROUP BY ALL),
sst AS (SELECT *, CASE WHEN failures >= 5 THEN 'open' WHEN records = 0 THEN 'empty' WHEN failures > 0 THEN 'degraded' ELSE 'usable' END AS state FROM src), ssc AS (SELECT *, round(CASE WHEN state IN ('open', 'empty') THEN 0.0 ELSE reliability * 0.55 + greatest(0.0, 1 - age / (600 * 3)) * 0.35 + least(1.0, records / 100.0::DOUBLE) * 0.1 END, 6) AS score FROM sst)"""


def _sources(spark, sf):
    rows = ev(spark, sf).groupBy("source_id", F.col("station").alias("capability")).agg(F.round(F.avg("reliability"), 6).alias("reliability"), ((F.unix_micros(_at("2024-01-31 00:00:00")) - F.unix_micros(F.max("occurred_at"))) / F.lit(60e6)).alias("age_minutes"), F.count_if(F.col("delay_min") > 5).alias("records"), (F.count("*") % 7).alias("failures"))
    return coverage.source_score(rows.withColumn("cadence_minutes", F.lit(600)))


@job("h4_source_failover", f"WITH {SOURCES} SELECT capability, source_id, state, score FROM ssc WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY capability ORDER BY score DESC, source_id) = 1")
def h4(spark, sf):
    return coverage.failover(_sources(spark, sf), "capability").select("capability", "source_id", "state", "score")


@job("h5_circuit_rules", f"WITH {SOURCES} SELECT source_id, capability, CASE WHEN failures >= 5 THEN 'open' WHEN failures >= 3 THEN 'half-open' ELSE 'closed' END AS circuit, CASE WHEN failures >= 5 THEN least(60, 5 * (failures - 4)) WHEN failures >= 3 THEN 2 ELSE 0 END AS retry_minutes FROM ssc")
def h5(spark, sf):
    return coverage.circuit(_sources(spark, sf)).select("source_id", "capability", "circuit", "retry_minutes")


@job("e33_source_states", f"WITH {SOURCES} SELECT state, count(*) AS sources FROM ssc GROUP BY state")
def e33(spark, sf):
    return _sources(spark, sf).groupBy("state").agg(F.count("*").alias("sources"))


@job("e22_health_summary", f"WITH {EV} SELECT source_id, service_date, count(*) AS checks, count(*) FILTER (station <> 'error') AS online, round(count(*) FILTER (station <> 'error') / count(*)::DOUBLE, 4) AS ratio FROM ev GROUP BY ALL")
def e22(spark, sf):
    good = F.count_if(F.col("station") != "error")
    return ev(spark, sf).groupBy("source_id", "service_date").agg(F.count("*").alias("checks"), good.alias("online"), F.round(good / F.count("*"), 4).alias("ratio"))


@job("e31_service_levels", f"WITH {EV} SELECT round((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(occurred_at))) / 60e6, 2) AS age_minutes, round(count(*) FILTER (station <> 'error') / count(*)::DOUBLE, 4) AS availability, count(DISTINCT source_id) AS sources FROM ev")
def e31(spark, sf):
    return ev(spark, sf).agg(F.round((F.unix_micros(_at("2024-01-31 00:00:00")) - F.unix_micros(F.max("occurred_at"))) / F.lit(60e6), 2).alias("age_minutes"), F.round(F.count_if(F.col("station") != "error") / F.count("*"), 4).alias("availability"), F.countDistinct("source_id").alias("sources"))


@job("e26_registry_summary", f"WITH {EV} SELECT authority, count(*) AS reports, count(DISTINCT run_id) AS runs, count(*) FILTER (reliability >= 0.5) AS positioned, count(*) FILTER (delay_min >= 60) AS delayed FROM ev GROUP BY authority")
def e26(spark, sf):
    return ev(spark, sf).groupBy("authority").agg(F.count("*").alias("reports"), F.countDistinct("run_id").alias("runs"), F.count_if(F.col("reliability") >= 0.5).alias("positioned"), F.count_if(F.col("delay_min") >= 60).alias("delayed"))


@job("e19_station_queues", f"WITH {EV} SELECT station, service_date, count(*) AS entries, count(*) FILTER (reliability >= 0.4) AS confirmed, count(*) FILTER (reliability < 0.4) AS waiting, arg_min(run_id, (occurred_at, event_id)) AS first_run FROM ev GROUP BY ALL")
def e19(spark, sf):
    return ev(spark, sf).groupBy("station", "service_date").agg(F.count("*").alias("entries"), F.count_if(F.col("reliability") >= 0.4).alias("confirmed"), F.count_if(F.col("reliability") < 0.4).alias("waiting"), F.min_by("run_id", F.struct("occurred_at", "event_id")).alias("first_run"))


@job("e29_board_demand", f"WITH {EV}, r AS (SELECT unnest([{{'s': station, 'p': 3}}, {{'s': authority, 'p': 2}}, {{'s': source_id, 'p': 1}}]) AS r, train FROM ev) SELECT r.s AS station, sum(r.p)::BIGINT AS points, count(DISTINCT train) AS trains FROM r GROUP BY 1")
def e29(spark, sf):
    roles = F.explode(F.array(*[F.struct(F.col(c).alias("s"), F.lit(p).alias("p")) for c, p in (("station", 3), ("authority", 2), ("source_id", 1))]))
    return ev(spark, sf).select("train", roles.alias("r")).groupBy(F.col("r.s").alias("station")).agg(F.sum("r.p").alias("points"), F.countDistinct("train").alias("trains"))


@job("e24_itinerary_accumulation", f"""WITH {EV}, a AS (SELECT train AS run_id, list(station ORDER BY occurred_at, event_id) AS stations FROM ev WHERE service_date <= '2024-01-15' GROUP BY train), b AS (SELECT train AS run_id, list(station ORDER BY occurred_at, event_id) AS stations FROM ev WHERE service_date > '2024-01-15' GROUP BY train), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT run_id, array_to_string(list_sort(list_distinct(flatten(list(stations)))), ',') AS known, array_to_string(arg_max(stations, (len(stations), array_to_string(stations, '>'))), '>') AS longest FROM u GROUP BY run_id""")
def e24(spark, sf):
    def half(test: str):
        rows = ev(spark, sf).where(test).groupBy(F.col("train").alias("run_id")).agg(F.array_sort(F.collect_list(F.struct("occurred_at", "event_id", "station"))).alias("x"))
        return rows.select("run_id", F.transform("x", lambda s: s["station"]).alias("stations"))

    out = coverage.merge_itineraries(half("service_date <= '2024-01-15'"), half("service_date > '2024-01-15'"))
    return out.select("run_id", F.array_join("known", ",").alias("known"), F.array_join("longest", ">").alias("longest"))


@job("g21_itinerary_versions", f"""WITH {EV}, d AS (SELECT train, service_date, array_to_string(list_sort(list(DISTINCT station)), '>') AS stops FROM ev GROUP BY ALL), c AS (SELECT *, CASE WHEN stops = lag(stops) OVER w THEN 0 ELSE 1 END AS changed FROM d WINDOW w AS (PARTITION BY train ORDER BY service_date))
SELECT train, service_date, stops, sum(changed) OVER (PARTITION BY train ORDER BY service_date ROWS UNBOUNDED PRECEDING)::BIGINT AS version FROM c""")
def g21(spark, sf):
    days = ev(spark, sf).groupBy("train", "service_date").agg(F.array_join(F.array_sort(F.collect_set("station")), ">").alias("stops"))
    return coverage.versioned(days, "train", "service_date", F.col("stops")).select("train", "service_date", "stops", "version")


@job("d2_alias_lookup", f"WITH {EV}, al AS (SELECT * FROM (VALUES ('view', 'n1'), ('click', 'n2'), ('error', 'n3')) t(alias, node)) SELECT event_id, coalesce(node, station) AS node FROM ev LEFT JOIN al ON alias = station")
def d2(spark, sf):
    alias = spark.createDataFrame([("view", "n1"), ("click", "n2"), ("error", "n3")], "alias string, node string")
    return ev(spark, sf).join(F.broadcast(alias), F.col("alias") == F.col("station"), "left").select("event_id", F.coalesce("node", "station").alias("node"))


@job("d15_geometry_priority", f"""WITH {G_EDGES}, e AS (SELECT DISTINCT src, dst FROM g_edges), a AS (SELECT src, dst, min(km) AS km FROM g_edges WHERE src % 3 = 0 GROUP BY ALL), b AS (SELECT src, dst, min(km) + 1 AS km FROM g_edges WHERE src % 2 = 0 GROUP BY ALL)
SELECT e.src, e.dst, coalesce(a.km, b.km, 99.0) AS km, CASE WHEN a.km IS NOT NULL THEN 'reference' WHEN b.km IS NOT NULL THEN 'cache' ELSE 'learned' END AS origin FROM e LEFT JOIN a USING (src, dst) LEFT JOIN b USING (src, dst)""")
def d15(spark, sf):
    edges = g_edges(spark, sf)
    best = lambda test, name, more: edges.where(test).groupBy("src", "dst").agg((F.min("km") + more).alias(name))
    j = edges.select("src", "dst").distinct().join(best("src % 3 = 0", "a", 0), ["src", "dst"], "left").join(best("src % 2 = 0", "b", 1), ["src", "dst"], "left")
    return j.select("src", "dst", F.coalesce("a", "b", F.lit(99.0)).alias("km"), F.when(F.col("a").isNotNull(), "reference").when(F.col("b").isNotNull(), "cache").otherwise("learned").alias("origin"))


@job("d16_route_plan_enrichment", f"WITH {EV}, p AS (SELECT o_custkey % 150 AS train, max(o_totalprice) AS plan FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1) SELECT event_id, plan FROM ev LEFT JOIN p USING (train)")
def d16(spark, sf):
    plans = table(spark, sf, "orders").where("o_orderkey % 3 = 0").groupBy((F.col("o_custkey") % 150).alias("train")).agg(F.max("o_totalprice").alias("plan"))
    return ev(spark, sf).join(plans, "train", "left").select("event_id", "plan")


@job("d20_coverage_join", f"""WITH {PRIORITY}, h AS (SELECT station || ':' || train AS station, arg_max(source_id, (occurred_at, event_id)) AS last_source FROM ev GROUP BY 1) SELECT station, score, last_source FROM pri LEFT JOIN h USING (station)""")
def d20(spark, sf):
    polls = ev(spark, sf).groupBy(F.concat_ws(":", "station", F.col("train").cast("string")).alias("station")).agg(F.max_by("source_id", F.struct("occurred_at", "event_id")).alias("last_source"))
    return _priorities(spark, sf).select("station", "score").join(polls, "station", "left")


@job("d21_operations_view", f"""WITH {EV}, chg AS (SELECT run_id, count(*) AS changes FROM (SELECT run_id, station <> lag(station) OVER (PARTITION BY run_id ORDER BY occurred_at, event_id) AS moved FROM ev) WHERE moved GROUP BY run_id)
SELECT run_id, count(*) AS facts, array_to_string(list(station ORDER BY occurred_at, event_id), '>') AS history, max(delay_min) AS worst, arg_max(station, (occurred_at, event_id)) AS station, coalesce(max(changes), 0) AS changes,
  CASE WHEN (epoch_us({TS}) - epoch_us(max(occurred_at))) / 60e6 > 180 THEN 'unknown' WHEN (epoch_us({TS}) - epoch_us(max(occurred_at))) / 60e6 > 90 THEN 'stale' ELSE 'estimated' END AS position FROM ev LEFT JOIN chg USING (run_id) GROUP BY run_id""")
def d21(spark, sf):
    rows = coverage.operations_view(ev(spark, sf), _at(NOON))
    return rows.withColumn("history", F.array_join(F.transform("history", lambda h: h["station"]), ">"))


@job("d22_catalogue_detail", "SELECT p_partkey, p_name, n, last_ship FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, epoch_us(max(l_shipdate)) AS last_ship FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')")
def d22(spark, sf):
    items = table(spark, sf, "lineitem")
    use = items.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"), F.unix_micros(F.max("l_shipdate").cast("timestamp")).alias("last_ship"))
    allowed = items.where("l_returnflag = 'A'").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf, "part").join(allowed, "p_partkey", "left_semi").join(use, "p_partkey", "left").select("p_partkey", "p_name", "n", "last_ship")


@job("a15_import_progress", """WITH c AS (SELECT o_orderdate::TIMESTAMP AS t_at, count(*) AS chunks FROM orders GROUP BY 1), t AS (SELECT count(*)::BIGINT AS planned FROM orders),
r AS (SELECT t_at, chunks, (sum(chunks) OVER w)::BIGINT AS done, (epoch_us(t_at) - epoch_us(min(t_at) OVER ())) / 3.6e9 AS hours, (epoch_us(lead(t_at) OVER w) - epoch_us(t_at)) / 60e6 AS pause, planned FROM c, t WINDOW w AS (ORDER BY t_at))
SELECT strftime(t_at, '%Y-%m-%d') AS day, chunks, done, round(CASE WHEN hours > 0 THEN done / hours END, 4) AS per_hour, round(CASE WHEN hours > 0 THEN (planned - done) / (done / hours) END, 3) AS eta_hours, coalesce(pause > 1440, false) AS stalled FROM r""")
def a15(spark, sf):
    orders = table(spark, sf, "orders")
    at = orders.groupBy(F.col("o_orderdate").cast("timestamp").alias("at")).agg(F.count("*").alias("chunks"))
    return coverage.import_progress(at, orders.agg(F.count("*").alias("planned")), 1440).select(F.date_format("at", "yyyy-MM-dd").alias("day"), "chunks", "done", "per_hour", "eta_hours", "stalled")


@job("a25_partner_clean", f"WITH {PTS}, c AS (SELECT id, brand, round(lat, 1) AS la, round(lon, 1) AS lo, 'ph' || (id % 90) AS phone FROM lpts), k AS (SELECT *, row_number() OVER (PARTITION BY brand, la, lo ORDER BY id) AS n, count(*) OVER (PARTITION BY phone) AS shared FROM c) SELECT id, CASE WHEN shared <= 10 THEN phone END AS phone FROM k WHERE n = 1")
def a25(spark, sf):
    rows = pts(spark, sf)[0].select("id", "brand", F.round("lat", 1).alias("la"), F.round("lon", 1).alias("lo"), F.concat(F.lit("ph"), (F.col("id") % 90).cast("string")).alias("phone"))
    shared = rows.groupBy("phone").agg(F.count("*").alias("shared"))
    first = Window.partitionBy("brand", "la", "lo").orderBy("id")
    return rows.join(shared, "phone").withColumn("n", F.row_number().over(first)).where("n = 1").select("id", F.when(F.col("shared") <= 10, F.col("phone")).alias("phone"))


@job("a27_field_mapping", "SELECT 'doc:' || doc_id AS id, lang AS kind, length(text) AS size FROM documents UNION ALL SELECT 'conv:' || conv_id || ':' || turn, role, length(text) FROM conversations")
def a27(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"), F.col("lang").alias("kind"), F.length("text").alias("size"))
    c = table(spark, sf, "conversations").select(F.concat_ws(":", F.lit("conv"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("role").alias("kind"), F.length("text").alias("size"))
    return d.unionByName(c)


@job("c5_route_ends", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, a.n_name AS origin, b.n_name AS destination FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey + 7) % 25")
def c5(spark, sf):
    n = table(spark, sf, "nation")
    a, b = n.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("x")), n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("y"))
    rows = a.join(b, F.col("b") == (F.col("a") + 7) % 25)
    ends = scalars.route_ends(F.concat_ws(" — ", "x", "y"))
    return rows.select("a", "b", ends["origin"].alias("origin"), ends["destination"].alias("destination"))


@job("c6_service_dates", f"WITH {EV} SELECT event_id, service_date AS utc_day, strftime(occurred_at + INTERVAL 2 HOUR, '%Y-%m-%d') AS local_day FROM ev")
def c6(spark, sf):
    return ev(spark, sf).select("event_id", F.col("service_date").alias("utc_day"), F.date_format(F.from_utc_timestamp("occurred_at", "Europe/Kyiv"), "yyyy-MM-dd").alias("local_day"))


@job("c8_service_keys", f"WITH {EV} SELECT event_id, concat_ws('|', train::VARCHAR, service_date, station) AS service_key FROM ev")
def c8(spark, sf):
    return ev(spark, sf).select("event_id", F.concat_ws("|", F.col("train").cast("string"), "service_date", "station").alias("service_key"))


@job("c9_event_fingerprint", f"WITH {EV} SELECT event_id, substr(sha256(run_id || '|' || station || '|' || delay_min), 1, 16) AS fingerprint FROM ev")
def c9(spark, sf):
    return ev(spark, sf).select("event_id", F.substring(F.sha2(F.concat_ws("|", "run_id", "station", F.col("delay_min").cast("string")), 256), 1, 16).alias("fingerprint"))


@job("c15_token_overlap", "WITH p AS (SELECT p_partkey, p_name, p_type, list_distinct(string_split(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-')) AS a, list_distinct(string_split(regexp_replace(lower(p_type || ' ' || split_part(p_name, ' ', 1)), '[^a-z0-9]+', '-', 'g'), '-')) AS b FROM part) SELECT p_partkey, round(len(list_intersect(a, b)) / greatest(1, least(len(a), len(b)))::DOUBLE, 4) AS overlap FROM p")
def c15(spark, sf):
    other = F.concat_ws(" ", "p_type", F.split_part("p_name", F.lit(" "), F.lit(1)))
    return table(spark, sf, "part").select("p_partkey", F.round(scalars.token_overlap("p_name", other), 4).alias("overlap"))


@job("c16_json_fields", f"WITH {EV} SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS other FROM ev")
def c16(spark, sf):
    return ev(spark, sf).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("other"))


@job("c19_reliability_map", f"WITH {EV} SELECT event_id, (CASE authority WHEN 'official' THEN 1.0 WHEN 'operator' THEN 0.97 WHEN 'reference' THEN 0.72 ELSE 0.62 END)::DOUBLE AS weight FROM ev")
def c19(spark, sf):
    return ev(spark, sf).select("event_id", scalars.authority_weight("authority").alias("weight"))


@job("c22_public_status", f"WITH {EV} SELECT event_id, CASE WHEN station IN ('error') THEN 'unknown' ELSE 'reported' END AS status FROM ev")
def c22(spark, sf):
    return ev(spark, sf).select("event_id", F.when(F.col("station").isin("error"), "unknown").otherwise("reported").alias("status"))


C23_TEXT = "stands|delayed indefinitely"


@job("c23_disruption", f"""WITH {EV}, c AS (SELECT event_id, delay_min, ['moving', 'held', 'Dwelling ', 'x'][(event_id % 4 + 1)::INTEGER] AS operational, CASE WHEN event_id % 9 = 0 THEN 'train STANDS at signal' ELSE station END AS text, (event_id * 13 % 400)::DOUBLE AS age FROM ev),
h AS (SELECT *, lower(trim(operational)) IN ('held', 'hold', 'stopped', 'suspended', 'station', 'at-station', 'dwelling', 'waiting', 'depot') OR regexp_matches(lower(text), '{C23_TEXT}') AS held FROM c)
SELECT event_id, CASE WHEN held THEN 'held' WHEN delay_min > 0 THEN 'delayed' ELSE 'normal' END AS state, round(CASE WHEN held THEN greatest(0.45, exp(-age / 240)) WHEN delay_min > 0 THEN 0.7 ELSE 1 END, 6) AS confidence,
  concat_ws(',', CASE WHEN held THEN 'explicit-operational-hold' END, CASE WHEN delay_min >= 60 THEN 'material-delay' END) AS reasons FROM h""")
def c23(spark, sf):
    operational = F.element_at(F.array(*map(F.lit, ("moving", "held", "Dwelling ", "x"))), (F.col("event_id") % 4 + 1).cast("int"))
    text = F.when(F.col("event_id") % 9 == 0, "train STANDS at signal").otherwise(F.col("station"))
    found = scalars.disruption(operational, text, "delay_min", (F.col("event_id") * 13 % 400).cast("double"), C23_TEXT)
    return ev(spark, sf).select("event_id", found.alias("d")).select("event_id", "d.state", "d.confidence", F.array_join("d.reasons", ",").alias("reasons"))


@job("c26_brand_canonical", "SELECT p_partkey, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'first' WHEN p_brand = 'Brand#3' THEN '' ELSE lower(replace(p_brand, '#', '-')) END AS brand FROM part")
def c26(spark, sf):
    known = spark.createDataFrame([("Brand#1", "first"), ("Brand#2", "first"), ("Brand#3", "")], "p_brand string, canonical string")
    return table(spark, sf, "part").join(F.broadcast(known), "p_brand", "left").select("p_partkey", F.coalesce("canonical", scalars.slug("p_brand")).alias("brand"))


@job("f14_alternatives", f"WITH {EV}, c AS (SELECT train, station, count(*) AS n FROM ev GROUP BY ALL) SELECT train, station, row_number() OVER w AS place, n - lead(n) OVER w AS gap FROM c WINDOW w AS (PARTITION BY train ORDER BY n DESC, station)")
def f14(spark, sf):
    w = Window.partitionBy("train").orderBy(F.desc("n"), "station")
    counts = ev(spark, sf).groupBy("train", "station").agg(F.count("*").alias("n"))
    return counts.select("train", "station", F.row_number().over(w).alias("place"), (F.col("n") - F.lead("n").over(w)).alias("gap"))


@job("f8_entropy", f"WITH {EV}, c AS (SELECT train, station, count(*) AS n FROM ev GROUP BY ALL), p AS (SELECT train, n / sum(n) OVER (PARTITION BY train) AS p, count(*) OVER (PARTITION BY train) AS k FROM c) SELECT train, round(CASE WHEN max(k) > 1 THEN -sum(p * ln(p)) / ln(max(k)) ELSE 0 END, 6) AS entropy FROM p GROUP BY train")
def f8(spark, sf):
    counts = ev(spark, sf).groupBy("train", "station").agg(F.count("*").alias("n"))
    w = Window.partitionBy("train")
    p = counts.withColumn("p", F.col("n") / F.sum("n").over(w)).withColumn("k", F.count("*").over(w))
    return p.groupBy("train").agg(F.round(F.when(F.max("k") > 1, -F.sum(F.col("p") * F.log("p")) / F.log(F.max("k"))).otherwise(0.0), 6).alias("entropy"))


@job("m20_alert_rows", f"""WITH {EV}, al AS (SELECT event_id, unnest(list_filter([CASE WHEN station = 'error' THEN 'hold:' || run_id || ':' || station END, CASE WHEN delay_min >= 30 THEN 'delay:' || run_id || ':' || (delay_min // 30) END], lambda x: x IS NOT NULL)) AS alert_key, delay_min FROM ev),
net AS (SELECT 'network:' || station || ':' || service_date AS alert_key, min(event_id) AS event_id, max(delay_min)::BIGINT AS delay FROM ev WHERE delay_min >= 60 GROUP BY station, service_date HAVING count(DISTINCT run_id) >= 3)
SELECT alert_key, min(event_id) AS event_id, max(delay_min)::BIGINT AS delay FROM al GROUP BY alert_key UNION ALL SELECT * FROM net""")
def m20(spark, sf):
    return coverage.alert_rows(ev(spark, sf).withColumn("held", F.col("station") == "error"))


@job("m18_probability_history", f"WITH {EV} SELECT run_id || ':' || strftime(occurred_at, '%Y-%m-%dT%H:%M') || ':' || station AS sample_id, round(max(reliability), 4) AS probability FROM ev GROUP BY 1")
def m18(spark, sf):
    sample = F.concat_ws(":", "run_id", F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm"), "station")
    return ev(spark, sf).groupBy(sample.alias("sample_id")).agg(F.round(F.max("reliability"), 4).alias("probability"))


@job("m19_movement_rows", f"WITH {EV}, l AS (SELECT * FROM ev WHERE occurred_at <= {TS} QUALIFY row_number() OVER (PARTITION BY train ORDER BY occurred_at DESC, event_id DESC) = 1), a AS (SELECT *, (epoch_us({TS}) - epoch_us(occurred_at)) / 60e6 AS age FROM l) SELECT train, station, round(reliability * exp(-age / 150), 6) AS confidence, CASE WHEN age > 180 THEN 'unknown' WHEN age > 90 THEN 'stale' ELSE 'estimated' END AS position FROM a")
def m19(spark, sf):
    last = ledger.latest(ev(spark, sf).where(F.col("occurred_at") <= _at(NOON)), ["train"], "occurred_at", "event_id")
    age = (F.unix_micros(_at(NOON)) - F.unix_micros("occurred_at")) / F.lit(60e6)
    return last.select("train", "station", F.round(F.col("reliability") * F.exp(-age / 150), 6).alias("confidence"), F.when(age > 180, "unknown").when(age > 90, "stale").otherwise("estimated").alias("position"))


@job("s9_heartbeat_failures", f"""WITH {EV}, r AS (SELECT *, sum((station <> 'error')::INTEGER) OVER (PARTITION BY source_id ORDER BY occurred_at, event_id ROWS UNBOUNDED PRECEDING) AS round FROM ev) SELECT event_id, (sum((station = 'error')::INTEGER) OVER (PARTITION BY source_id, round ORDER BY occurred_at, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS failures FROM r""")
def s9(spark, sf):
    from ledgerline.streaming.jobs import heartbeat

    return heartbeat(ev(spark, sf).withColumn("ok", F.col("station") != "error")).select("event_id", "failures")


@job("g20_rebuild_queue", f"WITH {G_EDGES}, d AS (SELECT src, count(*) AS n, max(km) AS far FROM g_edges GROUP BY src) SELECT src, n, far FROM d ORDER BY far DESC, n DESC, src LIMIT 24")
def g20(spark, sf):
    return g_edges(spark, sf).groupBy("src").agg(F.count("*").alias("n"), F.max("km").alias("far")).orderBy(F.desc("far"), F.desc("n"), "src").limit(24)


@job("g24_credible_routes", f"WITH {PTS}, e AS (SELECT l.id, 2 * 6371.0088 * asin(sqrt(pow(sin(radians(r.lat - l.lat) / 2), 2) + cos(radians(l.lat)) * cos(radians(r.lat)) * pow(sin(radians(r.lon - l.lon) / 2), 2))) AS direct FROM lpts l JOIN rpts r ON r.id = l.id) SELECT id, direct * (1 + id % 10 / 10.0::DOUBLE) + 30 <= greatest(1.8 * direct, direct + 40) AS credible FROM e")
def g24(spark, sf):
    left, right = pts(spark, sf)
    d = scalars.haversine_km("l.lat", "l.lon", "r.lat", "r.lon")
    rows = left.alias("l").join(right.alias("r"), "id").select("id", d.alias("direct"))
    return rows.select("id", (F.col("direct") * (1 + F.col("id") % 10 / 10) + 30 <= F.greatest(1.8 * F.col("direct"), F.col("direct") + 40)).alias("credible"))


@job("g16_path_checks")
def g16(spark, sf):
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("node"))
    reached = graph.shortest(nodes.where("node % 50 = 0"), graph.undirected(g_edges(spark, sf)), 5, 100.0)
    paths = graph.walk_back(reached, reached.where("hops >= 2").select("source", "node"), 6)
    return graph.path_quality(paths, F.col("node") - 1).select("source", "node", "steps", "repeats", "via")


@job("s11_cycle_watchdog", f"""WITH {EV}, lg AS (SELECT event_id // 4 AS cycle_id, CASE WHEN event_id % 4 = 0 THEN 'started' WHEN event_id % 4 = 3 AND reliability > 0.3 THEN 'finished' END AS phase, occurred_at AS t_at FROM ev), cy AS (SELECT cycle_id, min(t_at) FILTER (phase = 'started') AS began, max(t_at) FILTER (phase = 'finished') AS ended FROM lg GROUP BY cycle_id),
mi AS (SELECT *, (epoch_us(coalesce(ended, {TS})) - epoch_us(began)) / 60e6 AS m FROM cy WHERE began IS NOT NULL) SELECT cycle_id, CASE WHEN ended IS NOT NULL THEN 'completed' WHEN m > 20 THEN 'failed' ELSE 'running' END AS status, round(m, 3) AS minutes FROM mi""")
def s11(spark, sf):
    from ledgerline.streaming.jobs import cycle_states

    phase = F.when(F.col("event_id") % 4 == 0, "started").when((F.col("event_id") % 4 == 3) & (F.col("reliability") > 0.3), "finished")
    log = ev(spark, sf).select(F.expr("event_id div 4").alias("cycle_id"), phase.alias("phase"), F.col("occurred_at").alias("at"))
    return cycle_states(log, _at(NOON))
