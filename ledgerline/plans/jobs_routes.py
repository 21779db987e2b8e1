"""Registered queries: names, itineraries, compiled routes, positions along routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import scalars
from ledgerline.operators import coverage, itineraries, places, positions, routes
from ledgerline.plans.proxy import EV, G_EDGES, KM_SQL, PTS, ev, g_edges, pts, table
from ledgerline.plans.registry import job

NOON = "2024-01-15 12:00:00"


def _at(text: str):
    return F.lit(text).cast("timestamp")


#: A name as its key and its variants, in SQL.
KEY_SQL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[’''`]', 'ʼ', 'g'), '(^|[^\p{{L}}\p{{N}}])(" + "|".join(scalars.STATION_WORDS) + r")($|[^\p{{L}}\p{{N}}])', ' ', 'g'), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '^-|-$', '', 'g')"
VARIANTS_SQL = "list_distinct(list_filter([{k}, CASE WHEN length(regexp_replace({k}, '-(" + "|".join(scalars.PASSENGER_ENDINGS) + ")$', '')) >= 3 THEN regexp_replace({k}, '-(" + "|".join(scalars.PASSENGER_ENDINGS) + r")$', '') END, CASE WHEN {k} LIKE '%-" + scalars.SHORT_ENDING + r"' THEN regexp_replace({k}, '" + scalars.SHORT_ENDING + "$', '" + scalars.FULL_ENDING + r"') END, regexp_replace({k}, '-([0-9]+)$', '\1')], lambda v: coalesce(v, '') <> ''))"
STATION_NAMES = "CASE s_suppkey % 5 WHEN 0 THEN 'Station ' || s_name WHEN 1 THEN s_name || '-пас' WHEN 2 THEN s_name || ' Головний' WHEN 3 THEN 'Вокзал ' || replace(s_name, '#', ' # ') ELSE upper(s_name) END"


def _station_names(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("station_id"), F.expr(STATION_NAMES).alias("name"))


@job("c2_alias_variants", f"WITH n AS (SELECT s_suppkey AS station_id, {STATION_NAMES} AS name FROM supplier), k AS (SELECT station_id, {KEY_SQL.format(x='name')} AS k FROM n) SELECT station_id, k AS alias_key, array_to_string(list_sort({VARIANTS_SQL.format(k='k')}), ',') AS variants FROM k")
def c2(spark, sf):
    return _station_names(spark, sf).select("station_id", scalars.alias_key("name").alias("alias_key"), F.array_join(F.array_sort(scalars.alias_variants("name")), ",").alias("variants"))


SOURCE_NAMES = ("UZ public board", "AnyTrain UZ", "station-edge/7", "tg-rail", "rail telegram 5", "Operator hub", "own feed", "")


@job("c27_source_domains", f"""WITH {EV}, s AS (SELECT event_id, {list(SOURCE_NAMES)}[(event_id % 8 + 1)::INTEGER] AS source FROM ev), k AS (SELECT event_id, regexp_replace(regexp_replace(lower(source), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-|-$', '') AS k FROM s)
SELECT event_id, CASE {' '.join(f"WHEN regexp_matches(k, '{part}') THEN '{domain}'" for part, domain in scalars.SOURCE_DOMAINS)} WHEN k <> '' THEN k ELSE 'unknown' END AS domain FROM k""")
def c27(spark, sf):
    source = F.element_at(F.array(*map(F.lit, SOURCE_NAMES)), (F.col("event_id") % 8 + 1).cast("int"))
    return ev(spark, sf).select("event_id", scalars.source_domain(source).alias("domain"))


@job("c9_fnv_event_id")
def c9_fnv(spark, sf):
    return ev(spark, sf).select("event_id", F.concat(F.lit("evt_"), scalars.fnv1a(F.concat_ws("|", "run_id", "station", F.col("delay_min").cast("string"), "source_id"))).alias("ledger_id"))


@job("g9_station_registry", f"""WITH {PTS}, rv AS (SELECT r.id AS station_id, {STATION_NAMES} AS name, lat, lon FROM rpts r JOIN supplier ON s_suppkey = r.id), fo AS (SELECT l.id AS element_id, CASE WHEN l.id % 10 = 0 THEN (SELECT min(s_name) FROM supplier WHERE s_suppkey = l.id // 10) WHEN l.id % 10 = 1 THEN '' ELSE l.name END AS name, lat, lon FROM lpts l),
rk AS (SELECT station_id, {KEY_SQL.format(x='name')} AS k FROM rv), fk AS (SELECT element_id, {KEY_SQL.format(x="coalesce(name, '')")} AS k FROM fo), ro AS (SELECT DISTINCT station_id, unnest({VARIANTS_SQL.format(k='k')}) AS v FROM rk), fv AS (SELECT element_id, unnest({VARIANTS_SQL.format(k='k')}) AS v FROM fk),
hit AS (SELECT element_id, min(station_id) AS by_name FROM fv JOIN ro USING (v) GROUP BY element_id HAVING count(DISTINCT station_id) = 1),
nr AS (SELECT element_id, min(station_id) AS by_place, min(km) AS km FROM (SELECT element_id, station_id, {KM_SQL.format(lat1='f.lat', lon1='f.lon', lat2='r.lat', lon2='r.lon')} AS km FROM fo f JOIN rv r ON abs(f.lat - r.lat) < 0.05 AND abs(f.lon - r.lon) < 0.05) WHERE km <= 0.75 GROUP BY element_id HAVING count(*) = 1)
SELECT element_id, coalesce(by_name, by_place) AS station_id, CASE WHEN by_name IS NOT NULL THEN 'name' WHEN by_place IS NOT NULL THEN 'proximity' ELSE 'new' END AS method, round(CASE WHEN by_name IS NOT NULL THEN 0.99 WHEN by_place IS NOT NULL THEN greatest(0.85, 1 - km / 5) ELSE 0.9 END, 4) AS confidence FROM fo LEFT JOIN hit USING (element_id) LEFT JOIN nr USING (element_id)""")
def g9(spark, sf):
    left, right = pts(spark, sf)
    names = table(spark, sf, "supplier").select((F.col("s_suppkey") * 10).alias("element"), F.col("s_name").alias("listed"))
    found = left.join(names, left.id == names.element, "left").select(F.col("id").alias("element_id"), F.when(F.col("id") % 10 == 0, F.col("listed")).when(F.col("id") % 10 == 1, "").otherwise(F.col("name")).alias("name"), "lat", "lon")
    reviewed = _station_names(spark, sf).join(right.select(F.col("id").alias("station_id"), "lat", "lon"), "station_id")
    return places.station_registry(reviewed, reviewed.select("station_id", "name").limit(0), found)


@job("g23_alias_resolution")
def g23(spark, sf):
    """Travellers' lists of names: some listed, some one letter off, some shared by several stations."""
    left, right = pts(spark, sf)
    shared = F.concat(F.lit("Kreuz"), F.expr("translate(cast(id % 40 as string), '0123456789', 'abcdefghij')"), F.lit("berg"))
    stations = right.select(F.col("id").alias("station_id"), shared.alias("name"), "lat", "lon")
    aliases = right.where("id % 3 = 0").select(scalars.alias_key("name").alias("alias_key"), F.col("id").alias("station_id"), F.lit(1.0).alias("confidence"))
    number = F.col("id") % 1000 + 1
    listed = F.concat(F.lit("Supplier#"), F.lpad((number - number % 3 + 3).cast("string"), 9, "0"))
    asked = F.when(F.col("id") % 3 == 0, shared).when(F.col("id") % 3 == 1, F.concat(shared, F.lit("g"))).otherwise(listed)
    names = left.select(F.expr("id div 6").alias("request_id"), F.col("id").alias("pos"), asked.alias("name"))
    return routes.resolve_aliases(names, aliases, stations)


@job("g22_verified_itinerary", f"""WITH {EV}, c AS (SELECT train, list(station ORDER BY occurred_at, event_id) AS calls, list(station ORDER BY event_id DESC) AS listed, arg_min(station, (occurred_at, event_id)) AS origin, arg_max(station, (occurred_at, event_id)) AS destination FROM ev GROUP BY train),
u AS (SELECT train, origin, destination, list_filter(calls, lambda x, i: list_position(calls, x) = i) AS calls, list_filter(listed, lambda x, i: list_position(listed, x) = i) AS listed FROM c WHERE origin <> destination),
p AS (SELECT *, list_position(calls, origin) AS a1, list_position(calls, destination) AS b1, list_position(listed, origin) AS a2, list_position(listed, destination) AS b2 FROM u),
o AS (SELECT train, CASE WHEN a1 < b1 THEN calls[a1:b1] ELSE list_reverse(calls[b1:a1]) END AS s1, CASE WHEN a2 < b2 THEN listed[a2:b2] ELSE list_reverse(listed[b2:a2]) END AS s2 FROM p),
k AS (SELECT train, CASE WHEN len(s1) >= 3 AND len(s1) >= coalesce(CASE WHEN len(s2) >= 3 THEN len(s2) END, 0) THEN s1 WHEN len(s2) >= 3 THEN s2 END AS s, len(s1) >= 3 AND len(s1) >= coalesce(CASE WHEN len(s2) >= 3 THEN len(s2) END, 0) AS by_calls FROM o)
SELECT train, CASE WHEN s IS NULL THEN 'unverified' WHEN len(s) >= 4 THEN 'verified' ELSE 'constrained' END AS status, CASE WHEN s IS NULL THEN NULL WHEN by_calls THEN 'station_calls' ELSE 'ordered_schedule' END AS itinerary_source, coalesce(array_to_string(s, '>'), '') AS stations FROM k""")
def g22(spark, sf):
    e = ev(spark, sf)
    lists = {"calls": F.array_sort(F.collect_list(F.struct("occurred_at", "event_id", "station"))), "listed": F.sort_array(F.collect_list(F.struct("event_id", "station")), asc=False)}
    rows = e.groupBy("train").agg(*[v.alias(k) for k, v in lists.items()], F.min_by("station", F.struct("occurred_at", "event_id")).alias("origin"), F.max_by("station", F.struct("occurred_at", "event_id")).alias("destination"))
    rows = rows.withColumns({c: F.transform(c, lambda x: x["station"]) for c in lists}).withColumns({"canonical": F.lit(None).cast("array<string>"), "scheduled": F.lit(True)}).where("origin <> destination")
    return routes.verified_itinerary(rows).select("train", "status", "itinerary_source", F.array_join("stations", ">").alias("stations"))


def _tracks(spark, sf):
    """Directed edges with kinds of track, one a pair of nodes."""
    one = g_edges(spark, sf)
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "km")).groupBy("src", "dst").agg(F.min("km").alias("km"))
    pair = F.col("src") + F.col("dst")
    rows = both.withColumns({
        "service": F.when(pair % 11 == 0, "yard").when(pair % 7 == 0, "siding").when(pair % 13 == 0, "crossover"), "share": F.when(pair % 3 == 0, 0.4), "usage": F.when(pair % 17 == 0, "branch"), "railway": F.when(pair % 29 == 0, "abandoned").otherwise("rail"),
        "relations": F.when(pair % 2 == 1, F.array(F.concat(F.lit("r"), (F.least("src", "dst") % 40 / 8).cast("int").cast("string")))).otherwise(F.expr("cast(array() as array<string>)")),
    })
    return routes.edge_cost(rows)


def _wanted(spark, sf):
    """Every node whose id is divisible by 50 asks for a route over two more stops."""
    node = F.col("p_partkey")
    return table(spark, sf, "part").where("p_partkey % 50 = 0").select(node.alias("route_id"), F.array(node, node + 4, node + 9).alias("stops"))


@job("g13_waypoint_routes")
def g13(spark, sf):
    return routes.through_waypoints(_wanted(spark, sf), _tracks(spark, sf), 12, 300).select("route_id", F.concat_ws(">", "path").alias("path"), "cost", "km")


@job("g14_leg_alternatives")
def g14(spark, sf):
    out = routes.leg_alternatives(routes.legs_of(_wanted(spark, sf)), _tracks(spark, sf), 3, 12, 300)
    return out.select("start", "goal", "choice", F.concat_ws(">", "path").alias("path"), F.round("cost", 6).alias("cost"))


def _compiled(spark, sf):
    return routes.validated(routes.beam_routes(_wanted(spark, sf), _tracks(spark, sf), 3, 3, 12, 300), _wanted(spark, sf))


@job("g15_beam_routes")
def g15(spark, sf):
    return routes.beam_routes(_wanted(spark, sf), _tracks(spark, sf), 3, 3, 12, 300).select("route_id", F.concat_ws(">", "path").alias("path"), F.round("cost", 6).alias("cost"), F.round("penalty", 6).alias("penalty"))


@job("g16_route_validation")
def g16(spark, sf):
    return _compiled(spark, sf).select("route_id", F.concat_ws(">", "path").alias("path"), "valid", "reason", "reversals", "service_share")


@job("g17_ranked_candidates")
def g17(spark, sf):
    return routes.ranked(_compiled(spark, sf)).select("route_id", "place", F.concat_ws(">", "path").alias("path"), "score", "ambiguity", "confidence")


@job("g18_route_geometry", f"""WITH {G_EDGES}, sg AS (SELECT src, dst, min(km) AS km FROM g_edges WHERE dst = src + 1 GROUP BY ALL), rt AS (SELECT p_partkey AS route_id FROM part, g_top WHERE p_partkey % 97 BETWEEN 1 AND 93 AND p_partkey + 3 <= n),
st AS (SELECT route_id, i, src, km FROM rt, range(3) t(i) JOIN sg ON src = route_id + i) SELECT route_id, count(*) * 2 + 1 AS points, sum(2 * src + 0.5)::DOUBLE + min(src) + 3 AS checksum, round(min(1 - km / 100), 3) AS quality FROM st GROUP BY route_id HAVING count(*) = 3""")
def g18(spark, sf):
    """Paths of four nodes in a row; each segment has a bend half way."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("route_id"))
    top = p.agg(F.max("route_id").alias("n"))
    paths = p.crossJoin(F.broadcast(top)).where("route_id % 97 BETWEEN 1 AND 93 AND route_id + 3 <= n").select("route_id", F.sequence("route_id", F.col("route_id") + 3).alias("path"))
    point = lambda x: F.struct(x.cast("double").alias("lat"), (x * 0.5).cast("double").alias("lon"))
    segments = g_edges(spark, sf).where("dst = src + 1").groupBy("src", "dst").agg((1 - F.min("km") / 100).alias("quality")).withColumn("points", F.array(point(F.col("src")), point(F.col("src") + 0.5), point(F.col("dst"))))
    out = routes.compose_geometry(paths, segments)
    total = F.aggregate(F.transform("points", lambda x: x["lat"]), F.lit(0.0), lambda a, x: a + x)
    return out.select("route_id", F.size("points").cast("long").alias("points"), total.alias("checksum"), "quality")


@job("g19_cache_plan", f"""WITH {EV}, rq AS (SELECT event_id AS request_id, train AS src, (train * 7 + delay_min) % 50 AS dst, 'c' || (delay_min % 3) AS context FROM ev), ak AS (SELECT src, dst, context, min(request_id) AS request_id FROM rq WHERE src <> dst GROUP BY ALL),
ca AS (SELECT src, dst, context, CASE WHEN (src + dst) % 5 = 0 THEN 'no_path' ELSE 'ready' END AS status, TIMESTAMP '{NOON}' - to_minutes((src * 11 + dst) % 900) AS calculated_at FROM (SELECT DISTINCT src, dst, context FROM rq WHERE (src + dst) % 2 = 0)),
jn AS (SELECT ak.*, ca.status AS cached FROM ak LEFT JOIN ca ON ak.src = ca.src AND ak.dst = ca.dst AND ak.context = ca.context AND NOT (ca.status = 'no_path' AND (epoch_us(TIMESTAMP '{NOON}') - epoch_us(calculated_at)) / 60e6 > 360)),
nw AS (SELECT request_id FROM jn WHERE cached IS NULL ORDER BY request_id LIMIT 12) SELECT jn.request_id, src, dst, CASE WHEN cached IS NOT NULL THEN 'reuse' WHEN nw.request_id IS NOT NULL THEN 'compute' ELSE 'wait' END AS action FROM jn LEFT JOIN nw USING (request_id)""")
def g19(spark, sf):
    asked = ev(spark, sf).select(F.col("event_id").alias("request_id"), F.col("train").alias("src"), ((F.col("train") * 7 + F.col("delay_min")) % 50).alias("dst"), F.concat(F.lit("c"), (F.col("delay_min") % 3).cast("string")).alias("context"))
    cache = asked.select("src", "dst", "context").distinct().where("(src + dst) % 2 = 0").withColumns({
        "context_hash": routes.context_hash("context"), "status": F.when((F.col("src") + F.col("dst")) % 5 == 0, "no_path").otherwise("ready"), "calculated_at": F.timestamp_micros(F.unix_micros(_at(NOON)) - (F.col("src") * 11 + F.col("dst")) % 900 * 60_000_000),
    })
    return routes.cache_plan(asked, cache, _at(NOON)).select("request_id", "src", "dst", "action")


THEN = "1995-06-17 10:00:00"
SCHED = f"""sc AS (SELECT l_orderkey AS run_id, l_linenumber AS event_id, TIMESTAMP '1995-06-17' + to_minutes((l_partkey * 7 + l_linenumber * 131) % 1200) AS t_at, l_linenumber * 40.0::DOUBLE AS km, CASE l_returnflag WHEN 'A' THEN 'confirmed' WHEN 'R' THEN 'reported' ELSE 'planned' END AS status, (l_quantity % 30)::INTEGER AS delay FROM lineitem),
rn AS (SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 3 <> 0 THEN 0.5 + o_orderkey % 5 / 10.0::DOUBLE END AS geometry_quality, CASE WHEN o_orderkey % 4 = 0 THEN TIMESTAMP '1995-06-17 02:00:00' END AS confirmed_at, TIMESTAMP '{THEN}' AS now FROM orders)"""


@job("m2_schedule_position", f"""WITH {SCHED}, j AS (SELECT sc.*, now FROM sc JOIN rn USING (run_id)), en AS (SELECT run_id, max(row(t_at, event_id, km, status, delay)) FILTER (t_at <= now) AS p, min(row(t_at, event_id, km, status, delay)) FILTER (t_at > now) AS n, count(*) AS events, max(t_at) FILTER (t_at <= now AND status = 'confirmed') AS cf FROM j GROUP BY run_id),
e AS (SELECT rn.run_id, rn.now, geometry_quality, coalesce(cf, confirmed_at) AS last_at, events, p[1] AS pa, p[2] AS pe, p[3] AS pk, p[4] AS ps, p[5] AS pd, n[1] AS na, n[2] AS ne, n[3] AS nk, n[4] AS ns, n[5] AS nd FROM rn LEFT JOIN en USING (run_id)),
c AS (SELECT *, greatest((epoch_us(na) - epoch_us(pa)) / 3.6e9, 1 / 3.6e6) AS gap, coalesce(greatest(0.0, (epoch_us(now) - epoch_us(last_at)) / 3.6e9), 8.0) AS age, greatest(abs(coalesce(pd, 0)), abs(coalesce(nd, 0))) AS dl, coalesce(events >= 2, false) AS known, pa IS NOT NULL AND na IS NOT NULL AS two, coalesce(pa, na) AS oa, coalesce(ps, ns) AS os, coalesce(pk, nk) AS ok FROM e),
f AS (SELECT *, least(1.0, greatest(0.0, ((epoch_us(now) - epoch_us(pa)) / 3.6e9) / gap)) AS progress, least(0.97, greatest(0.08, CASE ps WHEN 'confirmed' THEN 0.96 WHEN 'reported' THEN 0.84 ELSE 0.7 END * 0.55 + coalesce(geometry_quality, 0.9) * 0.35 + 0.1 - least(0.27, gap * 0.07) - least(0.25, age * 0.035) - least(0.14, dl / 300.0::DOUBLE))) AS conf,
  CASE WHEN known AND two THEN 'estimated' WHEN known AND abs((epoch_us(now) - epoch_us(oa)) / 3.6e9) * 60 <= 12 THEN CASE WHEN os = 'reported' THEN 'reported' ELSE 'stale' END ELSE 'unknown' END AS status FROM c)
SELECT run_id, status, round(CASE WHEN status = 'estimated' THEN pk + (nk - pk) * progress WHEN status <> 'unknown' THEN ok END, 3) AS km, round(CASE WHEN status = 'estimated' THEN conf WHEN status = 'reported' THEN 0.72 WHEN status = 'stale' THEN 0.32 ELSE 0.0 END + 1e-9, 2) AS confidence,
  CASE WHEN status = 'estimated' THEN round(progress + 1e-9, 3) END AS progress, CASE WHEN status = 'estimated' THEN pe END AS from_event_id, CASE WHEN status = 'estimated' THEN ne END AS to_event_id, epoch_us(CASE WHEN status = 'estimated' THEN last_at WHEN status <> 'unknown' AND os = 'confirmed' THEN oa END) AS last_confirmed_at FROM f""")
def m2(spark, sf):
    line = table(spark, sf, "lineitem")
    at = F.timestamp_micros(F.unix_micros(_at("1995-06-17 00:00:00")) + (F.col("l_partkey") * 7 + F.col("l_linenumber") * 131) % 1200 * 60_000_000)
    status = F.when(F.col("l_returnflag") == "A", "confirmed").when(F.col("l_returnflag") == "R", "reported").otherwise("planned")
    schedule = line.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("event_id"), at.alias("at"), (F.col("l_linenumber") * 40.0).alias("km"), status.alias("status"), (F.col("l_quantity") % 30).cast("int").alias("delay"))
    key = F.col("o_orderkey")
    runs = table(spark, sf, "orders").select(key.alias("run_id"), F.when(key % 3 != 0, 0.5 + key % 5 / 10).alias("geometry_quality"), F.when(key % 4 == 0, _at("1995-06-17 02:00:00")).alias("confirmed_at"))
    out = positions.schedule_position(schedule, runs, _at(THEN))
    return out.select("run_id", "status", F.round("km", 3).alias("km"), "confidence", "progress", "from_event_id", "to_event_id", F.unix_micros("last_confirmed_at").alias("last_confirmed_at"))


UPD = f"""{EV}, up AS (SELECT event_id, run_id, train, occurred_at AS updated_at, occurred_at + to_minutes(30 + event_id % 700) AS arrival_at, 100.0::DOUBLE + train * 37 % 1100 AS route_km, reliability, (event_id % 160)::DOUBLE AS anchor_error_km, event_id % 3 = 0 AS provisional, event_id % 7 <> 0 AS moving FROM ev)"""
FACTOR = "CASE WHEN age <= 30 THEN 1.0 WHEN age <= 60 THEN greatest(0.8, 1 - (age - 30) / 150) WHEN age <= 90 THEN greatest(0.5, 0.8 - (age - 60) / 100) WHEN age <= 180 THEN greatest(0.3, 0.5 - (age - 90) / 450) ELSE 0.0 END"
FORECAST = f"""ag AS (SELECT *, greatest(0.0, (epoch_us(now) - epoch_us(updated_at)) / 3.6e9 * 60) AS age FROM src WHERE moving), fp AS (SELECT *, age > 90 AS frozen, greatest(0.0, (epoch_us(arrival_at) - (epoch_us(updated_at) + least(age, 90.0) * 60000000)) / 3.6e9) AS rem, CASE WHEN route_km > 900 THEN 67.0 WHEN route_km > 450 THEN 63.0 ELSE 58.0 END AS kph FROM ag WHERE age <= 180),
fq AS (SELECT *, least(0.975, greatest(0.025, 1 - rem * kph / route_km)) AS pg, round(least(1.0, greatest(0.0, CASE WHEN age <= 20 THEN 1.0 WHEN age <= 45 THEN 0.72 WHEN age <= 120 THEN 0.42 ELSE 0.18 END * 0.3 + greatest(0.48, 1 - least(anchor_error_km, 140.0) / 210) * 0.28 + 0.24 + reliability * 0.18)), 2) AS ql FROM fp),
fc AS (SELECT *, greatest(CASE WHEN provisional THEN CASE WHEN frozen THEN 0.1 ELSE 0.16 END ELSE CASE WHEN frozen THEN 0.16 ELSE 0.24 END END, least(CASE WHEN provisional THEN 0.34 ELSE 0.72 END, ql * 0.78 * ({FACTOR}))) AS cf FROM fq)"""
FORECAST_ROW = "CASE WHEN frozen THEN 'stale' ELSE 'estimated' END AS status, round(route_km * pg, 3) AS km"


def _updates(spark, sf):
    e, k = ev(spark, sf), F.col("event_id")
    return e.select("event_id", "run_id", F.col("occurred_at").alias("updated_at"), F.timestamp_micros(F.unix_micros("occurred_at") + (30 + k % 700) * 60_000_000).alias("arrival_at"), (100.0 + F.col("train") * 37 % 1100).alias("route_km"), "reliability", (k % 160).cast("double").alias("anchor_error_km"), (k % 3 == 0).alias("provisional"), (k % 7 != 0).alias("moving"))


@job("m3_forecast_position", f"""WITH {UPD}, src AS (SELECT *, TIMESTAMP '{NOON}' AS now FROM up WHERE updated_at <= TIMESTAMP '{NOON}'), {FORECAST}
SELECT event_id AS run_id, {FORECAST_ROW}, round(cf + 1e-9, 2) AS confidence FROM fc""")
def m3(spark, sf):
    rows = _updates(spark, sf).where(F.col("updated_at") <= _at(NOON)).withColumn("run_id", F.col("event_id"))
    return positions.forecast_position(rows, _at(NOON)).select("run_id", "status", "km", "confidence")


@job("m3_frozen_position", f"""WITH {UPD}, h AS (SELECT event_id AS run_id, route_km, CASE WHEN event_id % 4 <> 0 THEN event_id % 100 / 100.0::DOUBLE END AS progress, CASE WHEN event_id % 4 <> 0 THEN 0.5::DOUBLE END AS confidence, CASE WHEN event_id % 4 <> 0 THEN 12.0::DOUBLE END AS error_km, greatest(0.0, (epoch_us(TIMESTAMP '{NOON}') - epoch_us(updated_at)) / 3.6e9 * 60) AS age FROM up)
SELECT run_id, status, km, round(err + 1e-9, 1) AS error_km FROM (SELECT run_id, CASE WHEN age > 90 THEN 'stale' ELSE 'estimated' END AS status, round(route_km * coalesce(progress, 0.5), 3) AS km, least(300.0, greatest(coalesce(error_km, 25.0), CASE WHEN progress IS NULL THEN route_km * 0.52 ELSE 0.0 END, 25 + age * 0.3))::DOUBLE AS err FROM h)""")
def m3_frozen(spark, sf):
    k = F.col("event_id")
    some = lambda x: F.when(k % 4 != 0, x)
    rows = _updates(spark, sf).select(k.alias("run_id"), "updated_at", "route_km", some(k % 100 / 100).alias("progress"), some(F.lit(0.5)).alias("confidence"), some(F.lit(12.0)).alias("error_km"))
    return positions.frozen_position(rows, _at(NOON)).select("run_id", "status", "km", "error_km")


@job("m22_historical_positions", f"""WITH {UPD}, src AS (SELECT *, event_id AS snapshot_id, TIMESTAMP '{NOON}' AS now, (epoch_us(TIMESTAMP '{NOON}') - epoch_us(updated_at)) / 60e6 > 30 AS timeline_gap FROM up WHERE updated_at <= TIMESTAMP '{NOON}' AND epoch_us(TIMESTAMP '{NOON}') - epoch_us(updated_at) < 6 * 3600000000::BIGINT QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY updated_at DESC, event_id DESC) = 1), {FORECAST}
SELECT s.run_id, s.snapshot_id, s.timeline_gap, coalesce(f.status, 'unknown') AS status, f.km FROM src s LEFT JOIN (SELECT run_id, {FORECAST_ROW} FROM fc) f USING (run_id)""")
def m22(spark, sf):
    rows = _updates(spark, sf).withColumns({"snapshot_id": F.col("event_id"), "captured_at": F.col("updated_at")})
    return positions.historical_positions(rows, _at(NOON)).select("run_id", "snapshot_id", "timeline_gap", "status", "km")


ITINERARIES = f"""{EV}, base AS (SELECT run_id, any_value(train) AS train, any_value(service_date) AS service_date, list(station ORDER BY occurred_at, event_id) AS met, list({{'s': station, 't': epoch_us(occurred_at) - (event_id % 5) * 86400000000::BIGINT}} ORDER BY occurred_at, event_id) FILTER (event_id % 2 = 0) AS calls, list(DISTINCT station ORDER BY station) AS listed,
  arg_min(station, (occurred_at, event_id)) AS first, arg_max(station, (occurred_at, event_id)) AS final, epoch_us(min(occurred_at)) AS departure FROM ev GROUP BY run_id),
runs AS (SELECT *, first AS origin, CASE WHEN train % 5 <> 0 THEN final END AS destination, CASE WHEN train % 3 = 0 THEN met ELSE [] END AS ordered FROM base),
placed AS (SELECT *, list_filter(ordered, lambda x, i: list_position(ordered, x) = i) AS o, list_transform(list_sort(list_transform(coalesce(calls, []), lambda c, i: {{'t': CASE WHEN c.t < departure - 216000000000 THEN c.t + ceil((departure - 216000000000 - c.t) / 86400000000.0)::BIGINT * 86400000000 ELSE c.t END, 'i': i, 's': c.s}})), lambda c: c.s) AS names FROM runs),
lists AS (SELECT *, list_filter(names, lambda x, i: list_position(names, x) = i AND x <> origin AND x IS DISTINCT FROM destination) AS between_them, list_position(o, origin) AS oa, list_position(o, destination) AS ob, list_position(listed, origin) AS la, list_position(listed, destination) AS lb FROM placed),
three AS (SELECT *, CASE WHEN oa > 0 AND ob > 0 AND oa < ob THEN o[oa:ob] WHEN oa > 0 AND ob > 0 AND oa > ob THEN list_reverse(o[ob:oa]) ELSE [] END AS l1, CASE WHEN destination IS NULL OR destination = origin THEN list_concat([origin], between_them) ELSE list_concat([origin], between_them, [destination]) END AS l2,
  CASE WHEN la > 0 AND lb > 0 AND la < lb THEN listed[la:lb] WHEN la > 0 AND lb > 0 AND la > lb THEN list_reverse(listed[lb:la]) ELSE [] END AS l3 FROM lists),
pick AS (SELECT *, CASE WHEN greatest(len(l1), len(l2), len(l3)) < 2 THEN 'endpoints' WHEN len(l1) >= greatest(len(l2), len(l3)) THEN 'ordered_schedule' WHEN len(l2) >= len(l3) THEN 'station_calls' ELSE 'listed_schedule' END AS source FROM three),
chosen AS (SELECT *, CASE source WHEN 'ordered_schedule' THEN l1 WHEN 'station_calls' THEN l2 WHEN 'listed_schedule' THEN l3 WHEN 'endpoints' THEN CASE WHEN destination IS NULL OR destination = origin THEN [origin] ELSE [origin, destination] END END AS stops FROM pick),
graded AS (SELECT *, greatest(0, len(stops) - 2) AS inside, array_to_string(stops, '>') AS way FROM chosen)"""


def _itineraries(spark, sf):
    e = ev(spark, sf)
    call = F.struct("occurred_at", "event_id", "station", F.timestamp_micros(F.unix_micros("occurred_at") - F.col("event_id") % 5 * 86_400_000_000).alias("at"))
    first, final = F.min_by("station", F.struct("occurred_at", "event_id")), F.max_by("station", F.struct("occurred_at", "event_id"))
    runs = e.groupBy("run_id", "train", "service_date").agg(F.sort_array(F.collect_list(call)).alias("met"), F.sort_array(F.collect_set("station")).alias("listed"), first.alias("origin"), final.alias("final"), F.min("occurred_at").alias("departure"))
    some = F.transform(F.filter("met", lambda c: c["event_id"] % 2 == 0), lambda c: F.struct(c["station"].alias("station"), c["at"].alias("at")))
    runs = runs.withColumns({"destination": F.when(F.col("train") % 5 != 0, F.col("final")), "calls": some, "ordered": F.when(F.col("train") % 3 == 0, F.transform("met", lambda c: c["station"]))})
    return itineraries.canonical(runs)


@job("g21_canonical_itinerary", f"""WITH {ITINERARIES} SELECT run_id, source, way, CASE WHEN inside >= 2 THEN 'verified' WHEN inside = 1 THEN 'constrained' ELSE 'probabilistic' END AS status, CASE WHEN inside >= 2 THEN least(0.96, round(0.72::DOUBLE + inside * 0.03, 4)) WHEN inside = 1 THEN 0.58 ELSE 0.3 END AS confidence, origin || '>' || coalesce(destination, 'unknown') AS direction FROM graded""")
def g21_canonical(spark, sf):
    return _itineraries(spark, sf).select("run_id", "source", F.array_join("stops", ">").alias("way"), "status", "confidence", "direction")


@job("g21_itinerary_stops", f"WITH {ITINERARIES} SELECT run_id, i - 1 AS sequence, stops[i] AS station, CASE WHEN i = 1 THEN 'origin' WHEN i = len(stops) THEN 'destination' ELSE 'scheduled' END AS call_type, CASE source WHEN 'ordered_schedule' THEN 0.92 WHEN 'station_calls' THEN 0.78 ELSE 0.45 END AS confidence FROM (SELECT *, unnest(range(1, len(stops) + 1)) AS i FROM graded)")
def g21_stops(spark, sf):
    return itineraries.stops_of(_itineraries(spark, sf)).withColumn("sequence", F.col("sequence").cast("long"))


@job("g21_canonical_versions", f"WITH {ITINERARIES}, c AS (SELECT train, service_date, way, CASE WHEN way = lag(way) OVER w THEN 0 ELSE 1 END AS changed FROM graded WINDOW w AS (PARTITION BY train ORDER BY service_date)) SELECT train, service_date, way, sum(changed) OVER (PARTITION BY train ORDER BY service_date ROWS UNBOUNDED PRECEDING)::BIGINT AS version FROM c")
def g21_versions(spark, sf):
    rows = _itineraries(spark, sf).select("train", "service_date", F.array_join("stops", ">").alias("way"), "itinerary_hash")
    return coverage.versioned(rows, "train", "service_date", F.col("itinerary_hash")).select("train", "service_date", "way", "version")
