"""Registered queries: geometry, graph, places, pages."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.operators import geo, graph, places
from ledgerline.plans.proxy import EV, G_EDGES, KM_SQL, PTS, ev, g_edges, pts, table
from ledgerline.plans.registry import job
from ledgerline.plans.scratch import scratch_root
from ledgerline.sources import pages, versions

KM = KM_SQL.format(lat1="a.lat", lon1="a.lon", lat2="b.lat", lon2="b.lon")
NOON = "2024-01-15 12:00:00"


@job("d7_spatial_self_join", f"WITH {PTS}, j AS (SELECT a.id AS left_id, b.id AS right_id, {KM} AS km FROM lpts a JOIN lpts b ON a.id < b.id AND abs(a.lat - b.lat) < 0.9 AND abs(a.lon - b.lon) < 0.9) SELECT left_id, right_id, round(km, 4) AS km FROM j WHERE km <= 40")
def d7(spark, sf):
    left, _ = pts(spark, sf)
    return geo.near_pairs(left, left, 0.6, 40, same=True).select("left_id", "right_id", F.round("km", 4).alias("km"))


NEAR = f"WITH {PTS}, j AS (SELECT a.id AS left_id, b.id AS right_id, {KM} AS km FROM lpts a JOIN rpts b ON abs(a.lat - b.lat) < 2 AND abs(a.lon - b.lon) < 2)"


@job("d8_nearest_within_radius", f"{NEAR} SELECT left_id, right_id, round(km, 4) AS km, row_number() OVER (PARTITION BY left_id ORDER BY round(km, 6), right_id) AS place FROM j WHERE km <= 60 QUALIFY place <= 3")
def d8(spark, sf):
    left, right = pts(spark, sf)
    return geo.nearest(left, right, 1.0, 60, 3).withColumn("km", F.round("km", 4))


@job("d9_node_snap", f"{NEAR} SELECT left_id, right_id, round(km, 4) AS km FROM j WHERE km <= 60 QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY round(km, 6), right_id) = 1")
def d9(spark, sf):
    left, right = pts(spark, sf)
    return geo.snap(left, right, 15, 60).withColumn("km", F.round("km", 4))


@job("d10_point_in_polygon", f"""WITH {PTS}, poly AS (SELECT n_nationkey AS polygon, 44 + n_nationkey % 5 * 1.6::DOUBLE AS y, 22 + n_nationkey // 5 * 3.2::DOUBLE AS x FROM nation),
hit AS (SELECT id, polygon, lat - y AS v, lon - x AS u FROM lpts JOIN poly ON lat >= y AND lat < y + 1.5 AND lon >= x AND lon < x + 3.0) SELECT id, polygon FROM hit WHERE CASE WHEN polygon % 2 = 0 THEN true ELSE v / 1.5 <= u / 3.0 END""")
def d10(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("polygon"), (44 + F.col("n_nationkey") % 5 * 1.6).alias("y"), (22 + F.floor(F.col("n_nationkey") / 5) * 3.2).alias("x"))
    corner = lambda s, dy, dx: F.struct(F.lit(s).alias("seq"), (F.col("y") + dy).alias("lat"), (F.col("x") + dx).alias("lon"))
    square = F.array(corner(0, 0.0, 0.0), corner(1, 0.0, 3.0), corner(2, 1.5, 3.0), corner(3, 1.5, 0.0))
    triangle = F.array(corner(0, 0.0, 0.0), corner(1, 0.0, 3.0), corner(2, 1.5, 3.0))
    corners = n.select("polygon", F.explode(F.when(F.col("polygon") % 2 == 0, square).otherwise(triangle)).alias("c")).select("polygon", "c.*")
    return geo.inside_polygons(pts(spark, sf)[0].select("id", "lat", "lon"), corners)


@job("c10_haversine", f"WITH {PTS} SELECT a.id, round({KM}, 4) AS km FROM lpts a JOIN rpts b ON b.id = a.id")
def c10(spark, sf):
    from ledgerline.functions.scalars import haversine_km

    left, right = pts(spark, sf)
    return left.alias("a").join(right.alias("b"), "id").select("id", F.round(haversine_km("a.lat", "a.lon", "b.lat", "b.lon"), 4).alias("km"))


@job("e20_map_clusters", f"WITH {PTS} SELECT trunc(lat / 0.5)::INTEGER AS cy, trunc(lon / 0.5)::INTEGER AS cx, count(*) AS places, round(avg(lat), 5) AS lat, round(avg(lon), 5) AS lon FROM lpts GROUP BY 1, 2")
def e20(spark, sf):
    return geo.grid_clusters(pts(spark, sf)[0], 0.5)


LINES = f"{PTS}, line AS (SELECT id // 40 AS route_id, id AS seq, lat, lon FROM lpts), stp AS (SELECT a.*, CASE WHEN lag(lat) OVER w IS NULL THEN 0 ELSE {KM_SQL.format(lat1='lag(lat) OVER w', lon1='lag(lon) OVER w', lat2='lat', lon2='lon')} END AS step FROM line a WINDOW w AS (PARTITION BY route_id ORDER BY seq)), mea AS (SELECT *, sum(step) OVER (PARTITION BY route_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS km_at FROM stp)"


def _lines(spark, sf):
    left, _ = pts(spark, sf)
    return left.select(F.expr("id div 40").alias("route_id"), F.col("id").alias("seq"), "lat", "lon")


@job("g3_route_measure", f"WITH {LINES} SELECT route_id, seq, round(km_at, 3) AS km_at FROM mea")
def g3(spark, sf):
    return geo.measure(_lines(spark, sf)).select("route_id", "seq", F.round("km_at", 3).alias("km_at"))


@job("g4_interpolate", f"""WITH {LINES}, leg AS (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, lead(km_at) OVER w AS km2 FROM mea WINDOW w AS (PARTITION BY route_id ORDER BY seq)), want AS (SELECT route_id, 777.0::DOUBLE + route_id AS km, least(777.0::DOUBLE + route_id, max(km_at)) AS w_at FROM mea GROUP BY route_id),
h AS (SELECT w.route_id, w.km, arg_min({{'lat': lat + (lat2 - lat) * (w_at - km_at) / (km2 - km_at), 'lon': lon + (lon2 - lon) * (w_at - km_at) / (km2 - km_at)}}, seq) AS p FROM want w JOIN leg l ON l.route_id = w.route_id AND w_at >= km_at AND w_at <= km2 GROUP BY ALL)
SELECT route_id, km, round(p.lat, 5) AS lat, round(p.lon, 5) AS lon FROM h""")
def g4(spark, sf):
    m = geo.measure(_lines(spark, sf))
    want = m.select("route_id", (777.0 + F.col("route_id")).alias("km")).distinct()
    return geo.interpolate(m, want).select("route_id", "km", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"))


def _off(y: str, x: str) -> str:
    return KM_SQL.format(lat1="lat", lon1="lon", lat2=y, lon2=x)


@job("g5_project", f"""WITH {LINES}, leg AS (SELECT route_id, seq, lat AS y1, lon AS x1, km_at, lead(lat) OVER w AS y2, lead(lon) OVER w AS x2, lead(km_at) OVER w AS km2 FROM mea WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
j AS (SELECT r.id, r.id // 3 AS route_id, r.lat, r.lon, l.* EXCLUDE (route_id), cos(radians(r.lat)) AS sc FROM rpts r JOIN leg l ON l.route_id = r.id // 3 AND km2 IS NOT NULL),
t AS (SELECT *, greatest(0.0, least(1.0, coalesce(((lon - x1) * sc * (x2 - x1) * sc + (lat - y1) * (y2 - y1)) / nullif((x2 - x1) * sc * (x2 - x1) * sc + (y2 - y1) * (y2 - y1), 0), 0.0))) AS t FROM j),
o AS (SELECT *, {_off('(y1 + (y2 - y1) * t)', '(x1 + (x2 - x1) * t)')} AS off_km, km_at + (km2 - km_at) * t AS along FROM t)
SELECT id, route_id, round(along, 3) AS km_at, round(off_km, 4) AS off_km FROM o QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(off_km, 9), seq) = 1""")
def g5(spark, sf):
    _, right = pts(spark, sf)
    points = right.select("id", "lat", "lon", F.expr("id div 3").alias("route_id"))
    return geo.project(points, geo.measure(_lines(spark, sf))).select("id", "route_id", F.round("km_at", 3).alias("km_at"), F.round("off_km", 4).alias("off_km"))


@job("g7_waypoint_sides", f"WITH {LINES} SELECT route_id, seq, CASE WHEN km_at < 500 THEN 'behind' WHEN km_at > 900 THEN 'ahead' ELSE 'inside' END AS side FROM mea")
def g7(spark, sf):
    return geo.corridor_side(geo.measure(_lines(spark, sf)), F.lit(500.0), F.lit(900.0)).select("route_id", "seq", "side")


@job("g6_route_slice", f"""WITH {LINES}, leg AS (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, lead(km_at) OVER w AS km2 FROM mea WINDOW w AS (PARTITION BY route_id ORDER BY seq)), rt AS (SELECT route_id, max(km_at) AS len FROM mea GROUP BY route_id), want AS (SELECT route_id, k AS km, least(k, len) AS w_at FROM rt, (VALUES (300.0::DOUBLE), (700.0::DOUBLE)) t(k)),
cut AS (SELECT w.route_id, w.km, arg_min({{'lat': lat + (lat2 - lat) * (w_at - km_at) / (km2 - km_at), 'lon': lon + (lon2 - lon) * (w_at - km_at) / (km2 - km_at)}}, seq) AS p FROM want w JOIN leg l ON l.route_id = w.route_id AND w_at >= km_at AND w_at <= km2 GROUP BY ALL)
SELECT route_id, round(km, 3) AS km, round(p.lat, 5) AS lat, round(p.lon, 5) AS lon FROM cut UNION ALL SELECT route_id, round(km_at, 3), round(lat, 5), round(lon, 5) FROM mea WHERE km_at > 300 AND km_at < 700""")
def g6(spark, sf):
    out = geo.slice_routes(geo.measure(_lines(spark, sf)), F.lit(300.0), F.lit(700.0))
    return out.select("route_id", F.round("km", 3).alias("km"), F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"))


@job("m21_station_plan", f"""WITH {LINES}, t AS (SELECT *, greatest(1.0, max(km_at) OVER (PARTITION BY route_id)) AS total FROM mea), f AS (SELECT route_id, arg_min(seq, (km_at, seq)) AS nx FROM mea WHERE km_at >= 600 GROUP BY route_id)
SELECT t.route_id, seq, round((epoch_us(TIMESTAMP '{NOON}') - total / 60 * 3600000000 + km_at / total * (total / 60 * 3600000000)) / 60e6, 2) AS planned_minute, CASE WHEN km_at < 600 THEN 'model-passed' WHEN seq = nx THEN 'model-next' ELSE 'planned' END AS status FROM t LEFT JOIN f ON f.route_id = t.route_id""")
def m21(spark, sf):
    out = geo.station_plan(geo.measure(_lines(spark, sf)), F.lit(NOON).cast("timestamp"), 60.0, F.lit(600.0))
    return out.select("route_id", "seq", F.round(F.col("planned_us") / F.lit(60e6), 2).alias("planned_minute"), "status")


@job("f10_spacing", f"WITH {LINES} SELECT route_id, seq FROM (SELECT *, km_at - lag(km_at) OVER (PARTITION BY route_id ORDER BY km_at) AS gap FROM mea) WHERE gap IS NULL OR gap >= 400")
def f10(spark, sf):
    return geo.spaced(geo.measure(_lines(spark, sf)), "route_id", "km_at", 400).select("route_id", "seq")


@job("g8_simplified_lines")
def g8(spark, sf):
    return geo.simplify(_lines(spark, sf), 1.5)


@job("a13_poi_geohash")
def a13(spark, sf):
    left, _ = pts(spark, sf)
    return left.select("id", geo.geohash(F.col("lat"), F.col("lon"), 6).alias("geohash6"), geo.geohash(F.col("lat"), F.col("lon"), 8).alias("geohash8"), F.sha2(F.concat_ws("|", "name", "brand"), 256).alias("stable_id"))


def _nodes(spark, sf, having="true"):
    return table(spark, sf, "part").where(having).select(F.col("p_partkey").alias("node"))


@job("g1_components")
def g1(spark, sf):
    return graph.components(_nodes(spark, sf), g_edges(spark, sf))


@job("g1_graph_health")
def g1_health(spark, sf):
    edges = g_edges(spark, sf)
    return graph.health(graph.components(_nodes(spark, sf), edges), edges, 45)


@job("d11_known_ends", f"WITH {G_EDGES} SELECT src, dst, km FROM g_edges WHERE src IN (SELECT p_partkey FROM part WHERE p_size >= 10) AND dst IN (SELECT p_partkey FROM part WHERE p_size >= 10)")
def d11(spark, sf):
    return graph.known_ends(g_edges(spark, sf), _nodes(spark, sf, "p_size >= 10")).select("src", "dst", "km")


@job("g2_component_gaps")
def g2(spark, sf):
    edges = g_edges(spark, sf).where("km < 25")
    parts = graph.components(_nodes(spark, sf), edges)
    at = _nodes(spark, sf).select(F.col("node").alias("id"), (44 + F.pmod(F.col("node") * 7919, F.lit(9000)) / 1000.0).alias("lat"), (22 + F.pmod(F.col("node") * 104729, F.lit(18000)) / 1000.0).alias("lon"))
    return graph.gaps(parts, at, 2.0, 120)


PATHS = f"""WITH RECURSIVE {G_EDGES}, sy AS (SELECT src AS a, dst AS b, km FROM g_edges UNION ALL SELECT dst, src, km FROM g_edges), sym AS (SELECT a, b, min(km) AS km FROM sy GROUP BY a, b),
walk AS (SELECT p_partkey AS source, p_partkey AS node, 0.0::DOUBLE AS cost, 0 AS hops FROM part WHERE p_partkey % 50 = 0 UNION SELECT w.source, s.b, w.cost + s.km, w.hops + 1 FROM walk w JOIN sym s ON s.a = w.node WHERE w.hops < 6 AND w.cost + s.km <= 120)"""


@job("g12_shortest_paths", f"{PATHS} SELECT source, node, min(cost) AS cost FROM walk GROUP BY ALL")
def g12(spark, sf):
    return graph.shortest(_nodes(spark, sf).where("node % 50 = 0"), graph.undirected(g_edges(spark, sf)), 6, 120.0).select("source", "node", "cost")


@job("g13_walked_paths")
def g13(spark, sf):
    reached = graph.shortest(_nodes(spark, sf).where("node % 50 = 0"), graph.undirected(g_edges(spark, sf)), 6, 120.0)
    paths = graph.walk_back(reached, reached.where("hops >= 3").select("source", "node"), 8)
    return graph.path_quality(paths, F.col("source") + 1).select("source", "node", "cost", "steps", "repeats", "via")


@job("g11_station_contraction")
def g11(spark, sf):
    return graph.contract(_nodes(spark, sf, "p_size <= 8"), graph.undirected(g_edges(spark, sf)), 12, 250.0)


@job("g10_edges_from_ways", f"""WITH {PTS}, wy AS (SELECT id // 6 AS way_id, id AS node, 44 + (id % 997) * 0.01::DOUBLE AS lat, 22 + (id % 991) * 0.02::DOUBLE AS lon, CASE id // 6 % 5 WHEN 0 THEN 'yard' WHEN 1 THEN 'siding' END AS service, CASE WHEN id // 6 % 3 = 0 THEN 'industrial' END AS usage FROM lpts),
st AS (SELECT way_id, node AS src, lead(node) OVER w AS dst, lat, lon, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, service, usage FROM wy WINDOW w AS (PARTITION BY way_id ORDER BY node)),
k AS (SELECT *, {KM_SQL.format(lat1='lat', lon1='lon', lat2='lat2', lon2='lon2')} AS km FROM st WHERE dst IS NOT NULL), p AS (SELECT *, km * CASE service WHEN 'yard' THEN 8.0 WHEN 'siding' THEN 5.0 ELSE 1.0 END * CASE WHEN usage = 'industrial' THEN 2.5 ELSE 1.0 END AS cost FROM k WHERE km > 0 AND km < 25)
SELECT src, dst, round(km, 4) AS km, round(cost, 3) AS cost FROM p UNION ALL SELECT dst, src, round(km, 4), round(cost, 3) FROM p""")
def g10(spark, sf):
    k = F.col("id")
    way = F.floor(k / 6)
    ways = pts(spark, sf)[0].select(way.alias("way_id"), k.alias("seq"), k.alias("node"), (44 + k % 997 * 0.01).alias("lat"), (22 + k % 991 * 0.02).alias("lon"), F.when(way % 5 == 0, "yard").when(way % 5 == 1, "siding").alias("service"), F.when(way % 3 == 0, "industrial").alias("usage"))
    return graph.edges_from_ways(ways).select("src", "dst", F.round("km", 4).alias("km"), F.round("cost", 3).alias("cost"))


@job("e28_alias_conflicts", "WITH a AS (SELECT p_partkey AS owner, lower(p_brand) || (p_partkey % 700) AS alias FROM part) SELECT owner, alias FROM a WHERE alias NOT IN (SELECT alias FROM a GROUP BY alias HAVING count(DISTINCT owner) > 1)")
def e28(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("owner"), F.concat(F.lower("p_brand"), (F.col("p_partkey") % 700).cast("string")).alias("alias"))
    return graph.unique_owner(p, "alias", "owner").select("owner", "alias")


DUP = f"{PTS}, dp AS (SELECT id, CASE WHEN id % 3 = 0 THEN '' ELSE 'b' || (id % 4) END AS brand, ['gas', 'liquid', 'unknown', 'mixed'][(id % 4 + 1)::INTEGER] AS kind, name, 'Street ' || (id % 2) AS address, lat, lon FROM lpts), pr AS (SELECT a.id AS left_id, b.id AS right_id, a.brand AS left_brand, b.brand AS right_brand, a.kind AS left_kind, b.kind AS right_kind, a.name AS left_name, b.name AS right_name, a.address AS left_address, b.address AS right_address, {KM} AS km FROM dp a JOIN dp b ON a.id < b.id AND abs(a.lat - b.lat) < 1.0 AND abs(a.lon - b.lon) < 1.6)"


#: What tells two places apart: rows that agree in it and in their place are decided once.
DECIDED, SCORED = ["brand", "kind", "address_key"], ["brand", "words"]


def _duplicates(spark, sf, carry):
    left, _ = pts(spark, sf)
    rows = left.select("id", "lat", "lon", "name", F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("b"), (F.col("id") % 4).cast("string"))).alias("brand"), F.element_at(F.array(*map(F.lit, ("gas", "liquid", "unknown", "mixed"))), (F.col("id") % 4 + 1).cast("int")).alias("kind"), F.concat(F.lit("Street "), (F.col("id") % 2).cast("string")).alias("address"))
    rows = rows.withColumns({"address_key": places.address_key("address"), "words": places.words("name")})
    return geo.near_blocks(rows, rows, 1.3, 80, same=True, carry=carry)


def _same_places(spark, sf):
    """Pairs that are one place, with their brands."""
    return geo.spread_pairs(places.duplicate_decision(_duplicates(spark, sf, DECIDED), 70, 60, 40).where("duplicate"), ["km"], same=True, carry=["brand"])


def _catalogue(spark, sf):
    """The places of ``_duplicates`` with the fields that a merge fills."""
    left, _ = pts(spark, sf)
    k = F.col("id")
    return left.select("id", "lat", "lon", F.when(k % 4 == 1, "fuel").otherwise(F.col("name")).alias("name"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("b"), (k % 4).cast("string"))).alias("brand"), F.element_at(F.array(*map(F.lit, ("gas", "liquid", "unknown", "mixed"))), (k % 4 + 1).cast("int")).alias("kind"),
        F.concat(F.lit("Street "), (k % 2).cast("string")).alias("address"), F.when(k % 5 == 0, F.concat(F.lit("+"), k.cast("string"))).alias("phone"), (k % 6).cast("int").alias("sources"), (k % 7 == 0).alias("partner"), (k % 10 / 10.0).alias("confidence"), F.array(F.concat(F.lit("i"), (k % 9).cast("string"))).alias("images"))


@job("m14_duplicate_decision", f"""WITH {DUP} SELECT left_id, right_id, CASE WHEN km > 70 THEN 'distance' WHEN (left_kind = 'gas' AND right_kind = 'liquid') OR (left_kind = 'liquid' AND right_kind = 'gas') THEN 'facility_type_conflict' WHEN (left_kind = 'gas' AND right_kind = 'unknown') OR (left_kind = 'unknown' AND right_kind = 'gas') THEN 'facility_type_uncertain'
  WHEN left_brand <> '' AND right_brand <> '' AND left_brand <> right_brand THEN 'brand_conflict' WHEN left_brand <> '' AND right_brand <> '' AND km <= 60 THEN 'same_brand' WHEN NOT (left_brand <> '' AND right_brand <> '') AND km <= 40 THEN 'generic_overlap' WHEN NOT (left_brand <> '' AND right_brand <> '') AND km <= 60 AND left_address = right_address THEN 'same_address' ELSE 'insufficient_evidence' END AS reason FROM pr WHERE km <= 80""")
def m14(spark, sf):
    return geo.spread_pairs(places.duplicate_decision(_duplicates(spark, sf, DECIDED), 70, 60, 40), ["reason"], same=True)


@job("m15_duplicate_groups")
def m15(spark, sf):
    return places.duplicate_groups(_same_places(spark, sf))


@job("m15_merge_history")
def m15_history(spark, sf):
    groups = places.duplicate_groups(_same_places(spark, sf))
    return places.merge_history(groups, _catalogue(spark, sf), 70, 60, 40).select("source_id", "target_id", "reason", F.round("km", 4).alias("km"), "selected")


@job("m15_merged_places")
def m15_merged(spark, sf):
    catalogue = _catalogue(spark, sf)
    groups = places.duplicate_groups(_same_places(spark, sf))
    merged = places.merged_places(places.merge_history(groups, catalogue, 70, 60, 40), catalogue)
    return merged.select("id", "name", "brand", "address", "phone", F.array_join("images", ",").alias("images"), "confidence", F.size("merged").alias("merged"))


@job("m16_match_score", f"""WITH {DUP}, tk AS (SELECT *, list_distinct(string_split(regexp_replace(lower(left_name), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '-')) AS a, list_distinct(string_split(regexp_replace(lower(right_name), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '-')) AS b FROM pr WHERE km <= 80),
sc AS (SELECT *, least(1.0, greatest(0.0, CASE WHEN km / 100 <= 0.03 THEN 0.5 WHEN km / 100 <= 0.08 THEN 0.4 WHEN km / 100 <= 0.18 THEN 0.25 ELSE 0.0 END + CASE WHEN left_brand <> '' AND left_brand = right_brand THEN 0.35 WHEN left_brand = '' OR right_brand = '' THEN 0.1 ELSE -0.2 END + len(list_intersect(a, b)) / greatest(1, least(len(a), len(b)))::DOUBLE * 0.25)) AS s FROM tk)
SELECT left_id, right_id, round(s, 4) AS score, CASE WHEN s >= 0.7 THEN 'accepted' WHEN s >= 0.4 THEN 'review' ELSE 'rejected' END AS status FROM sc""")
def m16(spark, sf):
    return geo.spread_pairs(places.match_score(_duplicates(spark, sf, SCORED).withColumn("km", F.col("km") / 100)), ["score", "status"], same=True)


EVI = f"""{EV}, el AS (SELECT train AS place, ['availability', 'status', 'price', 'other'][(event_id % 4 + 1)::INTEGER] AS kind, CASE WHEN event_id % 2 = 0 THEN 'open' ELSE 'closed' END AS status, reliability, delay_min % 4 AS confirmations, delay_min % 3 AS conflicts, (epoch_us(TIMESTAMP '{NOON}') - epoch_us(occurred_at)) / 60e6 AS age, event_id FROM ev),
lf AS (SELECT *, CASE kind WHEN 'availability' THEN 360 WHEN 'status' THEN 180 WHEN 'price' THEN 1440 ELSE 60 END AS life FROM el),
cf AS (SELECT *, age >= 0 AND age < life AS usable, round(least(1.0, greatest(0.0, reliability * (0.55 + 0.45 * least(1.0, greatest(0.0, 1 - age / life))) + least(0.2, confirmations * 0.05) - least(0.4, conflicts * 0.15))), 6) AS confidence FROM lf)"""


def _evidence(spark, sf):
    e = ev(spark, sf)
    rows = e.select("event_id", F.col("train").alias("place"), F.element_at(F.array(*map(F.lit, ("availability", "status", "price", "other"))), (F.col("event_id") % 4 + 1).cast("int")).alias("kind"), F.when(F.col("event_id") % 2 == 0, "open").otherwise("closed").alias("status"), "reliability", (F.col("delay_min") % 4).alias("confirmations"), (F.col("delay_min") % 3).alias("conflicts"), F.col("occurred_at").alias("observed_at"))
    return places.evidence_confidence(rows, F.lit(NOON).cast("timestamp"))


@job("c21_evidence_confidence", f"WITH {EVI} SELECT event_id, usable, confidence FROM cf")
def c21(spark, sf):
    return _evidence(spark, sf).select("event_id", "usable", "confidence")


@job("m13_current_state", f"""WITH {EVI}, pe AS (SELECT place, status, max(confidence) AS best FROM cf WHERE usable GROUP BY ALL), rk AS (SELECT *, row_number() OVER w AS n, lead(best) OVER w AS second FROM pe WINDOW w AS (PARTITION BY place ORDER BY best DESC, status)),
k AS (SELECT *, coalesce(second >= 0.5 AND best - second < 0.15, false) AS conflict FROM rk WHERE n = 1) SELECT place, CASE WHEN conflict THEN 'unknown' ELSE status END AS status, best, conflict FROM k""")
def m13(spark, sf):
    return places.current_state(_evidence(spark, sf))


@job("a2_page_rows", "SELECT page_id, unnest(regexp_extract_all(html, '<li>(.*?)</li>', 1)) AS cell, generate_subscripts(regexp_extract_all(html, '<li>(.*?)</li>', 1), 1) - 1 AS pos FROM pages")
def a2(spark, sf):
    return pages.blocks(table(spark, sf, "pages"), "<li>(.*?)</li>").select("page_id", F.col("block").alias("cell"), "pos")


@job("a4_page_fields", "SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, regexp_extract(html, '<div class=\"ad\">(.*?)</div>', 1) AS ad FROM pages")
def a4(spark, sf):
    return pages.fields(table(spark, sf, "pages"), {"title": "<title>(.*?)</title>", "lang": '<html lang="([a-z]+)"', "ad": '<div class="ad">(.*?)</div>'})


@job("a5_page_posts", "SELECT page_id, pos, length(post) AS size FROM (SELECT page_id, unnest(string_split(html, '<p>')[2:]) AS post, generate_subscripts(string_split(html, '<p>')[2:], 1) - 1 AS pos FROM pages)")
def a5(spark, sf):
    return pages.split_posts(table(spark, sf, "pages"), "<p>").select("page_id", "pos", F.length("post").alias("size"))


@job("a8_option_list", "WITH o AS (SELECT page_id, regexp_extract_all(html, '<a href=\"/[^\"]*\">(.*?)</a>', 1) AS names FROM pages), e AS (SELECT page_id, names, names[2] AS a, names[5] AS b FROM o WHERE len(names) >= 5), k AS (SELECT *, list_position(names, a) AS i, list_position(names, b) AS j FROM e) SELECT page_id, array_to_string(CASE WHEN i <= j THEN names[i:j] ELSE list_reverse(names[j:i]) END, '>') AS stops FROM k")
def a8(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.regexp_extract_all("html", F.lit('<a href="/[^"]*">(.*?)</a>'), F.lit(1)).alias("names")).where(F.size("names") >= 5)
    return pages.clip_between(rows, "names", F.col("names")[1], F.col("names")[4]).select("page_id", F.array_join("clipped", ">").alias("stops"))


@job("a10_feed_items", "SELECT page_id, substr(sha256(url), 1, 16) AS item_id, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS title FROM pages")
def a10(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.substring(F.sha2("url", 256), 1, 16).alias("item_id"), F.regexp_extract("html", "<h1>(.*?)</h1>", 1).alias("title"))


@job("a6_mentions", "WITH m AS (SELECT conv_id, turn, text, unnest(list_distinct(regexp_extract_all(text, '\\bth[a-z]+', 0))) AS word FROM conversations) SELECT conv_id, turn, word, length(substr(text, strpos(text, word), 320)) AS context_size FROM m WHERE text IS NOT NULL")
def a6(spark, sf):
    return pages.mentions(table(spark, sf, "conversations").where("text IS NOT NULL"), "\\bth[a-z]+", 320).select("conv_id", "turn", "word", F.length("context").alias("context_size"))


@job("a3_pipe_rows", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text LIKE '%|%') SELECT doc_id, n, len(string_split(line, '|')) AS cells FROM l WHERE line LIKE '%|%'")
def a3(spark, sf):
    return pages.pipe_rows(table(spark, sf, "documents")).select("doc_id", "n", F.size("cells").alias("cells"))


@job("c28_page_text", "SELECT page_id, length(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS size FROM pages")
def c28(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.length(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\s+", " ")).alias("size"))


@job("a7_board_json", f"WITH {EV} SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 2 = 0 THEN epoch_us(occurred_at) // 1000000 ELSE epoch_us(occurred_at) // 1000 END AS raw, (epoch_us(occurred_at) // 1000000) AS seconds FROM ev")
def a7(spark, sf):
    raw = F.when(F.col("event_id") % 2 == 0, F.expr("unix_micros(occurred_at) div 1000000")).otherwise(F.expr("unix_micros(occurred_at) div 1000"))
    return ev(spark, sf).withColumn("raw", raw).select("event_id", F.from_json("props", "k long")["k"].alias("k"), "raw", pages.epoch_seconds(F.col("raw")).alias("seconds"))


@job("a9_coordinate_text", f"WITH {PTS} SELECT id, lat, lon FROM lpts WHERE id % 9 <> 0")
def a9(spark, sf):
    rows = pts(spark, sf)[0].select("id", F.when(F.col("id") % 9 == 0, "x,y").otherwise(F.concat_ws(",", F.col("lat").cast("string"), F.col("lon").cast("string"))).alias("at"))
    return pages.coordinates(rows, "at").where("lat IS NOT NULL AND lon IS NOT NULL").select("id", "lat", "lon")


@job("a7_station_boards", f"""WITH {EV}, b AS (SELECT event_id, train::VARCHAR AS train, station, epoch_us(occurred_at) // 1000000 AS s FROM ev)
SELECT event_id, 'departure' AS side, train, station, s AS seconds FROM b UNION ALL SELECT event_id, 'departure', train || 'x', station, s + 60 FROM b WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'arrival', train, station, s FROM b WHERE event_id % 3 = 0""")
def a7_boards(spark, sf):
    seconds = F.expr("unix_micros(occurred_at) div 1000000")
    call = lambda train, time: F.struct(train.alias("train"), F.col("station"), time.alias("time"))
    train, k = F.col("train").cast("string"), F.col("event_id")
    departures = F.when(k % 2 == 0, F.array(call(train, seconds), call(F.concat(train, F.lit("x")), (seconds + 60) * 1000))).otherwise(F.array(call(train, seconds * 1000)))
    rows = ev(spark, sf).select("event_id", F.to_json(F.struct(departures.alias("departures"), F.when(k % 3 == 0, F.array(call(train, seconds))).alias("arrivals"))).alias("board"))
    return pages.board_rows(rows, "board", "event_id")


@job("a11_criteria_counts", "SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS yes, count(*) FILTER (l_returnflag = 'N') AS no, count(*) FILTER (l_returnflag = 'A') AS not_applicable FROM lineitem GROUP BY l_orderkey")
def a11(spark, sf):
    count = lambda v: F.count_if(F.col("l_returnflag") == v)
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(count("R").alias("yes"), count("N").alias("no"), count("A").alias("not_applicable"))


@job("c17_entities", "SELECT doc_id, regexp_extract(text, '([0-9]{1,3})\\.[0-9]+\\.[0-9]+\\.[0-9]+', 1) AS net, regexp_extract(text, 'token = \"([0-9a-f]+)', 1) AS secret FROM documents WHERE regexp_matches(text, '[0-9]')")
def c17(spark, sf):
    return table(spark, sf, "documents").where(F.col("text").rlike("[0-9]")).select("doc_id", F.regexp_extract("text", r"([0-9]{1,3})\.[0-9]+\.[0-9]+\.[0-9]+", 1).alias("net"), F.regexp_extract("text", 'token = "([0-9a-f]+)', 1).alias("secret"))


@job("a14_versioned_import", f"""WITH {G_EDGES}, v AS (SELECT src, dst, km, (src // 500)::BIGINT AS version FROM g_edges WHERE src IN (SELECT p_partkey FROM part WHERE p_size >= 10)) SELECT version, count(*) AS segments, round(sum(km), 3) AS km, version = (SELECT max(version) FROM v) AS active FROM v GROUP BY version""")
def a14(spark, sf):
    known = _nodes(spark, sf, "p_size >= 10")
    rows = g_edges(spark, sf).join(known.withColumnRenamed("node", "src"), "src", "left_semi").withColumn("version", F.floor(F.col("src") / 500))
    parts = rows.groupBy("version").agg(F.count("*").alias("segments"), F.round(F.sum("km"), 3).alias("km"))
    return parts.withColumn("active", F.col("version") == F.max("version").over(Window.partitionBy()))


FRAME = "CASE WHEN {c} IS NULL THEN '-' ELSE length({c}::VARCHAR) || ':' || {c}::VARCHAR END"
_KEY, _ROW = (" || ".join(FRAME.format(c=c) for c in columns) for columns in (("src", "dst"), ("src", "dst", "metres")))
RANGES = f"""{G_EDGES}, e AS (SELECT src, dst, (km * 1000)::BIGINT AS metres FROM g_edges), digits AS (SELECT CASE WHEN count(*) <= 125 THEN 0 WHEN count(*) <= 125 * 16 THEN 1 WHEN count(*) <= 125 * 256 THEN 2 WHEN count(*) <= 125 * 4096 THEN 3 ELSE 4 END AS d FROM e),
r AS (SELECT *, left(sha256({_KEY}), d) AS range, sha256({_ROW}) AS digest FROM e, digits)"""


def _segments(spark, sf):
    return g_edges(spark, sf).select("src", "dst", (F.col("km") * 1000).cast("long").alias("metres"))


@job("a28_content_ranges", f"WITH {RANGES} SELECT range, count(*) AS rows, sha256(string_agg(digest, '' ORDER BY digest)) AS digest FROM r GROUP BY range")
def a28_ranges(spark, sf):
    return versions.range_digests(versions.in_ranges(_segments(spark, sf), ["src", "dst"]))


@job("a14_activated_graph", f"WITH {G_EDGES} SELECT src, dst, (km * 1000)::BIGINT AS metres FROM g_edges WHERE src NOT IN (SELECT p_partkey FROM part WHERE p_size < 10) AND dst NOT IN (SELECT p_partkey FROM part WHERE p_size < 10)")
def a14_activated(spark, sf):
    path = f"{scratch_root(spark)}/graph-{uuid.uuid4().hex}"
    known = _nodes(spark, sf, "p_size >= 10").withColumnRenamed("node", "station_id")
    both = _segments(spark, sf).join(known.withColumnRenamed("station_id", "src").hint(versions.JOIN), "src", "left_semi").join(known.withColumnRenamed("station_id", "dst").hint(versions.JOIN), "dst", "left_semi").select("src", "dst", "metres")
    versions.import_graph(known, both.where("src % 2 = 0"), path)
    versions.import_graph(known, both, path)
    versions.import_graph(known, _segments(spark, sf), path)  # has unknown ends, so the version before stays
    return versions.read_active(spark, path, "src long, dst long, metres long")
