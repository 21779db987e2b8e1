"""Literal cases, invariants and boundaries of the operators."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import scalars
from ledgerline.operators import calibration, fusion, geo, graph, ledger, places, publish, screening, segments, state
from ledgerline.plans.components import connected_components
from ledgerline.plans.offsets import running_start
from ledgerline.plans.ranks import nearest_rank

T0 = datetime(2026, 7, 29, 10)


def now():
    return F.lit("2026-07-29 10:30:00").cast("timestamp")


def at(minutes):
    return T0 + timedelta(minutes=minutes)


EVENT = "event_id long, run_id string, train string, station string, occurred_at timestamp, source_id string, domain string, authority string, reliability double, delay_min int"


def events(spark, rows):
    return spark.createDataFrame(rows, EVENT)


def test_two_domains_corroborate(spark):
    rows = events(spark, [(1, "r", "091", "k", at(0), "official", "a", "official", 0.95, 0), (2, "r", "091", "k", at(4), "witness", "b", "operator", 0.8, 0)])
    got = fusion.fuse_domains(rows).collect()
    assert len(got) == 1 and got[0].grade == "corroborated" and got[0].reliability > 0.9 and got[0].primary_event_id == 1


def test_two_feeds_of_one_domain_are_one_source(spark):
    rows = events(spark, [(1, "r", "1", "k", at(0), "s1", "a", "public", 0.9, 0), (2, "r", "1", "k", at(2), "s2", "a", "public", 0.9, 0)])
    got = fusion.fuse_domains(rows).first()
    assert (got.sources, got.domains, got.grade) == (2, 1, "single-source")


def test_runs_that_disagree_conflict(spark):
    rows = events(spark, [(1, "r1", "1", "k", at(0), "s1", "a", "public", 0.9, 0), (2, "r2", "1", "k", at(2), "s2", "b", "public", 0.9, 0)])
    got = fusion.fuse_domains(rows).first()
    assert got.grade == "conflict" and got.reliability < 0.8


@pytest.mark.parametrize("gap,groups", [(20, 1), (20.001, 2)])
def test_session_boundary(spark, gap, groups):
    rows = events(spark, [(1, "r", "1", "k", at(0), "s", "a", "public", 0.9, 0), (2, "r", "1", "k", at(gap), "s", "a", "public", 0.9, 0)])
    assert fusion.fuse_domains(rows, 20).count() == groups


def test_every_event_is_in_one_group(spark):
    rows = events(spark, [(i, "r", str(i % 3), "k", at(i * 7 % 50), "s", "a", "public", 0.5, 0) for i in range(40)])
    assert fusion.fuse_simple(rows, 5).agg(F.sum("members")).first()[0] == 40


def posterior_row(spark, minutes, next_at=60):
    return spark.createDataFrame([("r", 300.0, 80.0, T0, 1.0, 0.9, 160.0 if next_at else None, at(next_at) if next_at else None)], "run_id string, route_km double, anchor_km double, anchor_at timestamp, error_km double, reliability double, next_km double, next_at timestamp"), F.lit(at(minutes)).cast("timestamp")


def test_posterior_lies_between_anchor_and_schedule(spark):
    p = state.posterior(*posterior_row(spark, 30)).first()
    assert 110 <= p.p50 <= 130 and p.status == "estimated"
    assert p.p025 <= p.p05 <= p.p10 <= p.p25 <= p.p50 <= p.p75 <= p.p90 <= p.p95 <= p.p975


@pytest.mark.parametrize("minutes,status", [(90, "estimated"), (91, "stale"), (180, "stale"), (181, "unknown")])
def test_posterior_ages(spark, minutes, status):
    assert state.posterior(*posterior_row(spark, minutes, None)).first().status == status


def test_screening_cases(spark):
    df = spark.createDataFrame([("12", T0, 5, 50.0, 30.0, "a-b", 1, "#1"), ("12", at(60), 1441, 50.0, 230.0, None, None, "#1 #2"), (None, None, None, None, None, "", None, None)], "number string, updated_at timestamp, delay int, lat double, lon double, route string, forecast int, text string")
    got = screening.assess(df, now()).collect()
    assert [len(r.errors) for r in got] == [0, 3, 2]
    assert set(got[1].errors) == {"future_timestamp", "impossible_delay", "invalid_coordinates"}
    assert set(got[1].warnings) == {"missing_route", "missing_forecast", "several_numbers"}


def test_null_delay_gives_no_delay_event(spark):
    rows = events(spark, [(1, "r", "1", "k", T0, "s", "a", "public", 0.2, None)])
    assert [r.type for r in ledger.unpivot_update(rows).collect()] == ["station_report"]


EVIDENCE = "corridor string, source_group string, fingerprint string, occurred_at timestamp, received_at timestamp, updated_at timestamp, confidence double, reviewed boolean"


def project(spark, rows, **options):
    return publish.project(spark.createDataFrame([(c, s, f"{s}{i}", t, t, u, 0.7, r) for i, (c, s, t, u, r) in enumerate(rows)], EVIDENCE), now(), **options).collect()


def test_publication_floors(spark):
    old = T0 - timedelta(days=2)
    pair = [("c", "a", old, old, False), ("c", "b", old + timedelta(hours=6), old, False)]
    assert len(project(spark, pair)) == 1
    assert project(spark, pair[:1]) == [], "one source group"
    assert project(spark, [*pair[:1], ("c", "b", old + timedelta(hours=6, seconds=1), old, False)]) == [], "a cluster is six hours from its first row"
    assert project(spark, [("c", s, old, T0, False) for s in "ab"]) == [], "young by one clock"
    assert len(project(spark, [("c", "a", old, old, True)])) == 1, "reviewed"
    assert project(spark, pair[:1], sources=1, delay_hours=0) == [], "floors cannot be lowered"
    row = project(spark, pair)[0].asDict()
    assert set(row) == {"corridor", "start", "end", "sources", "confidence", "uncertainty_km"} and row["uncertainty_km"] >= 35 and row["start"] % 900_000_000 == 0


def test_thinning_counts_from_the_last_kept(spark):
    rows = events(spark, [(i, "r", "1", "k", at(m), "s", "a", "public", 0.5, 0) for i, m in enumerate((0, 10, 15, 29, 30))])
    kept = sorted(r.kept_at for r in publish.thin(rows, "run_id", "occurred_at", 15).collect())
    assert [(k - kept[0]) // 60_000_000 for k in kept] == [0, 15, 30]


def test_nearest_rank(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 2, 3, 10)] + [("b", 7.0), ("b", None)], "k string, v double")
    got = {r.k: r for r in nearest_rank(df, ["k"], "v", {"p10": 0.1, "p50": 0.5, "p90": 0.9}).collect()}
    assert (got["a"].n, got["a"].p10, got["a"].p50, got["a"].p90, got["b"].n, got["b"].p50) == (5, 1, 2, 10, 1, 7)


def test_calibration_shifts_towards_the_truth(spark):
    rows = [(f"e{i}", 60.0, 68.0 + i % 3, 8.0 + i % 3, "a", "b", "s", 0 if i < 8 else 1, "m", 0, at(i)) for i in range(12)]
    evals = spark.createDataFrame(rows, "evaluation_id string, predicted double, actual double, residual double, from_station string, to_station string, source_id string, replay int, model_version string, within_p80 int, evaluated_at timestamp")
    profile = calibration.profiles(evals, 1).first()
    assert profile.readiness == "operational" and profile.mae_minutes >= 8
    edges = evals.limit(1).withColumns({"edge_id": F.lit("x"), "p10": F.lit(50.0), "p50": F.lit(60.0), "p90": F.lit(70.0)})
    for found in (calibration.apply_best(edges, calibration.profiles(evals, 3), 3), calibration.apply_best(edges, calibration.profiles(evals, 4), 4), calibration.apply_blend(edges, calibration.profiles(evals, 5))):
        r = found.first()
        assert r.p50 > 60 and r.p10 <= r.p50 <= r.p90


def test_paths_gaps_and_components(spark):
    edges = spark.createDataFrame([(1, 2, 10.0), (2, 3, 12.0), (1, 3, 40.0), (5, 6, 300.0)], "src long, dst long, km double")
    nodes = spark.createDataFrame([(n,) for n in (1, 2, 3, 5, 6, 9)], "node long")
    parts = graph.components(nodes, edges)
    assert {r.node: r.component for r in parts.collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 9: 9}
    health = graph.health(parts, edges, 250).first()
    assert (health.components, health.isolated, health.long_edges, health.status) == (3, 1, 1, "degraded")
    reached = graph.shortest(nodes.where("node = 1"), graph.undirected(edges), 5, 100.0)
    assert {r.node: r.cost for r in reached.collect()} == {1: 0, 2: 10, 3: 22}
    walked = graph.walk_back(reached, reached.where("node = 3").select("source", "node"), 5).first()
    assert walked.path == [1, 2, 3]
    stations = nodes.where("node IN (1, 2, 3)")
    assert {(r.a, r.b): r.cost for r in graph.contract(stations, graph.undirected(edges), 5, 100.0).collect()} == {(1, 2): 10, (2, 3): 12, (1, 3): 40}


def test_components_of_a_long_chain_and_nothing(spark):
    chain = spark.range(300).selectExpr("id AS src", "id + 1 AS dst")
    assert connected_components(chain).select("component").distinct().collect()[0][0] == 0
    assert connected_components(chain.limit(0)).collect() == []


def test_lines(spark):
    line = spark.createDataFrame([(1, i, 50.0, 30.0 + i / 10) for i in range(5)], "route_id long, seq long, lat double, lon double")
    m = geo.measure(line)
    length = m.agg(F.max("km_at")).first()[0]
    mid = geo.interpolate(m, spark.createDataFrame([(1, length / 2), (1, -5.0), (1, 1e6)], "route_id long, km double")).orderBy("km").collect()
    assert [round(r.lon, 3) for r in mid] == [30.0, 30.2, 30.4]
    off = geo.project(spark.createDataFrame([(7, 1, 50.01, 30.15)], "id long, route_id long, lat double, lon double"), m).first()
    assert abs(off.off_km - 1.112) < 0.01 and abs(off.km_at - length * 0.375) < 0.01
    bent = line.withColumn("lat", F.when(F.col("seq") == 2, 50.5).otherwise(F.col("lat")))
    assert sorted(r.seq for r in geo.simplify(bent, 0.05).collect()) == [0, 1, 2, 3, 4]
    assert sorted(r.seq for r in geo.simplify(bent, 0.1).collect()) == [0, 2, 4]
    assert sorted(r.seq for r in geo.simplify(line, 0.1).collect()) == [0, 4]


@pytest.mark.parametrize("lat,lon,expected", [(57.64911, 10.40744, "u4pruydq"), (48.669, -4.329, "gbsuv7zt"), (-25.382708, -49.265506, "6gkzwgjz")])
def test_geohash_vectors(spark, lat, lon, expected):
    got = spark.range(1).select(geo.geohash(F.lit(lat), F.lit(lon), 8)).first()[0]
    assert got[:5] == expected[:5]


def test_duplicate_union_never_crosses_brands(spark):
    rows = [(1, 2, "a", "", 0.01), (2, 3, "", "b", 0.02), (3, 4, "b", "b", 0.03)]
    pairs = spark.createDataFrame(rows, "left_id long, right_id long, left_brand string, right_brand string, km double")
    got = {r.id: r.place_id for r in places.duplicate_groups(pairs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3}


def test_strong_opposites_are_unknown(spark):
    rows = spark.createDataFrame([("p", "open", True, 0.9), ("p", "closed", True, 0.85), ("q", "open", True, 0.9), ("q", "closed", True, 0.3)], "place string, status string, usable boolean, confidence double")
    assert {r.place: r.status for r in places.current_state(rows).collect()} == {"p": "unknown", "q": "open"}


def test_running_start_is_a_total_order(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 AS n").repartition(5)
    got = running_start(df, [F.col("id")], "n", "start").orderBy("id").collect()
    total = 0
    for r in got:
        assert r.start == total
        total += r.n


def test_as_of_and_first_after(spark):
    left = spark.createDataFrame([("a", at(10), 1), ("a", at(-1), 2)], "k string, t timestamp, id long")
    right = spark.createDataFrame([("a", at(0), "x"), ("a", at(10), "y"), ("a", at(11), "z")], "k string, rt timestamp, v string")
    assert {r.id: r.last_v for r in state.as_of_join(left, right, ["k"], "t", "rt", ["v"]).collect()} == {1: "y", 2: None}
    assert {r.id: r.fact_id for r in state.first_after(left, right, ["k"], "t", "rt", "v").collect()} == {1: "z", 2: "x"}


@pytest.mark.parametrize("text,minutes", [("late 1 h 20 min", 80), ("+15", 15), ("at 12:45", None), ("12:45 +7 min", 7), ("2000 min", None), (None, None)])
def test_delay_texts(spark, text, minutes):
    assert spark.range(1).select(scalars.delay_minutes(F.lit(text).cast("string"))).first()[0] == minutes


def test_distance_of_null_is_null(spark):
    assert spark.range(1).select(scalars.haversine_km(F.lit(None).cast("double"), F.lit(1.0), F.lit(2.0), F.lit(3.0))).first()[0] is None


@pytest.mark.parametrize("run", [lambda e: fusion.fuse_domains(e), lambda e: segments.segment_stats(segments.consecutive_segments(e)), lambda e: state.tail_islands(e), lambda e: ledger.unpivot_update(e), lambda e: publish.thin(e, "run_id", "occurred_at", 15)])
def test_empty_ledger(spark, run):
    assert run(events(spark, [])).collect() == []


@pytest.mark.parametrize(("parts", "status"), [((1, 1, 1, 1), "operational"), ((0, 1, 0, 0), "warming"), ((0, 0, 0, 0), "insufficient-evidence")])
def test_readiness_of_four_parts(spark, parts, status):
    from ledgerline.operators import coverage

    runs = spark.createDataFrame([("planned",), ("active",), ("planned",)], "status string")
    tables = [runs.limit(0) if not p else runs for p in parts]
    row = coverage.readiness(*tables).first()
    assert (row.status, row.ready_count) == (status, sum(parts))
    assert [tuple(x) for x in row.statuses] == ([("active", 1), ("planned", 2)] if parts[1] else [])
