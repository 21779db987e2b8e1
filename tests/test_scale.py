"""Work that grows with the distinct questions and not with the rows that ask them."""

from pyspark.sql import functions as F

from ledgerline.operators import calibration, routes, segments
from ledgerline.sources import versions


def test_equal_requests_ask_once(spark, monkeypatch):
    asked, write = [], routes.materialize

    def counted(df, name):
        table = write(df, name)
        if name == "route-asks":
            asked.append((table.count(), table.where("ask = question").count()))
        return table

    monkeypatch.setattr(routes, "materialize", counted)
    stations = spark.createDataFrame([(i, "Bergheim" if i < 20 else f"Haupt {i}", 45.0 + i * 0.1, 23.0) for i in range(30)], "station_id long, name string, lat double, lon double")
    names = spark.createDataFrame([(r, p, n) for r in range(50) for p, n in enumerate(("Bergheim", "Haupt 25"))], "request_id long, pos long, name string")
    known = spark.createDataFrame([("haupt-25", 25, 1.0)], "alias_key string, station_id long, confidence double")
    got = {(r.request_id, r.pos): r.station_id for r in routes.resolve_aliases(names, known, stations).collect()}
    assert got == {(r, p): s for r in range(50) for p, s in enumerate((19, 25))}
    assert asked == [(50, 1)]


def test_replay_meets_its_own_row_and_one_more(spark):
    facts = spark.createDataFrame([(i, i, "a", "b", 10.0 + i) for i in range(40)] + [(90, 3, "a", "c", 5.0), (91, 5, "x", "y", 5.0)], "event_id long, train long, from_station string, to_station string, minutes double")
    rows = [(t, "a", "b", 5 + t % 8, 20.0 + t) for t in range(0, 40, 2)] + [(3, "a", "c", 1, 7.0), (5, "x", "z", 50, 7.0)]
    got = {r.event_id: (r.learned_from, r.sample_count, r.p50) for r in segments.replay(facts, spark.createDataFrame(rows, "train long, from_station string, to_station string, sample_count long, p50 double"), 10).collect()}
    # the trains 6, 14, .. have 11 samples, the most; 6 is the first of them
    assert got == {**{i: (i, 5 + i % 8, 20.0 + i) if i % 2 == 0 else (6, 11, 26.0) for i in range(40)}, 90: (3, 1, 7.0)}


def test_profiles_are_looked_up_once_a_combination(spark):
    edges = spark.range(1000).select(F.col("id").alias("edge_id"), F.lit("s").alias("source_id"), F.when(F.col("id") % 2 == 0, "m").alias("model_version"), F.lit("a").alias("from_station"), F.lit("b").alias("to_station"), F.lit("2026-01-01 07:00:00").cast("timestamp").alias("evaluated_at"), F.lit(20.0).alias("predicted"),
        F.lit(15.0).alias("p10"), F.lit(20.0).alias("p50"), F.lit(26.0).alias("p90"), F.lit(0).alias("replay"), F.lit(4.0).alias("residual"), F.lit(0).alias("within_p80"))
    for generation, apply in ((4, lambda e, p: calibration.apply_best(e, p, 4)), (5, calibration.apply_blend)):
        assert calibration._by_kind(edges, generation)[1].count() == 2 * len(calibration.dimensions(generation))
        out = apply(edges, calibration.profiles(edges, generation))
        assert out.count() == 1000 and out.where("p50 > 23").count() == 1000, "edges with a null model are corrected too"


def test_versions_send_no_table_through_the_driver(spark, tmp_path):
    stations = spark.range(500).withColumnRenamed("id", "station_id")
    rows = spark.range(499).selectExpr("id AS src", "id + 1 AS dst", "id * 7 AS metres")
    path = f"file://{tmp_path}/graph"
    assert versions.import_graph(stations, rows, path, 10)["status"] == "active"
    active = versions.read_active(spark, path, "src long, dst long, metres long")
    assert active.count() == 499
    assert "Broadcast" not in active._jdf.queryExecution().executedPlan().toString()
