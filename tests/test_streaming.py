"""Streams give what the batch jobs give on the same rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import fusion, segments, state
from ledgerline.plans import jobs_streams
from ledgerline.plans.proxy import ev
from ledgerline.streaming import jobs, open_items

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ledger(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ledger"))
    rows = ev(spark, SMALL).orderBy("occurred_at")
    rows.coalesce(1).write.mode("overwrite").parquet(path)
    return path, spark.read.parquet(path)


def drained(spark, stream, path, mode="append"):
    jobs.run_once(stream, path, mode)
    return spark.read.parquet(path)


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_deduplicated(spark, ledger, tmp_path):
    path, rows = ledger
    rows.unionByName(rows).coalesce(1).write.parquet(str(tmp_path / "twice"))
    stream = jobs.ledger_stream(spark, str(tmp_path / "twice"), rows.schema)
    same(drained(spark, jobs.deduplicated(stream).select("event_id"), str(tmp_path / "out")), rows.select("event_id"))


def test_sessions_equal_gap_sessions(spark, ledger, tmp_path):
    path, rows = ledger
    stream = jobs.ledger_stream(spark, path, rows.schema)
    out = drained(spark, jobs.sessions(stream, "24 hours", "1 second").select("train", "station", "window_start", "members"), str(tmp_path / "out"))
    batch = fusion.gap_sessions(rows, ["train", "station"], 24 * 60).groupBy("train", "station", "session").agg(F.min("occurred_at").alias("window_start"), F.count("*").alias("members")).drop("session").select("train", "station", "window_start", "members")
    got, want = (set(map(tuple, d.collect())) for d in (out, batch))
    assert got <= want and len(got) > 0.5 * len(want)


def test_activity_equals_the_batch_job_at_each_hour(spark, ledger, tmp_path):
    path, rows = ledger
    out = drained(spark, jobs.activity(jobs.ledger_stream(spark, path, rows.schema), late="1 second"), str(tmp_path / "out"))
    assert out.count() > 100
    names = ["station", "observations", "unique_runs", "baseline_per_hour", "score", "change_ratio"]
    for hour in ("2024-01-10 07:00:00", "2024-01-20 00:00:00"):
        same(out.where(F.col("hour_end") == F.lit(hour).cast("timestamp")).select(names), segments.node_activity(rows, hour).select(names))


@pytest.fixture
def rocks(spark):
    with jobs_streams.rocks(spark):
        yield


def test_transitions_do_not_depend_on_the_cut(spark, ledger, tmp_path, rocks):
    path, rows = ledger
    by_day = str(tmp_path / "by-day")
    for day in [r[0] for r in rows.select(F.to_date("occurred_at")).distinct().orderBy(F.to_date("occurred_at")).collect()]:
        rows.where(F.to_date("occurred_at") == F.lit(day)).coalesce(1).write.mode("append").parquet(by_day)
    one = drained(spark, jobs.transitions(jobs.ledger_stream(spark, path, rows.schema)), str(tmp_path / "one"))
    many = drained(spark, jobs.transitions(jobs.ledger_stream(spark, by_day, rows.schema, 3)), str(tmp_path / "many"))
    same(one, many)
    changes = state.transitions(rows, "run_id", "occurred_at", "event_id", ["station"]).select("run_id", "event_id", "station")
    seen = {tuple(r) for r in one.where("event_id >= 0").select("run_id", "event_id", "station").collect()}
    assert {tuple(r) for r in changes.collect()} <= seen
    silent = {r.station: r["count"] for r in one.where("event_id < 0").groupBy("station").count().collect()}
    assert set(silent) == set(jobs.SILENCE) and silent["stale"] >= silent["unknown"] >= silent[jobs.EXPIRED] > 0, "silent runs pass all limits"


ITEM = "key string, kind string, id long, at timestamp, until timestamp"


def minute(m):
    return None if m is None else dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)


def test_open_items_end_once_over_late_rows_and_restarts(spark, tmp_path, rocks):
    """Batches as files, a process that ends after each: state, timers and output go on."""
    batches = [
        [("a", "prediction", 1, 0, 30), ("a", "prediction", 2, 50, 60), ("a", "anomaly", 7, 10, None), ("b", "hypothesis", 5, 0, 100), ("a", "fact", 90, 50, None), ("a", "fact", 91, 0, None)],
        [("a", "fact", 92, 40, None), ("a", "anomaly", 7, 40, None), ("c", "prediction", 3, 45, None)],  # late, but within the hour
        [("a", "fact", 93, 420, None), ("z", "fact", 99, 421, None)],
        [("a", "fact", 94, 30, None), ("c", "fact", 95, 1000, None)],  # the first one is too late
        [("c", "fact", 96, 1001, None), ("z", "fact", 99, 2000, None)],
    ]
    got = []
    for i, batch in enumerate(batches):
        rows = [(k, kind, n, minute(at), minute(until)) for k, kind, n, at, until in batch]
        spark.createDataFrame(rows, ITEM).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(ITEM).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        tagged = open_items.standing(stream.where("kind <> 'fact'"), stream.where("kind = 'fact'"))
        jobs.run_once(open_items.ended(tagged), str(tmp_path / "out"), checkpoint=str(tmp_path / "checkpoint"))
        got.append({(r.key, r.kind, r.id, r.status, r.at.strftime("%d %H:%M"), r.fact_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()})
    # the prediction made at the moment of a fact waits for the next one; facts 50 and 40: the earlier one by time resolves
    assert got[-1] == {
        ("a", "prediction", 1, "resolved", "01 00:40", 92), ("a", "prediction", 2, "resolved", "01 07:00", 93), ("a", "anomaly", 7, "resolved", "01 01:25", None), ("b", "hypothesis", 5, "expired", "01 01:40", None), ("c", "prediction", 3, "resolved", "01 16:40", 95),
    }
    assert all(x <= y for x, y in zip(got, got[1:], strict=False)) and spark.read.parquet(str(tmp_path / "out")).count() == 5
    assert not any(r[0] == "c" for r in got[2])


def test_predictions_expire_six_hours_after_their_interval(spark, tmp_path, rocks):
    rows = [("a", "prediction", 1, minute(0), minute(10)), ("a", "fact", 9, minute(371), None), ("a", "prediction", 2, minute(0), minute(11)), ("z", "fact", 8, minute(5000), None)]
    spark.createDataFrame(rows, ITEM).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ITEM).parquet(str(tmp_path / "in"))
    out = drained(spark, open_items.ended(open_items.standing(stream.where("kind <> 'fact'"), stream.where("kind = 'fact'"))), str(tmp_path / "out"))
    assert sorted((r.id, r.status, r.fact_id) for r in out.collect()) == [(1, "expired", None), (2, "resolved", 9)]


def test_late_rows_reach_the_ledger_but_not_fusion(spark, ledger, tmp_path):
    path, rows = ledger
    seen = []
    query = jobs.with_ledger(jobs.ledger_stream(spark, path, rows.schema), str(tmp_path / "kept"), lambda b: seen.append(b.count()), F.lit("2024-01-15 12:00:00").cast("timestamp"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "kept")).count() == rows.count() > sum(seen) > 0


def test_gaps_and_heartbeat(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "run_id string, since long")
    new = spark.createDataFrame([("b", 9), ("c", 3)], "run_id string, since long")
    assert sorted(map(tuple, jobs.gap_changes(old, new).collect())) == [("a", "resolved", 1), ("b", "updated", 2), ("c", "opened", 3)]
    checks = spark.createDataFrame([("s", i, i, ok) for i, ok in enumerate([False, False, True, False, False, False])], "source_id string, event_id long, occurred_at long, ok boolean")
    assert [r.failures for r in jobs.heartbeat(checks).orderBy("event_id").collect()] == [1, 2, 0, 1, 2, 3]


def test_a_stream_that_fails_and_restarts_lands_every_row_once(spark, ledger, tmp_path):
    path, rows = ledger
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = lambda: jobs.ledger_stream(spark, str(tmp_path / "in"), rows.schema, 1)
    now, seen, kept, where = F.lit("2024-01-15 12:00:00").cast("timestamp"), [], str(tmp_path / "kept"), str(tmp_path / "checkpoint")

    def failing(batch):
        seen.append(batch.count())
        if len(seen) == 3:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        jobs.with_ledger(stream(), kept, failing, now, checkpoint=where).awaitTermination()
    jobs.with_ledger(stream(), kept, failing, now, checkpoint=where).awaitTermination()
    jobs.with_ledger(stream(), kept, failing, now, checkpoint=where).awaitTermination()
    landed = spark.read.parquet(kept)
    assert landed.count() == rows.count() == landed.select("event_id").distinct().count()
    out = str(tmp_path / "out")
    jobs.run_once(stream().select("event_id"), out, checkpoint=str(tmp_path / "other"))
    jobs.run_once(stream().select("event_id"), out, checkpoint=str(tmp_path / "other"))
    assert spark.read.parquet(out).count() == rows.count()
    assert jobs.checkpoint_for(spark, "x") == jobs.checkpoint_for(spark, "x")


def test_coverage_gaps_on_a_stream(spark, tmp_path):
    at = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
    for i, part in enumerate(([("a", 0), ("b", 0)], [("b", 200)], [("a", 230), ("b", 230)])):
        spark.createDataFrame([(r, at(m)) for r, m in part], "run_id string, t string").select("run_id", F.col("t").cast("timestamp").alias("occurred_at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.ledger_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, 1)
        jobs.coverage_gaps(stream, str(tmp_path / "gaps"), 180, str(tmp_path / "checkpoint")).awaitTermination()
    got = sorted((r.batch, r.run_id, r.status) for r in spark.read.parquet(str(tmp_path / "gaps/changes")).collect())
    assert got == [(1, "a", "opened"), (2, "a", "resolved")]


def test_cycle_log_and_watchdog(spark, tmp_path):
    run = jobs.cycle_log(lambda batch, n: {"rows": batch.count()}, str(tmp_path / "log"))
    run(spark.range(5), 0)
    run(spark.range(5), 0)
    with pytest.raises(ZeroDivisionError):
        jobs.cycle_log(lambda batch, n: 1 / 0, str(tmp_path / "log"))(spark.range(2), 1)
    log = spark.read.parquet(str(tmp_path / "log"))
    assert [r.counters for r in log.where("phase = 'finished'").collect()] == ['{"rows": 5}']
    states = lambda after: {r.cycle_id: r.status for r in jobs.cycle_states(log, F.current_timestamp() + F.expr(f"interval {after} minutes")).collect()}
    assert states(5) == {0: "completed", 1: "running"} and states(25) == {0: "completed", 1: "failed"}


class Handle:
    """State and timers of one bucket in memory; counts what is written."""

    def __init__(self):
        self.values, self.timers, self.calls = {}, set(), 0

    def getValueState(self, name, schema):
        handle = self

        class Value:
            exists = staticmethod(lambda: name in handle.values)
            get = staticmethod(lambda: handle.values[name])
            clear = staticmethod(lambda: handle.values.pop(name, None))

            @staticmethod
            def update(value):
                handle.calls += 1
                handle.values[name] = value

        return Value

    def listTimers(self):
        return iter(sorted(self.timers))

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_bucket_writes_its_state_once_a_batch():
    import pandas as pd

    n = 500
    at = pd.to_datetime([1_700_000_000_000_000 + i * 1000 for i in range(n)], unit="us")
    state_of, handle = jobs.RunState(jobs.SILENCE), Handle()
    state_of.init(handle)
    batch = pd.DataFrame({"run_id": [f"r{i}" for i in range(n)], "event_id": range(n), "station": "s", "occurred_at": at})
    first = pd.concat(state_of.handleInputRows((1,), iter([batch[:200], batch[200:]]), Mark(0)))
    assert len(first) == n and handle.calls == 2 and len(handle.timers) == 1
    late = pd.concat(state_of.handleExpiredTimer((1,), Mark(1_700_000_000_000 + 400 * 60_000), None))
    assert late["station"].value_counts().to_dict() == dict.fromkeys(jobs.SILENCE, n) and not handle.values
    items, handle = open_items.OpenItems(), Handle()
    items.init(handle)
    batch = pd.DataFrame({"key": [f"k{i % 50}" for i in range(n)], "kind": ["fact" if i % 10 == 9 else "prediction" for i in range(n)], "id": range(n), "at": at, "until": at + pd.Timedelta(hours=1)})
    list(items.handleInputRows((1,), iter([batch]), Mark(0)))
    assert handle.calls == 3 and len(handle.timers) == 1
    done = pd.concat(items.handleExpiredTimer((1,), Mark(1_700_000_000_000 + 120 * 60_000), None))
    assert len(done) == n - n // 10 and not handle.values
