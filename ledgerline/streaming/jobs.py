"""Streaming variants of the batch jobs over a ledger that arrives as files."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ledgerline.operators.segments import activity_score
from ledgerline.plans.scratch import scratch_root


def ledger_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """The ledger as a stream of parquet files."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def checkpoint_for(spark: SparkSession, name: str) -> str:
    """The checkpoint of a stream in the shared folder: the same one for the same name, in every process."""
    return f"{scratch_root(spark)}/streams/{hashlib.sha256(name.encode()).hexdigest()[:24]}"


def run_once(stream: DataFrame, path: str, mode: str = "append", checkpoint: str | None = None) -> None:
    """Drain the stream to a parquet table.  A restart with the same checkpoint goes on where the last run ended."""
    where = checkpoint or checkpoint_for(stream.sparkSession, path)
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", where).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def deduplicated(stream: DataFrame, key: str = "event_id", time: str = "occurred_at", look_back: str = "36 hours") -> DataFrame:
    """Each event once, as long as its repeats come within the look-back."""
    return stream.withWatermark(time, look_back).dropDuplicatesWithinWatermark([key])


def sessions(stream: DataFrame, gap: str = "20 minutes", late: str = "36 hours") -> DataFrame:
    """Sessions of one train at one station: the best report of each source domain in a noisy-or, sources, and a grade."""
    weight = F.least(F.lit(1.0), F.greatest(F.lit(0.0), "reliability"))
    window = F.session_window("occurred_at", gap)
    said = F.collect_list(F.struct("domain", weight.alias("weight"))).alias("said")
    out = stream.withWatermark("occurred_at", late).groupBy("train", "station", window.alias("w")).agg(F.count("*").alias("members"), F.collect_set("source_id").alias("sources"), F.collect_set("domain").alias("domains"), said)
    doubt = F.aggregate("domains", F.lit(1.0), lambda left, d: left * (1 - F.array_max(F.transform(F.filter("said", lambda s: s["domain"] == d), lambda s: s["weight"]))))
    grade = F.when(F.size("domains") >= 2, "corroborated").otherwise("single-source")
    return out.select("train", "station", F.col("w.start").alias("window_start"), "members", F.size("sources").alias("sources"), F.size("domains").alias("domains"), (1 - doubt).alias("reliability"), grade.alias("grade"))


def activity(stream: DataFrame, baseline_hours: int = 23, late: str = "36 hours") -> DataFrame:
    """Activity of each station at each full hour against the hours before, by two aggregations in a row.

    The first counts the reports of each run an hour; the second sums these over a window of all hours that slides by one.
    """
    hourly = stream.withWatermark("occurred_at", late).groupBy(F.window("occurred_at", "1 hour").alias("w"), "station", "run_id").agg(F.count("*").alias("n"))
    hourly = hourly.select("station", "n", F.window_time("w").alias("at"))
    wide = hourly.withColumn("w", F.window("at", f"{baseline_hours + 1} hours", "1 hour")).withColumn("now", F.unix_micros("w.end") - F.unix_micros("at") <= 3_600_000_000)
    out = wide.groupBy("w", "station").agg(F.sum(F.when(F.col("now"), F.col("n")).otherwise(0)).alias("observations"), F.count_if("now").alias("unique_runs"), (F.sum(F.when(F.col("now"), 0).otherwise(F.col("n"))) / baseline_hours).alias("baseline_per_hour"))
    hour = F.date_format("w.end", "yyyy-MM-dd'T'HH")
    return activity_score(out).select(F.concat_ws(":", "station", hour).alias("score_id"), "station", F.col("w.end").alias("hour_end"), "observations", "unique_runs", "baseline_per_hour", "score", "change_ratio")


def snapshots(stream: DataFrame, width: str = "15 minutes", late: str = "36 hours") -> DataFrame:
    """The newest report of each run in each bucket, by its time."""
    newest = F.max_by("event_id", F.struct("occurred_at", "event_id")).alias("event_id")
    return stream.withWatermark("occurred_at", late).groupBy(F.window("occurred_at", width).alias("w"), "run_id").agg(newest).select("run_id", F.col("w.start").alias("bucket"), "event_id")


TRANSITION = "run_id string, event_id long, from_station string, station string, occurred_at timestamp"
EXPIRED = "expired"
#: Minutes of silence after which a run is stale, unknown and forgotten.
SILENCE = {"stale": 90, "unknown": 180, EXPIRED: 360}


#: Keys of a stateful job are dealt into so many buckets; the state of a bucket is read and written once a batch.  A checkpoint
#: belongs to one number of buckets.
BUCKETS = 512


def bucket_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("bucket")


def micros(times: pd.Series) -> list[int]:
    """Times as whole microseconds."""
    return times.astype("datetime64[us]").astype("int64").tolist()


def one_timer(handle: StatefulProcessorHandle, due: int | None, clear: bool) -> None:
    """One timer a bucket, at the next time something is due; one that has fired goes by itself."""
    for timer in list(handle.listTimers()) if clear else ():
        handle.deleteTimer(timer)
    if due is not None:
        handle.registerTimer(due // 1000 + 1)


class RunState(StatefulProcessor):
    """Last station of each run of a bucket; a row for every change, and one at each limit of silence.  After the last the run is forgotten.

    A silence shows by a timer or by the next report, whichever comes first, so the rows do not depend on how the stream is cut.
    """

    def __init__(self, silence: dict[str, int]):
        self.silence = {name: minutes * 60_000_000 for name, minutes in sorted(silence.items(), key=lambda x: x[1])}
        self.longest = max(self.silence.values())

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "run_id array<string>, station array<string>, at array<long>, told array<long>")

    def _read(self) -> dict[str, tuple]:
        if not self.last.exists():
            return {}
        return {run: rest for run, *rest in zip(*self.last.get(), strict=True)}

    def _write(self, runs: dict[str, tuple], clear: bool) -> None:
        if runs:
            self.last.update((list(runs), *map(list, zip(*runs.values(), strict=True))))
        else:
            self.last.clear()
        due = min((at + min(wait for wait in self.silence.values() if wait > told) for _, at, told in runs.values()), default=None)
        one_timer(self.handle, due, clear)

    def _silent(self, run: str, station: str, at: int, told: int, upto: int) -> list[tuple]:
        return [(run, -1, station, name, at + wait) for name, wait in self.silence.items() if told < wait < upto - at]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        runs, out = self._read(), []
        batch = pd.concat(list(rows)).sort_values(["occurred_at", "event_id"])
        for run, event, station, now in zip(batch["run_id"].tolist(), batch["event_id"].tolist(), batch["station"].tolist(), micros(batch["occurred_at"]), strict=True):
            before, at, told = runs.get(run, (None, None, 0))
            if before is not None:
                out += self._silent(run, before, at, told, now)
                if now - at > self.longest:
                    before = None
            if station != before:
                out.append((run, event, before, station, now))
            runs[run] = (station, now, 0)
        self._write(runs, True)
        yield _changes(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        runs, out, left = self._read(), [], {}
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        for run, (station, at, told) in runs.items():
            out += self._silent(run, station, at, told, upto)
            told = max([told, *(wait for wait in self.silence.values() if wait < upto - at)])
            if told < self.longest:
                left[run] = (station, at, told)
        self._write(left, False)
        yield _changes(out)

    def close(self) -> None:
        pass


def _changes(out: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(out, columns=["run_id", "event_id", "from_station", "station", "occurred_at"])
    return frame.assign(occurred_at=pd.to_datetime(frame["occurred_at"].astype("int64"), unit="us"))


def transitions(stream: DataFrame, silence: dict[str, int] = SILENCE, late: str = "1 hour") -> DataFrame:
    """Changes of station per run with event-time timers for silence.  Needs the RocksDB state store.

    Rows of a silent run carry the name of the limit in ``station`` and -1 for ``event_id``: the queue of runs to look at again.
    """
    rows = stream.withWatermark("occurred_at", late).select("run_id", "event_id", "station", "occurred_at", bucket_of("run_id"))
    return rows.groupBy("bucket").transformWithStateInPandas(RunState(silence), TRANSITION, "append", "eventtime")


def with_ledger(stream: DataFrame, ledger: str, fused: Callable[[DataFrame], None], now: Column, look_back_hours: int = 36, checkpoint: str | None = None) -> StreamingQuery:
    """Every row lands in the ledger; only rows inside the look-back go on to fusion.

    A batch is written under its number, so one that is tried again replaces what it had written.
    """

    def both(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            batch.write.mode("overwrite").parquet(f"{ledger}/batch={number}")
            fused(batch.where(F.unix_micros(now) - F.unix_micros("occurred_at") <= look_back_hours * 3_600_000_000))
        finally:
            batch.unpersist()

    where = checkpoint or checkpoint_for(stream.sparkSession, ledger)
    return stream.writeStream.foreachBatch(both).option("checkpointLocation", where).trigger(availableNow=True).start()


LAST_SEEN = "run_id string, last_at timestamp, since timestamp"


def coverage_gaps(stream: DataFrame, path: str, silent_minutes: int = 180, checkpoint: str | None = None) -> StreamingQuery:
    """Open, update and resolve coverage gaps as batches arrive: ``path/changes`` and the state after each batch in ``path/state``.

    A run is silent when it lags the newest report by more than the limit.  A batch reads the state of the batch before and
    writes its own, so it can be tried again.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        old = spark.read.schema(LAST_SEEN).parquet(f"{path}/state/batch={number - 1}") if number else spark.createDataFrame([], LAST_SEEN)
        seen = old.select("run_id", "last_at").unionByName(batch.select("run_id", F.col("occurred_at").alias("last_at"))).groupBy("run_id").agg(F.max("last_at").alias("last_at"))
        newest = seen.agg(F.max("last_at").alias("newest"))
        rows = seen.crossJoin(F.broadcast(newest))  # one row
        late = F.unix_micros("newest") - F.unix_micros("last_at") > silent_minutes * 60_000_000
        rows = rows.select("run_id", "last_at", F.when(late, F.col("last_at")).alias("since"))
        rows.write.mode("overwrite").parquet(f"{path}/state/batch={number}")
        now = spark.read.schema(LAST_SEEN).parquet(f"{path}/state/batch={number}")
        gaps = lambda df: df.where("since IS NOT NULL").select("run_id", "since")
        gap_changes(gaps(old), gaps(now)).write.mode("overwrite").parquet(f"{path}/changes/batch={number}")

    where = checkpoint or checkpoint_for(spark, path)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", where).trigger(availableNow=True).start()


def cycle_log(work: Callable[[DataFrame, int], dict[str, int]], log: str) -> Callable[[DataFrame, int], None]:
    """A batch function that logs the begin of ``work`` and its counters at the end, one row each, under the batch's number."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        row = lambda phase, counts: spark.range(1).select(F.lit(number).cast("long").alias("cycle_id"), F.lit(phase).alias("phase"), F.current_timestamp().alias("at"), F.lit(counts).cast("string").alias("counters"))
        row("started", None).write.mode("overwrite").parquet(f"{log}/cycle={number}/step=0")
        counters = work(batch, number)
        row("finished", json.dumps(counters, sort_keys=True)).write.mode("overwrite").parquet(f"{log}/cycle={number}/step=1")

    return run


def cycle_states(log: DataFrame, now: Column, limit_minutes: float = 20) -> DataFrame:
    """``cycle_id, status, minutes``: completed, running, or failed when a cycle has not ended within the limit."""
    began, ended = F.min(F.when(F.col("phase") == "started", F.col("at"))), F.max(F.when(F.col("phase") == "finished", F.col("at")))
    rows = log.groupBy("cycle_id").agg(began.alias("began"), ended.alias("ended"))
    minutes = (F.unix_micros(F.coalesce("ended", now)) - F.unix_micros("began")) / F.lit(60e6)
    status = F.when(F.col("ended").isNotNull(), "completed").when(minutes > limit_minutes, "failed").otherwise("running")
    return rows.where("began IS NOT NULL").select("cycle_id", status.alias("status"), F.round(minutes, 3).alias("minutes"))


def gap_changes(open_gaps: DataFrame, silent: DataFrame) -> DataFrame:
    """Merge the open coverage gaps with the runs silent now: opened, updated or resolved, one row a run."""
    o, s = open_gaps.select("run_id", F.col("since").alias("old_since")), silent.select("run_id", F.col("since").alias("new_since"))
    j = o.join(s, "run_id", "full_outer")
    status = F.when(F.col("old_since").isNull(), "opened").when(F.col("new_since").isNull(), "resolved").otherwise("updated")
    return j.select("run_id", status.alias("status"), F.coalesce("old_since", "new_since").alias("since"))


def heartbeat(checks: DataFrame) -> DataFrame:
    """Consecutive failures of each collector up to each check, reset by a success."""
    from pyspark.sql import Window

    order = Window.partitionBy("source_id").orderBy("occurred_at", "event_id")
    rows = checks.withColumn("round", F.sum(F.col("ok").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("source_id", "round").orderBy("occurred_at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("failures", F.sum((~F.col("ok")).cast("int")).over(run)).drop("round")
