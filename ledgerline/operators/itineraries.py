"""The canonical itinerary of a run: one of three lists of stops, clipped between its ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.scalars import fnv1a, slug

#: Confidence of a stop by the list it comes from, and of a run by its stops between the ends.
STOP_CONFIDENCE = {"ordered_schedule": 0.92, "station_calls": 0.78, "listed_schedule": 0.45, "endpoints": 0.45}
MOST, FROM, EACH, ONE, NONE = 0.96, 0.72, 0.03, 0.58, 0.3
#: A call more than this many hours before departure belongs to a later day.
BEFORE_HOURS = 60
COLUMNS = {"origin": "string", "destination": "string", "departure": "timestamp", "ordered": "array<string>", "calls": "array<struct<station:string,at:timestamp>>", "listed": "array<string>"}


def unique_stops(names: Column) -> Column:
    """The names without empty ones and without those whose slug came before."""
    named = F.filter(names, lambda n: F.coalesce(slug(n), F.lit("")) != "")
    keys = F.transform(named, slug)
    return F.filter(named, lambda n, i: F.array_position(keys, slug(n)) == i + 1)


def clipped(names: Column, origin: Column, destination: Column) -> Column:
    """The part of the list from origin to destination, turned round if they stand the other way; empty if one is missing."""
    keys = F.transform(names, slug)
    at, to = F.array_position(keys, slug(origin)), F.array_position(keys, slug(destination))
    forth = F.slice(names, F.least(at, to).cast("int"), (F.abs(to - at) + 1).cast("int"))
    both = F.coalesce((at > 0) & (to > 0) & (at != to), F.lit(False))
    return F.when(both & (at < to), forth).when(both, F.reverse(forth)).otherwise(F.array().cast("array<string>"))


def calls_in_order(calls: Column, departure: Column) -> Column:
    """Names of the calls by time; times long before departure are moved on by whole days, calls without a time come last."""
    least = F.unix_micros(departure) - BEFORE_HOURS * 3_600_000_000
    day = 86_400_000_000

    def time(call: Column) -> Column:
        at = F.unix_micros(call["at"])
        return F.when(least.isNotNull() & (at < least), at + F.ceil((least - at) / F.lit(day)) * day).otherwise(at)

    placed = F.transform(calls, lambda c, i: F.struct(time(c).isNull().alias("late"), time(c).alias("at"), i.alias("i"), c["station"].alias("station")))
    return F.transform(F.array_sort(placed), lambda c: c["station"])


def canonical(runs: DataFrame) -> DataFrame:
    """The runs with ``source, stops, status, confidence, stop_confidence, direction, itinerary_hash``.

    Reads ``COLUMNS``, those that there are.  The longest of the ordered list, the calls and the listed stations is taken, in this
    order where they tie; lists must hold both ends.  With fewer than two stops the ends themselves are the itinerary.
    """
    rows = runs.withColumns({c: F.lit(None).cast(t) for c, t in COLUMNS.items() if c not in runs.columns})
    none = F.array().cast("array<string>")
    origin, destination = F.col("origin"), F.col("destination")
    ends = F.array(origin, destination)
    names = calls_in_order(F.coalesce("calls", F.array().cast(COLUMNS["calls"])), F.col("departure"))
    same = lambda a, b: F.coalesce((slug(a) != "") & (slug(a) == slug(b)), F.lit(False))
    between = F.filter(unique_stops(names), lambda n: ~same(n, origin) & ~same(n, destination))
    rows = rows.withColumns({
        "_ordered": clipped(unique_stops(F.coalesce("ordered", none)), origin, destination), "_calls": unique_stops(F.concat(F.array(origin), between, F.array(destination))), "_listed": clipped(unique_stops(F.coalesce("listed", none)), origin, destination),
    })
    lists = F.array(*[F.struct(F.lit(name).alias("source"), F.col(c).alias("stops")) for name, c in (("ordered_schedule", "_ordered"), ("station_calls", "_calls"), ("listed_schedule", "_listed"))])
    long = F.filter(lists, lambda x: F.size(x["stops"]) >= 2)
    most = F.array_max(F.transform(long, lambda x: F.size(x["stops"])))
    chosen = F.coalesce(F.get(F.filter(long, lambda x: F.size(x["stops"]) == most), F.lit(0)), F.struct(F.lit("endpoints").alias("source"), unique_stops(ends).alias("stops")))
    rows = rows.withColumn("_chosen", chosen).drop("_ordered", "_calls", "_listed")
    rows = rows.withColumns({"source": F.col("_chosen.source"), "stops": F.col("_chosen.stops")}).drop("_chosen")
    inside = F.greatest(F.lit(0), F.size("stops") - 2)
    status = F.when(inside >= 2, "verified").when(inside == 1, "constrained").otherwise("probabilistic")
    confidence = F.when(inside >= 2, F.least(F.lit(MOST), F.round(FROM + inside * EACH, 4))).when(inside == 1, ONE).otherwise(NONE)
    by_list = F.lit(STOP_CONFIDENCE["endpoints"])
    for name, value in STOP_CONFIDENCE.items():
        by_list = F.when(F.col("source") == name, value).otherwise(by_list)
    end = lambda x: F.coalesce(F.nullif(slug(x), F.lit("")), F.lit("unknown"))
    content = F.array_join(F.transform("stops", slug), ">")
    return rows.withColumns({"status": status, "confidence": confidence, "stop_confidence": by_list, "direction": F.concat(end(origin), F.lit(">"), end(destination)), "itinerary_hash": F.concat(F.lit("it-v1-"), fnv1a(content))})


def stops_of(itineraries: DataFrame, key: str = "run_id") -> DataFrame:
    """One row a stop: its place, its name and whether the run begins or ends there."""
    last = F.size("stops") - 1
    rows = itineraries.select(key, "stop_confidence", last.alias("last"), F.posexplode("stops").alias("sequence", "station"))
    call = F.when(F.col("sequence") == 0, "origin").when(F.col("sequence") == F.col("last"), "destination").otherwise("scheduled")
    return rows.select(key, "sequence", "station", call.alias("call_type"), F.col("stop_confidence").alias("confidence"))
