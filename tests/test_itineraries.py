"""The canonical itinerary on literal runs."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerline.operators import coverage, itineraries

RUN = "run_id string, origin string, destination string, departure timestamp, ordered array<string>, calls array<struct<station:string,at:timestamp>>, listed array<string>"
T0 = dt.datetime(2026, 8, 11, 9)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def test_the_longest_list_between_the_ends_wins(spark):
    rows = [
        ("accumulated", "Kyiv", "Lviv", T0, None, [("Kyiv", at(0.5)), ("Korosten", at(2)), ("Shepetivka", at(5)), ("Lviv", at(9))], ["Kyiv", "Korosten", "Lviv", "Shepetivka"]),
        ("turned", "Lviv", "Kyiv", T0, ["Odesa", "Kyiv", "Zhmerynka", "Ternopil", "Lviv", "Mukachevo"], None, None),
        ("one end missing", "Kyiv", "Rivne", T0, ["Kyiv", "Korosten", "Lviv"], None, ["Kyiv", "Korosten"]),
        ("one stop", "A", "B", T0, ["A", "C", "B"], [("D", at(1))], None),
        ("no ends", None, None, None, ["A", "B", "C"], [("X", None), ("Y", at(1)), ("x ", at(2)), (None, at(0)), ("", at(0))], None),
        ("nothing", None, None, None, None, None, None),
        ("same ends", "A", "a", T0, ["A", "B", "C"], None, None),
        ("next day", "A", "B", T0, None, [("late", at(1)), ("early", at(-71)), ("day before", at(-50))], None),
    ]
    got = {r.run_id: r for r in itineraries.canonical(spark.createDataFrame(rows, RUN)).collect()}
    assert got["accumulated"].stops == ["Kyiv", "Korosten", "Shepetivka", "Lviv"] and (got["accumulated"].status, got["accumulated"].source) == ("verified", "station_calls") and got["accumulated"].confidence == 0.78
    assert got["turned"].stops == ["Lviv", "Ternopil", "Zhmerynka", "Kyiv"] and got["turned"].source == "ordered_schedule"
    assert (got["one end missing"].stops, got["one end missing"].status, got["one end missing"].confidence) == (["Kyiv", "Rivne"], "probabilistic", 0.3)
    assert (got["one stop"].stops, got["one stop"].source, got["one stop"].status, got["one stop"].confidence) == (["A", "C", "B"], "ordered_schedule", "constrained", 0.58)
    assert got["no ends"].stops == ["Y", "x "] and got["no ends"].direction == "unknown>unknown"
    assert got["nothing"].stops == [] and got["nothing"].source == "endpoints"
    assert got["same ends"].stops == ["A"]
    assert got["next day"].stops == ["A", "day before", "early", "late", "B"], "a call 71 hours before departure is one of the next day"


def test_a_version_grows_with_the_content_alone(spark):
    rows = [("779", d, "Sumy", "Kyiv", stops) for d, stops in (("1", ["Sumy", "Konotop", "Kyiv"]), ("2", ["SUMY", "Konotop ", "Kyiv"]), ("3", ["Sumy", "Vorozhba", "Konotop", "Kyiv"]))]
    found = itineraries.canonical(spark.createDataFrame(rows, "run_id string, day string, origin string, destination string, ordered array<string>"))
    versions = coverage.versioned(found, "run_id", "day", F.col("itinerary_hash")).orderBy("day").collect()
    assert [r.version for r in versions] == [1, 1, 2] and [len(r.stops) for r in versions] == [3, 3, 4]
    stops = itineraries.stops_of(found.where("day = '3'")).orderBy("sequence").collect()
    assert [(r.station, r.call_type, r.confidence) for r in stops] == [("Sumy", "origin", 0.92), ("Vorozhba", "scheduled", 0.92), ("Konotop", "scheduled", 0.92), ("Kyiv", "destination", 0.92)]
