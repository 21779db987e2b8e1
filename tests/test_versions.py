"""Versioned tables: names by content, ranges kept, and an import that dies leaves the old version."""

import pytest
from pyspark.sql import functions as F

from ledgerline.sources import versions

SCHEMA = "src long, dst long, km double"


def edges(spark, n=1000, change=None):
    df = spark.range(n).select("id", (F.col("id") + 1).alias("dst"), (F.col("id") % 7).cast("double").alias("km")).withColumnRenamed("id", "src")
    return df if change is None else df.withColumn("km", F.when(F.col("src") == change, 99.0).otherwise(F.col("km")))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_only_changed_ranges_are_written(spark, tmp_path):
    path = str(tmp_path / "graph")
    one = versions.publish(edges(spark), path, ["src", "dst"])
    assert rows(versions.read_active(spark, path, SCHEMA)) == rows(edges(spark))
    assert versions.publish(edges(spark).repartition(7), path, ["src", "dst"]) == one, "equal content, equal version"
    two = versions.publish(edges(spark, change=500), path, ["src", "dst"])
    assert two != one and rows(versions.read_active(spark, path, SCHEMA)) == rows(edges(spark, change=500))
    found = versions.manifest(spark, path)
    assert found.where(F.col("written") == two).count() == 1 < found.count() and found.agg(F.sum("rows")).first()[0] == 1000
    assert rows(versions.read_active(spark, path, SCHEMA, one)) == rows(edges(spark)), "the old version stays readable"
    assert versions.publish(edges(spark), path, ["src", "dst"]) == one and rows(versions.read_active(spark, path, SCHEMA)) == rows(edges(spark))


@pytest.mark.parametrize("dies_in", ["_moved", "manifest"])
def test_an_import_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch, dies_in):
    path = str(tmp_path / "graph")
    one = versions.publish(edges(spark), path, ["src", "dst"])

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(versions, dies_in, die)
        with pytest.raises(RuntimeError, match="lost"):
            versions.publish(edges(spark, 1200), path, ["src", "dst"])
    assert versions.active_version(spark, path) == one and rows(versions.read_active(spark, path, SCHEMA)) == rows(edges(spark))
    versions.publish(edges(spark, 1200), path, ["src", "dst"])
    assert rows(versions.read_active(spark, path, SCHEMA)) == rows(edges(spark, 1200))


def test_import_waits_for_its_stations(spark, tmp_path):
    path = str(tmp_path / "graph")
    stations = spark.range(1001).select(F.col("id").alias("station_id"))
    first = versions.import_graph(stations, edges(spark), path)
    assert first["status"] == "active"
    later = versions.import_graph(stations, edges(spark, 1005), path)
    assert later == {"status": "waiting", "version": first["version"], "segments": 1005, "unknown": 5}
    assert versions.read_active(spark, path, SCHEMA).count() == 1000


def test_versions_of_odd_tables(spark, tmp_path):
    empty = edges(spark).limit(0)
    assert versions.publish(empty, str(tmp_path / "a"), ["src"]) == "empty" and versions.read_active(spark, str(tmp_path / "a"), SCHEMA).count() == 0
    odd = spark.createDataFrame([(None, 1, None), (None, 1, None), (1, None, 2.0)], SCHEMA)
    versions.publish(odd, str(tmp_path / "b"), ["src"], 1)
    assert versions.read_active(spark, str(tmp_path / "b"), SCHEMA).count() == 3
    assert versions.active_version(spark, str(tmp_path / "none")) is None
