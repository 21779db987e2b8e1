"""Proxy views: the shapes the operators expect, derived from the supplied tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AUTHORITIES = ["official", "operator", "reference", "reference", "public"]
#: "Now" of the registered jobs; jobs never read the clock.
NOW = "2024-01-30 12:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def minutes(later: Column | str, earlier: Column | str) -> Column:
    """Minutes between two timestamps, as a double."""
    later, earlier = (F.col(x) if isinstance(x, str) else x for x in (later, earlier))
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(60e6)


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observation ledger: one row an event."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select(
        "event_id",
        F.concat_ws(":", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("run_id"),
        F.col("user_id").alias("train"),
        F.col("event_type").alias("station"),
        F.to_date("ts").cast("string").alias("service_date"),
        F.col("ts").alias("occurred_at"),
        F.timestamp_micros(F.unix_micros("ts") + F.pmod("event_id", F.lit(7)) * 60_000_000).alias("observed_at"),
        F.concat(F.lit("s"), F.pmod("event_id", F.lit(5)).cast("string")).alias("source_id"),
        F.concat(F.lit("d"), F.pmod("event_id", F.lit(3)).cast("string")).alias("domain"),
        F.element_at(F.array(*map(F.lit, AUTHORITIES)), (F.pmod("event_id", F.lit(5)) + 1).cast("int")).alias("authority"),
        F.least(F.lit(1.0), F.col("value") / 50).alias("reliability"),
        F.get_json_object("props", "$.k").cast("int").alias("delay_min"),
        "value",
        "props",
    )


EV = """ev AS (SELECT event_id, user_id || ':' || CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, user_id AS train, event_type AS station,
  CAST(CAST(ts AS DATE) AS VARCHAR) AS service_date, ts AS occurred_at, ts + to_minutes(event_id % 7) AS observed_at,
  's' || (event_id % 5) AS source_id, 'd' || (event_id % 3) AS domain,
  ['official', 'operator', 'reference', 'reference', 'public'][(event_id % 5 + 1)::INTEGER] AS authority,
  least(1.0::DOUBLE, value / 50) AS reliability, CAST(json_extract_string(props, '$.k') AS INTEGER) AS delay_min, value, props FROM events)"""


def seg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive different stations of one run."""
    from ledgerline.operators.segments import consecutive_segments

    return consecutive_segments(ev(spark, sf_dir))


SEG = """hop AS (SELECT *, lag(station) OVER w AS from_station, lag(occurred_at) OVER w AS from_at, lag(delay_min) OVER w AS delay_in
  FROM ev WINDOW w AS (PARTITION BY run_id ORDER BY occurred_at, event_id)),
seg AS (SELECT event_id, run_id, train, from_station, station AS to_station, from_at, occurred_at AS to_at,
  (epoch_us(occurred_at) - epoch_us(from_at)) / 60e6 AS minutes, delay_in, delay_min AS delay_out FROM hop WHERE from_station <> station)"""


def evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions and what came of them."""
    rows = table(spark, sf_dir, "lineitem")
    actual = F.col("l_quantity") * (1 + F.col("l_discount") - F.col("l_tax"))
    return rows.select(
        F.concat_ws("-", *[F.col(f"l_{c}").cast("string") for c in ("orderkey", "linenumber", "partkey", "suppkey")]).alias("evaluation_id"),
        F.col("l_quantity").alias("predicted"),
        actual.alias("actual"),
        F.round(actual - F.col("l_quantity"), 4).alias("residual"),
        F.col("l_returnflag").alias("from_station"),
        F.col("l_linestatus").alias("to_station"),
        F.concat(F.lit("s"), F.pmod("l_suppkey", F.lit(5)).cast("string")).alias("source_id"),
        (F.col("l_orderkey") % 3 == 0).cast("int").alias("replay"),
        F.concat(F.lit("m"), F.pmod("l_partkey", F.lit(2)).cast("string")).alias("model_version"),
        (F.abs(F.round(actual - F.col("l_quantity"), 4)) <= 1.0).cast("int").alias("within_p80"),
        F.col("l_shipdate").cast("timestamp").alias("evaluated_at"),
    )


EVALS = """evals AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS evaluation_id, l_quantity AS predicted,
  l_quantity * (1 + l_discount - l_tax) AS actual, round(l_quantity * (1 + l_discount - l_tax) - l_quantity, 4) AS residual,
  l_returnflag AS from_station, l_linestatus AS to_station, 's' || (l_suppkey % 5) AS source_id, (l_orderkey % 3 = 0)::INTEGER AS replay,
  'm' || (l_partkey % 2) AS model_version, (abs(round(l_quantity * (1 + l_discount - l_tax) - l_quantity, 4)) <= 1.0)::INTEGER AS within_p80,
  l_shipdate AS evaluated_at FROM lineitem)"""


def _point(key: str) -> list[Column]:
    k = F.col(key)
    return [(44 + F.pmod(k * 7919, F.lit(9000)) / 1000.0).alias("lat"), (22 + F.pmod(k * 104729, F.lit(18000)) / 1000.0).alias("lon")]


def pts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two tables of places."""
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("brand"), *_point("c_custkey"))
    right = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("b"), F.pmod("s_suppkey", F.lit(7)).cast("string")).alias("brand"), *_point("s_suppkey"))
    return left, right


PTS = """lpts AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS brand, 44 + (c_custkey * 7919 % 9000) / 1000.0::DOUBLE AS lat, 22 + (c_custkey * 104729 % 18000) / 1000.0::DOUBLE AS lon FROM customer),
rpts AS (SELECT s_suppkey AS id, s_name AS name, 'b' || (s_suppkey % 7) AS brand, 44 + (s_suppkey * 7919 % 9000) / 1000.0::DOUBLE AS lat, 22 + (s_suppkey * 104729 % 18000) / 1000.0::DOUBLE AS lon FROM supplier)"""

#: Great-circle kilometres in SQL; format with the four coordinate expressions.
KM_SQL = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"


def g_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected edges over part keys: a chain with breaks, and chords."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (1 + F.col("p_size")).cast("double").alias("km"))
    top = p.agg(F.max("k").alias("n"))
    p = p.crossJoin(F.broadcast(top))  # one row
    chain = p.where("k % 97 <> 0 AND k < n").select(F.col("k").alias("src"), (F.col("k") + 1).alias("dst"), "km")
    chords = p.where("k % 11 = 0").select(F.col("k").alias("src"), (F.col("k") * 3 % F.col("n")).alias("dst"), "km")
    return chain.unionByName(chords.where("src <> dst AND dst > 0"))


G_EDGES = """g_top AS (SELECT max(p_partkey) AS n FROM part),
g_edges AS (SELECT p_partkey AS src, p_partkey + 1 AS dst, (1 + p_size)::DOUBLE AS km FROM part, g_top WHERE p_partkey % 97 <> 0 AND p_partkey < n
  UNION ALL SELECT p_partkey, p_partkey * 3 % n, (1 + p_size)::DOUBLE FROM part, g_top WHERE p_partkey % 11 = 0 AND p_partkey <> p_partkey * 3 % n AND p_partkey * 3 % n > 0)"""
