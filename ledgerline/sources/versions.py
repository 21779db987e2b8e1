"""Versioned tables: content-named ranges, a manifest, and a pointer that moves by one atomic rename.

Rows are dealt into ranges of the hash of their key, so that a changed row changes one range and no other; the number of hex
digits that name a range follows the number of rows.  A range's digest is that of its rows, the digests are folded up the tree
of prefixes, and the top is the version: equal content has an equal version wherever and whenever it is made.  Publishing writes
the ranges that the active version does not hold, then the manifest, then moves the pointer.  A job that dies on the way leaves
the active version as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.plans.scratch import materialize, release

#: Keys and digests take far less room on disk than in a hash table, so Spark's size check would send whole tables of them through
#: the driver; their joins sort instead.
JOIN = "merge"
#: Rows of a range on average, at most.
RANGE_ROWS = 125
DIGITS = 16
MANIFEST = "range string, rows long, digest string, written string"


def _framed(columns: list[str]) -> Column:
    """Values with their lengths, null as a sign of its own, so that different rows never read alike."""
    text = lambda c: F.col(c).cast("string")
    return F.concat(*[F.coalesce(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in columns])


def in_ranges(rows: DataFrame, key: list[str], size: int = RANGE_ROWS) -> DataFrame:
    """The rows with ``range``: the first hex digits of the hash of their key."""
    n = rows.count()
    digits = next(d for d in range(DIGITS) if n <= size * 16**d)
    return rows.withColumn("range", F.left(F.sha2(_framed(key), 256), F.lit(digits)))


def range_digests(ranged: DataFrame) -> DataFrame:
    """``range, rows, digest``: a range's rows in the order of their own digests, so equal rows count each."""
    columns = [c for c in ranged.columns if c != "range"]
    each = ranged.select("range", F.sha2(_framed(columns), 256).alias("d"))
    return each.groupBy("range").agg(F.count("*").alias("rows"), F.sha2(F.array_join(F.sort_array(F.collect_list("d")), ""), 256).alias("digest"))


def version_of(digests: DataFrame) -> str:
    """The top of the tree of prefixes over ``range, digest``."""
    digits = digests.agg(F.max(F.length("range"))).first()[0] or 0
    level = digests.select(F.col("range").alias("p"), "digest")
    for d in range(digits - 1, -1, -1):
        level = level.groupBy(F.left("p", F.lit(d)).alias("p")).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "digest"))), lambda x: F.concat(x["p"], F.lit("="), x["digest"])), ","), 256).alias("digest"))
    top = level.first()
    return (top["digest"] if top else "empty")[:32]


def _moved(spark: SparkSession, path: str, version: str) -> None:
    """Write the pointer beside its place and rename it over the old one."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new, place = jvm.org.apache.hadoop.fs.Path(f"{path}/_ACTIVE.{version}"), jvm.org.apache.hadoop.fs.Path(f"{path}/ACTIVE")
    out = new.getFileSystem(conf).create(new, True)
    out.writeBytes(version + "\n")
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), conf).rename(new, place, over)


def active_version(spark: SparkSession, path: str) -> str | None:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/ACTIVE")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.text(f"{path}/ACTIVE").first()[0]


def manifest(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """``range, rows, digest, written`` of a version, the active one by default."""
    version = version or active_version(spark, path)
    if not version:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifests/{version}")


def publish(rows: DataFrame, path: str, key: list[str], size: int = RANGE_ROWS) -> str:
    """Make ``rows`` the active version of the table at ``path``; only ranges that the active one does not hold are written."""
    spark = rows.sparkSession
    ranged = materialize(in_ranges(rows, key, size), "version-rows")
    digests = materialize(range_digests(ranged), "version-digests")
    version = version_of(digests)
    if version != active_version(spark, path):
        held = manifest(spark, path).select("range", "digest", "written")
        full = digests.join(held.hint(JOIN), ["range", "digest"], "left").withColumn("written", F.coalesce("written", F.lit(version)))
        full = materialize(full.select("range", "rows", "digest", "written"), "version-manifest")
        fresh = ranged.join(full.where(F.col("written") == version).select("range").hint(JOIN), "range", "left_semi")
        fresh.write.mode("overwrite").parquet(f"{path}/data/written={version}")
        full.write.mode("overwrite").parquet(f"{path}/manifests/{version}")
        _moved(spark, path, version)
        release(full)
    release(ranged, digests)
    return version


def read_active(spark: SparkSession, path: str, schema: str, version: str | None = None) -> DataFrame:
    """The rows of a version, the active one by default."""
    wanted = manifest(spark, path, version).select("range", "written")
    table = spark.read.schema(f"{schema}, range string, written string").parquet(f"{path}/data")
    return table.join(wanted.hint(JOIN), ["range", "written"], "left_semi").drop("range", "written")


def import_graph(stations: DataFrame, segments: DataFrame, path: str, size: int = RANGE_ROWS) -> dict:
    """Publish ``src, dst, ..`` segments if both ends of every one are known stations; else the active version stays.

    Returns ``status`` (``active`` or ``waiting``), the version, the segments and how many of them have an unknown end.
    """
    node = stations.select("station_id").distinct()
    known = segments.join(node.withColumnRenamed("station_id", "src").hint(JOIN), "src", "left_semi").join(node.withColumnRenamed("station_id", "dst").hint(JOIN), "dst", "left_semi").select(segments.columns)
    total, good = segments.count(), known.count()
    if good < total:
        return {"status": "waiting", "version": active_version(segments.sparkSession, path), "segments": total, "unknown": total - good}
    return {"status": "active", "version": publish(known, path, ["src", "dst"], size), "segments": total, "unknown": 0}
