"""Lineage cuts: tables written to the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the tables written in this context are noted: lists of (folder, catalog table).
_HOLDERS: ContextVar[tuple[list, ...]] = ContextVar("holders", default=())


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of this session.

    Executors of a cluster do not share local disks, so a local folder is made only for a ``local`` master (tests).
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="ledgerline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _new_path(spark: SparkSession, name: str, table: str | None = None) -> str:
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    for holder in _HOLDERS.get():
        holder.append((path, table))
    return path


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and return the table read back.

    Unlike ``localCheckpoint`` the rows survive any executor, and a reader knows the size on disk, so Spark
    broadcasts the table only when it is below the session's threshold.  The folder goes when it is released or when
    the JVM ends.
    """
    spark = df.sparkSession
    path = _new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = [(path, None)]
    return table


def bucketed(df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
    """As ``materialize``, in buckets of ``keys``: joins and groupings on these keys do not shuffle the table again."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    path = _new_path(spark, name, table)
    df.write.bucketBy(buckets, *keys).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(table)
    found = spark.table(table)
    found._scratch = [(path, table)]
    return found


@contextmanager
def holding() -> Iterator[list]:
    """Notes every table written inside, in this thread alone; ``hold`` ties them to a result."""
    mine: list = []
    token = _HOLDERS.set((*_HOLDERS.get(), mine))
    try:
        yield mine
    finally:
        _HOLDERS.reset(token)


def hold(result: DataFrame, written: list) -> DataFrame:
    """``result``, which owns the tables ``written``: ``release(result)`` deletes them, and nothing else does before the JVM ends."""
    result._scratch = [*getattr(result, "_scratch", []), *written]
    return result


def release(*tables: DataFrame) -> None:
    """Delete what tables or results own, once nothing will read it any more; tables of a catalog are dropped from it."""
    for df in tables:
        spark = df.sparkSession
        for path, table in getattr(df, "_scratch", []):
            if table:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table_bytes(df: DataFrame, column: str) -> int:
    """Bytes of a text column."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]
