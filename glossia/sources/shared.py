"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local master without one, as in tests, gets a local folder."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        known = sc._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get().rstrip("/")
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder name below the shared one that nothing else uses."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: lineage ends here."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def use_buckets(spark: SparkSession) -> None:
    """Session settings by which plans use the buckets of tables: in joins by more than their key, and to open only those that are asked for."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")


#: Writers that a task may have open at once; while it has no more, rows that it writes to buckets aren't sorted.
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def bucketed(df: DataFrame, name: str, key: str, buckets: int, dealt: bool = False) -> DataFrame:
    """Write once as a table whose rows lie by ``key`` in so many buckets, read back.

    What is read is known to be dealt by the key, so aggregates, windows and joins by it,
    and by it with more columns, move no row. Rows that aren't dealt yet are shuffled once, here;
    ``dealt`` rows were dealt into so many partitions by the key, before a step that made Spark forget it.
    """
    spark = df.sparkSession
    use_buckets(spark)
    table = f"{name}_{uuid.uuid4().hex}"
    rows, before = df if dealt else df.repartition(buckets, key), spark.conf.get(_WRITERS)
    spark.conf.set(_WRITERS, "8")  # a task has rows of one bucket
    try:
        rows.write.bucketBy(buckets, key).option("path", f"{folder(spark)}/{table}").saveAsTable(table)
    finally:
        spark.conf.set(_WRITERS, before)
    return spark.table(table)
